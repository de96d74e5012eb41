"""Connected components by alternating stars, as joins and aggregates."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygauge.llm.common import settle


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b): root is the smallest node reachable.

    Each round hangs every node's larger neighbours below the smallest one it knows, then does
    the same among the smaller ones, until the links are stars; the number of rounds grows with
    the logarithm of the longest path. Minima combine before they are shuffled, and a hub
    meets its links in a plain equi-join, which adaptive execution splits. Every round is
    settled on shared storage. Loops and repeated links have no effect; links with a null end
    are dropped; no links give no rows.
    """
    a, b = F.col("a"), F.col("b")
    stars = settle(
        links.where((a != b) & a.isNotNull() & b.isNotNull())
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    before = _digest(stars)
    while before[0]:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(low, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        stars = settle(
            small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        after = _digest(stars)
        if after == before:
            break
        before = after
    roots = stars.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _digest(stars: DataFrame) -> tuple:
    hashed = F.xxhash64("u", "v")
    row = stars.agg(F.count("*"), F.bit_xor(hashed), F.sum(F.shiftright(hashed, 20))).first()
    return tuple(row)
