"""Embedding near-duplicates: random-hyperplane tables, exact cosines, connected components."""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygauge.llm.common import local_roots, settle
from skygauge.llm.components import components

#: Links have at least this cosine; a pair just that close is missed with at most MISS probability.
COSINE, MISS, SEED = 0.95, 1e-3, 1
#: Vectors of a bucket that are compared as one block.
BLOCK = 512


def tables_for(classes: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """Bits of a signature and number of tables: bits grow with the logarithm of the vectors, so
    that unrelated ones rarely meet, and the tables with them, so that close ones do meet."""
    bits = min(32, max(8, math.ceil(math.log2(max(2, classes)))))
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-meet))


def _signatures(bits: int, tables: int):
    """(bytes of the vector) -> with a signature per table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = {}
        for batch in batches:
            vectors = batch.column(1).to_pylist()
            made = [b""] * len(vectors)
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by_size.setdefault(len(v), []).append(i)
            for size, rows in by_size.items():
                if size not in planes:
                    planes[size] = np.random.default_rng([SEED, size]).standard_normal((size // 8, bits * tables))
                side = np.stack([np.frombuffer(vectors[i]) for i in rows]) @ planes[size] > 0
                weights = np.uint64(1) << np.arange(bits, dtype=np.uint64)
                signs = (side.reshape(len(rows), tables, bits) * weights).sum(2).astype("<u4")
                for i, sign in zip(rows, signs):
                    made[i] = sign.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=["cls", "vector", "signs"])
    return run


def _verify(cosine: float):
    """Compare the vectors of each (table, signature, blocks) group, which arrive together.

    A pair counts in the first table where it meets. Per vector with links: how many vectors
    these stand for, and the smallest class it is connected to inside the group.
    """
    def group(table, left, right, cls, count, half, vectors, signs):
        units = np.stack([np.frombuffer(v) for v in vectors])
        units = units / np.linalg.norm(units, axis=1, keepdims=True)
        if left == right:
            i, j = np.nonzero(np.triu(units @ units.T >= cosine, 1))
        else:
            a, b = np.flatnonzero(half == left), np.flatnonzero(half == right)
            i, j = np.nonzero(units[a] @ units[b].T >= cosine)
            i, j = a[i], b[j]
        if not len(i):
            return None
        codes = np.stack([np.frombuffer(s, "<u4") for s in signs])
        links = np.zeros(len(cls), np.int64)
        for lo in range(0, len(i), 1 << 16):
            x, y = i[lo:lo + (1 << 16)], j[lo:lo + (1 << 16)]
            new = ~(codes[x, :table] == codes[y, :table]).any(1)
            np.add.at(links, x[new], count[y[new]])
            np.add.at(links, y[new], count[x[new]])
        order = np.argsort(cls, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        root = cls[order][local_roots(len(cls), place[i], place[j])][place]
        some = np.unique(np.concatenate([i, j]))
        return cls[some], links[some], root[some]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch if held is None else pa.concat_batches([held, batch])
            keys = np.stack([held.column(n).to_numpy().astype(np.int64) for n in ("t", "sign", "x", "y")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            if len(cuts):
                yield from close(held.slice(0, int(cuts[-1])), keys[:, :cuts[-1]], cuts[:-1])
                held = held.slice(int(cuts[-1]))
        if held is not None:
            keys = np.stack([held.column(n).to_numpy().astype(np.int64) for n in ("t", "sign", "x", "y")])
            yield from close(held, keys, np.empty(0, np.int64))

    def close(rows, keys, cuts):
        cls, count, half = (rows.column(n).to_numpy() for n in ("cls", "n", "half"))
        vectors, signs = rows.column("vector"), rows.column("signs")
        out = []
        for lo, hi in zip([0, *cuts], [*cuts, rows.num_rows]):
            if hi - lo > 1:
                found = group(int(keys[0, lo]), keys[2, lo], keys[3, lo], cls[lo:hi], count[lo:hi], half[lo:hi],
                              vectors.slice(lo, hi - lo).to_pylist(), signs.slice(lo, hi - lo).to_pylist())
                if found:
                    out.append(found)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["cls", "links", "root"])

    return run


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for v in batch.column(1).to_pylist():
            usable = v is not None and None not in v
            numbers = np.array(v if usable else [], float)
            with np.errstate(over="ignore"):
                good = usable and np.isfinite(numbers).all() and numbers.any()
            if good:  # to unit size first, so that no square over- or underflows
                numbers = numbers / np.abs(numbers).max()
            made.append((numbers + 0.0).tobytes() if good else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["id", "vector"])


def embedding_dedup(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
    cosine: float = COSINE, miss: float = MISS,
) -> DataFrame:
    """(id, n_links, component_id, kept) per row: how many other vectors have a cosine of at least
    ``cosine`` (in double precision) to this one, the smallest id reachable by such links, and
    whether that is the row's own.

    Equal vectors are one class with a count, so copies cost one row each. Every class gets a sign
    signature over random hyperplanes in each of several tables; classes that share one meet in
    a bucket, and the exact cosine decides. Bits and tables follow from the number of classes
    (``tables_for``): a pair at the limit is missed with probability ``miss``, closer ones less.
    Buckets are cut into blocks of about BLOCK vectors, every two blocks of a bucket meet in a
    group of their own, and a group returns counts and one link per vector, never its pairs; so no
    bucket is too large for a task. Buckets of one vector go no further.

    Vectors that are null, zero, or hold null or non-finite components link with nothing: 0 links,
    their own component; vectors of different lengths do not link either. Rows that repeat an id
    are vectors of their own and link like any others. A null id is smallest only where
    all are null. An empty table gives no rows. Other columns are not read.
    """
    given = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = settle(given.mapInArrow(_as_bytes, f"id {given.schema[0].dataType.simpleString()}, vector binary"))
    usable = rows.where(F.col("vector").isNotNull())
    classes = settle(
        usable.groupBy("vector").agg(F.min("id").alias("low"), F.count("*").alias("n"))
        .withColumn("cls", F.monotonically_increasing_id())
    )
    size = classes.count()
    bits, tables = tables_for(size, cosine, miss)
    signed = settle(classes.select("cls", "vector").mapInArrow(_signatures(bits, tables), "cls long, vector binary, signs binary"))

    slots = F.transform(
        F.sequence(F.lit(0), F.lit(tables - 1)),
        lambda t: F.struct(t.alias("t"), F.conv(F.hex(F.substring("signs", 4 * t + 1, F.lit(4))), 16, 10).cast("long").alias("sign")),
    )
    met = signed.select("cls", F.explode(slots).alias("s")).select("cls", "s.t", "s.sign")
    shared = met.groupBy("t", "sign").agg(F.count("*").alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    half = F.pmod(F.xxhash64("cls"), blocks).cast("int")
    placed = met.join(shared, ["t", "sign"]).select("cls", "t", "sign", half.alias("half"), blocks.alias("blocks"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = placed.withColumn("other", others).select(
        "cls", "t", "sign", "half", F.least("half", "other").alias("x"), F.greatest("half", "other").alias("y")
    )
    full = placed.join(signed, "cls").join(classes.select("cls", "n"), "cls")
    found = settle(
        full.select("t", "sign", "x", "y", "half", "cls", "n", "vector", "signs")
        .repartition("t", "sign", "x", "y").sortWithinPartitions("t", "sign", "x", "y")
        .mapInArrow(_verify(cosine), "cls long, links long, root long")
    )
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    named = (
        classes.select("cls", "vector", "low", "n").join(links, "cls", "left")
        .join(roots, classes["cls"] == roots["node"], "left")
        .select("vector", "low", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "cls").alias("root"))
    )
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(least, "root").select("vector", "n_links", "component_id")
    linked = usable.join(named, "vector").select("id", "n_links", "component_id")
    alone = rows.where(F.col("vector").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
