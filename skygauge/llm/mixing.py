"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skygauge.llm.common import settle

#: Words of a block; rows (units, slots) that one task orders; passes over a source at most.
BLOCK_WORDS, PIECE_ROWS, PASSES = 1024, 50_000, 2
#: Buckets of a source at least.
BUCKETS = 64
WORDS = r"[^\x20\x09-\x0D]+"
_SOURCE = ("no_source", "source")


def text_words(text_col: str) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")


def _spread(df: DataFrame, first: Column, last: Column, name: str, deal: bool = False, step: int = 4096) -> DataFrame:
    """A row for each whole number from first to last, ``step`` at a time: no long array is made.

    ``deal`` spreads these parts over the tasks, for a few rows that stand for many.
    """
    df = df.withColumns({"_first": first.cast("long"), "_last": last.cast("long")})
    parts = df.withColumn("_part", F.explode(F.sequence(F.floor(F.col("_first") / step), F.floor(F.col("_last") / step))))
    if deal:
        parts = parts.repartition(*_SOURCE, "_part")
    low, high = F.greatest("_first", F.col("_part") * step), F.least("_last", F.col("_part") * step + (step - 1))
    return parts.withColumn(name, F.explode(F.sequence(low, high))).drop("_first", "_last", "_part")


def source_targets(sizes: DataFrame, weights: Column, share: float, passes: int = PASSES) -> DataFrame:
    """``sizes`` (no_source, source, source_size) with ``rank`` (by code point, null last, from 0) and ``target``.

    All targets together are ``share`` of all sizes, dealt by weight (an expression over ``rank``); none
    is above ``passes`` times its source's size, and what is above goes to the others by weight. In
    the order of cap by weight the capped sources come first, so one running sum finds the
    level of the rest. One row per source.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(*_SOURCE)) - 1)
    capped = ranked.withColumns({"weight": weights.cast("double"), "cap": F.col("source_size") * F.lit(float(passes))})
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    told = capped.withColumn("level", level).withColumn("chosen", F.first(fits, ignorenulls=True).over(every))
    return told.select(*_SOURCE, "rank", "source_size", F.least("cap", F.col("chosen") * F.col("weight")).alias("target"))


def _placed(rows: DataFrame, keys: list[str], order: list[str], length: Column, bucket: Column, name: str, told: DataFrame | None = None) -> DataFrame:
    """``name``: the sum of ``length`` over the rows of the key that come before, in the order (bucket, order).

    Buckets are added up first and their sums run over one row per key and bucket; rows are
    ordered within a bucket only, so a key of any size is spread over its buckets. What is ``told`` of
    each source comes along with the buckets.
    """
    rows = rows.withColumns({"_bucket": bucket, "_length": length})
    per_bucket = rows.groupBy(*keys, "_bucket").agg(F.sum("_length").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.withColumn("_start", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    if told is not None:
        starts = starts.join(told.hint("merge"), list(_SOURCE))
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("_inside", F.coalesce(F.sum("_length").over(within), F.lit(0)))
    return inside.join(starts.hint("merge"), [*keys, "_bucket"]).withColumn(
        name, F.col("_start") + F.col("_inside")).drop("_start", "_inside", "_bucket", "_length")


def schedule(sources: DataFrame) -> DataFrame:
    """(no_source, source, block, slot): which block of a source stands in which slot of the mix.

    Slot t of 2^k, the least power of two that holds all ``blocks`` of ``sources`` (and first_point, the
    blocks of the sources before), takes the van der Corput point whose k binary digits are those of
    t reversed, and goes to the source in whose part of the cumulative weights the point lies. The
    points are all multiples of 2^-k, so a source's slots are found from its part alone, and
    are as many as its blocks. A source's slots are ranked in their order, and the first takes
    its first block. Slots beyond the last source's part stay empty.
    """
    blocks = sources.agg(F.sum("blocks")).first()[0] or 0
    bits = max(1, (blocks - 1).bit_length())
    first = F.col("first_point")
    points = _spread(sources.where("blocks > 0"), first, first + F.col("blocks") - 1, "point", deal=True)
    slots = points.select(*_SOURCE, F.conv(F.reverse(F.lpad(F.bin("point"), bits, "0")), 2, 10).cast("long").alias("slot"))
    width = max(1, (1 << bits) // max(BUCKETS, blocks // PIECE_ROWS))
    return _placed(slots, list(_SOURCE), ["slot"], F.lit(1), F.floor(F.col("slot") / width), "block")


def mix(
    df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Column | None = None,
    share: float = 1.5, block_words: int = BLOCK_WORDS, seed: int = 1,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, spans, sources) of a mix of all ``df`` to weighted sources.

    ``sources``: (no_source, source, rank, source_size, target, ...) of ``source_targets``. ``rows``: (no_source,
    source, id, size, digest, copy), one per row; ``digest`` names the text, ``copy`` numbers rows that
    are the same in all of these. ``spans``: (slot, pass, no_source, source, id, size, digest, copy, place,
    first_word, n_words), the mix: in the order of (slot, place) a reader takes those words of those
    rows. Blocks are ``block_words`` words of a source's shuffled rows, one pass after the other, each
    pass in another order; the last block ends at the target, so a source gives its target rounded
    and no row more than PASSES times its size. The shuffle is by md5 of seed, pass and id, so
    reruns agree, whatever the partitions.

    ``weights`` is an expression over a source's ``rank``, more than 0 (3, 1, 2, repeating, if not given).
    Null texts and texts without words have size 0 and no spans; null sources are one source, the
    last; a null id shuffles as an empty one; an empty table gives empty frames; other columns are not
    read. Texts are read once, whole, and not shuffled. Hot sources are spread by buckets of their
    shuffle, and blocks by number; equal rows are one until they have their place.
    """
    if weights is None:
        weights = F.element_at(F.array(F.lit(3), F.lit(1), F.lit(2)), (F.col("rank") % 3 + 1).cast("int"))
    told = df.select(
        F.col(source_col).isNull().alias("no_source"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.col(id_col).alias("id"), text_words(text_col).alias("size"), F.xxhash64(F.col(text_col).cast("string")).alias("digest"))
    units = settle(told.groupBy(*_SOURCE, "id", "size", "digest").agg(F.count(F.lit(1)).alias("copies")))
    sizes = units.groupBy(*_SOURCE).agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    targets = source_targets(sizes, weights, share).withColumn("words", F.round("target").cast("long"))
    targets = targets.withColumn("blocks", F.ceil(F.col("words") / block_words).cast("long"))
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    sources = settle(targets.withColumn("first_point", F.coalesce(F.sum("blocks").over(before), F.lit(0))))

    buckets = max(BUCKETS, units.count() // PIECE_ROWS)
    passes = units.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(PASSES - 1))))
    key = F.md5(F.concat_ws(":", F.lit(seed), "pass", F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    bucket = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / float(1 << 32))
    placed = _placed(
        passes.withColumn("key", key), [*_SOURCE, "pass"], ["key", "id", "size", "digest"],
        F.col("size") * F.col("copies"), bucket, "start", sources.select(*_SOURCE, "source_size", "words"))
    copied = _spread(placed, F.lit(0), F.col("copies") - 1, "copy").withColumn(
        "start", F.col("pass") * F.col("source_size") + F.col("start") + F.col("copy") * F.col("size"))
    taken = copied.withColumn("end", F.least("words", F.col("start") + F.col("size"))).where("start < end")
    pieces = _spread(taken, F.floor(F.col("start") / block_words), F.floor((F.col("end") - 1) / block_words), "block")
    low = F.greatest("start", F.col("block") * block_words)
    high = F.least("end", (F.col("block") + 1) * block_words)
    spans = pieces.join(schedule(sources).hint("merge"), [*_SOURCE, "block"]).select(
        "slot", "pass", *_SOURCE, "id", "size", "digest", "copy", (low - F.col("block") * block_words).alias("place"),
        (low - F.col("start")).alias("first_word"), (high - low).alias("n_words"))
    rows = _spread(units, F.lit(0), F.col("copies") - 1, "copy").drop("copies")
    return rows, spans, sources


def words_taken(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``rows`` of a mix with ``taken``: the words that all its spans take of the row, 0 if none."""
    key = [*_SOURCE, "id", "size", "digest", "copy"]
    both = rows.select(*key, F.lit(0).cast("long").alias("n_words")).unionByName(spans.select(*key, "n_words"))
    return both.groupBy(*key).agg(F.sum("n_words").alias("taken"))


def with_targets(rows: DataFrame, sources: DataFrame, salts: int = 64) -> DataFrame:
    """``rows`` of a mix with their source's source_size and target; a hot source's rows meet them in ``salts`` tasks."""
    told = sources.select(*_SOURCE, "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("id", "copy"), F.lit(salts)).cast("int"))
    return salted.join(told.hint("merge"), [*_SOURCE, "_salt"]).drop("_salt")


def mixed_texts(df: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(slot, place, id, text): the words of each span, joined by single blanks, from the rows that were mixed."""
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    texts = texts.withColumn("_digest", F.xxhash64("_text")).dropDuplicates(["_id", "_digest"])
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    words = F.regexp_extract_all("_text", F.lit(WORDS), F.lit(0))
    cut = F.array_join(F.slice(words, (F.col("first_word") + 1).cast("int"), F.col("n_words").cast("int")), " ")
    return spans.join(texts, same).select("slot", "place", "id", cut.alias("text"))
