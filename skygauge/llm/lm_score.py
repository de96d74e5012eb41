"""Language-model scores: cross-entropy difference of matched target and background models.

Texts are coded once, in chunks of some MB: their words as numbers within the chunk, and the chunk's distinct words.
A chunk asks for the counts of its distinct words, and then of its distinct pairs of words, over all
texts: its share of a bucket of hashes goes there as one packed row, meets those of the other chunks,
and comes back as the total counts in the same order. A chunk that knows its counts scores its own texts.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType

from skygauge.llm.common import give_back, slices, text_of
from skygauge.sources.shared import materialise, new_path, remove

#: Words seen less often than this are one (unknown) word; weight of the single-word probability in
#: each context, and count added to every word.
LEAST, BACKOFF, EXTRA = 2, 5.0, 0.5
#: Words, and places of pairs, that a bucket gets at about; there are as many buckets as that takes: no effect on results.
HOT_WORDS, HOT_PAIRS = 1 << 18, 1 << 20
#: Bytes of text that are coded together, whole texts.
CHUNK = 8 << 20
#: Losses are added as integers of 1 / SCALE nats, so sums do not depend on their order.
SCALE = 1 << 30
#: What stands for the start of a text and for unknown words among the words' hashes.
START, UNKNOWN = 1, 2
KEEP = 400_000

_PLAIN = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 48 or 57 < b < 65 or 90 < b < 97 or 122 < b < 128 else b for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z as a-z."""
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split()


class Hashes(dict):
    """Word -> signed 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = int.from_bytes(xxhash.xxh64_digest(word), "big", signed=True)
        return value


def _coded(texts: list[str], known: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts, and how many each text has."""
    if len(known) > KEEP:
        known.clear()
    cut = [words_of(t) for t in texts]
    lengths = np.fromiter(map(len, cut), np.int64, len(cut))
    return np.fromiter((known[w] for words in cut for w in words), np.int64, int(lengths.sum())), lengths


def _starts(lengths: np.ndarray) -> np.ndarray:
    """Places of the first words of the texts that have any."""
    return (np.cumsum(lengths) - lengths)[lengths > 0]


def _pairs(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word and its predecessor (START at the start of a text)."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[_starts(lengths)] = START
    mixed = before.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + ids.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0x94D049BB133111EB)
    return mixed ^ (mixed >> np.uint64(32))


def pack(values: np.ndarray) -> bytes:
    """Numbers from 0 to 2^64 as compressed bytes, the lowest byte of all first: high bytes of small numbers cost nothing."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(packed: bytes, count: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 8 * count, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, count).T).view("<u8").ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(packed: bytes, count: int) -> np.ndarray:
    return np.cumsum(unpack(packed, count), dtype=np.uint64)


_ASKED = pa.schema([*((c, pa.int64()) for c in ("bucket", "chunk", "size")), *((c, pa.binary()) for c in ("keys", "n", "t"))])
_ANSWER = pa.schema([*((c, pa.int64()) for c in ("chunk", "bucket", "size")), ("n", pa.binary()), ("t", pa.binary()), ("sums", pa.list_(pa.int64()))])


def _asked(chunk: int, keys: np.ndarray, n: np.ndarray, t: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A chunk's sorted keys with their counts there, one row for each bucket of keys."""
    own = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    bucket, first = np.unique(own, return_index=True)
    parts = [slice(a, b) for a, b in zip(first, [*first[1:], len(keys)])]
    columns = (
        bucket.astype(np.int64), np.full(len(parts), chunk), [p.stop - p.start for p in parts],
        [pack_sorted(keys[p]) for p in parts], [pack(n[p]) for p in parts], [pack(t[p]) for p in parts],
    )
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ASKED)], schema=_ASKED)


def step_of(n: np.ndarray) -> np.ndarray:
    """Eighths of a power of two."""
    return np.floor(8 * np.log2(np.maximum(n, 1))).astype(np.int64)


def totals(asked: DataFrame) -> DataFrame:
    """(chunk, bucket, size, n, t, sums): each row of ``asked`` with the counts of its keys over all chunks, in their
    order. ``sums``, in one row of a bucket, has the number of keys by step of n, and the sums of their
    n and t; those of fewer than LEAST apart.

    A key comes once from each chunk, so no key gathers more rows than there are chunks.
    """
    def run(table: pa.Table) -> pa.Table:
        sizes = table["size"].to_numpy()
        keys = np.concatenate([unpack_sorted(k.as_py(), s) for k, s in zip(table["keys"], sizes)])
        unique, place = np.unique(keys, return_inverse=True)
        del keys
        sums = []
        for c in "nt":
            counts = np.concatenate([unpack(k.as_py(), s) for k, s in zip(table[c], sizes)])
            sums.append(np.bincount(place, counts.astype(float), len(unique)).astype(np.int64))  # exact below 2^53
        n, t = sums
        kind, at = np.unique(2 * step_of(n) + (n >= LEAST), return_inverse=True)
        found = np.stack([kind, np.bincount(at), np.bincount(at, n).astype(np.int64), np.bincount(at, t).astype(np.int64)], 1)
        ends = np.cumsum(sizes)
        parts = [place[e - s:e] for e, s in zip(ends, sizes)]
        columns = (
            table["chunk"], table["bucket"], sizes, [pack(n[p]) for p in parts], [pack(t[p]) for p in parts],
            [found.ravel().tolist(), *[None] * (len(parts) - 1)],
        )
        made = [c if isinstance(c, pa.ChunkedArray) else pa.array(c, f.type) for c, f in zip(columns, _ANSWER)]
        return pa.Table.from_arrays(made, schema=_ANSWER)

    return asked.groupBy("bucket").applyInArrow(run, from_arrow_schema(_ANSWER))


def _listed(values, kind: pa.DataType) -> pa.Array:
    """One row with all values as its array."""
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind.value_type), type=kind)


def code_texts(rows: DataFrame) -> DataFrame:
    """(ids, lengths, size, words, n, places, tokens) of chunks of the rows (id, text): how many words each text has,
    the chunk's distinct words by hash with their counts, and all words in order as ranks by count."""
    kind = StructType([StructField("ids", ArrayType(rows.schema["id"].dataType)), *StructType.fromDDL(
        "lengths array<long>, size long, words binary, n binary, places long, tokens binary")])
    schema = to_arrow_schema(kind)

    def chunk(parts: list, ids: list, known: Hashes) -> pa.RecordBatch:
        every, lengths = np.concatenate([i for i, _ in ids]), np.concatenate([n for _, n in ids])
        words, place, n = np.unique(every.view(np.uint64), return_inverse=True, return_counts=True)
        columns = (
            _listed(pa.concat_arrays(parts), schema[0].type), _listed(lengths, schema[1].type),
            [len(words)], [pack_sorted(words)], [pack(n)], [len(place)], [pack(ranks(n)[place])],
        )
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, parts, coded, held = Hashes(), [], [], 0
        give_back()
        for batch in batches:
            for part in slices(batch, 4 << 20):
                size = part.column(1).nbytes
                if parts and held + size > CHUNK:
                    yield chunk(parts, coded, known)
                    parts, coded, held = [], [], 0
                coded.append(_coded(part.column(1).to_pylist(), known))
                parts.append(part.column(0))
                held += size
        if parts:
            yield chunk(parts, coded, known)

    return rows.select("id", "text").mapInArrow(run, kind)


def ranks(n: np.ndarray) -> np.ndarray:
    """The place of each count in descending order."""
    rank = np.empty(len(n), np.int64)
    rank[np.argsort(-n.astype(np.int64), kind="stable")] = np.arange(len(n))
    return rank


class _Chunk:
    """A chunk's row, unpacked."""

    def __init__(self, row: dict):
        self.lengths = np.array(row["lengths"], np.int64)
        self.words = unpack_sorted(row["words"], row["size"])
        order = np.argsort(ranks(unpack(row["n"], row["size"])))
        self.tokens = order[unpack(row["tokens"], row["places"]).astype(np.int64)]
        marked = np.zeros(len(self.lengths), bool)
        marked[np.array(row["marks"] or [], np.int64)] = True
        self.chosen = np.repeat(marked, self.lengths)

    def counts(self, place: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """How often each number is in ``place``, one for each word, and how often in the target's texts."""
        return np.bincount(place, minlength=size), np.bincount(place[self.chosen], minlength=size)

    def pairs(self, known: np.ndarray) -> np.ndarray:
        named = np.where(known, self.words, np.uint64(UNKNOWN)).view(np.int64)
        return _pairs(named[self.tokens], self.lengths)


_SHAPE = ("lengths", "marks", "size", "words", "n", "places", "tokens")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def _buckets(rows: DataFrame, places: int, each: int) -> int:
    return max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-places // each))


def _least(sums: list, vocabulary: int) -> int:
    """The least step of a word with a count of its own, so that no more than ``vocabulary`` words have one."""
    steps: dict[int, int] = {}
    for r in sums:
        steps[r.kind // 2] = steps.get(r.kind // 2, 0) + r.words
    least, taken = 1 << 30, 0
    for s in sorted(steps, reverse=True):
        if taken + steps[s] > vocabulary:
            break
        least, taken = s, taken + steps[s]
    return least


def cross_entropy_difference(
    df: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: int | None = None,
) -> DataFrame:
    """(id, n_words, loss_background, loss_target, score) per row of ``df``: mean loss per word in nats under models of
    all rows and of the target's, and how much lower the target's is. The target's rows are
    those whose id is in ``targets`` (a frame of ids, nulls and repeats without effect).

    The vocabulary is every word seen LEAST times. A model's probability of a word after another is interpolated
    with that of the word alone, by the same weights in both; all counts are exact and of whole
    texts. A null text is empty; a text without words has null losses and score 0; repeated rows
    give repeated rows; an empty table gives none.

    Chunks are frozen on shared storage; they, not texts, meet their marks and counts, in sort-merge joins at every size:
    nothing bounds the number of ids or of chunks.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    path, coded = new_path(spark, "lm-coded"), code_texts(rows).withColumn("chunk", F.monotonically_increasing_id())
    coded.write.parquet(path)
    coded = spark.read.schema(coded.schema).parquet(path)
    ids = targets.toDF("target").where(F.col("target").isNotNull()).distinct()
    texts = coded.select("chunk", F.posexplode(F.arrays_zip("ids", "lengths")).alias("at", "own")).select("chunk", "at", "own.*")
    marks = materialise(texts.join(ids.hint("merge"), texts["ids"] == ids["target"]).groupBy("chunk").agg(
        F.collect_list("at").alias("marks"), F.count_if(F.col("lengths") > 0).alias("begun")), "lm-marks")
    marked = coded.join(marks.drop("begun").hint("merge"), "chunk", "left")
    begun = [coded.agg(F.sum(F.size(F.filter("lengths", lambda n: n > 0)))), marks.agg(F.sum("begun"))]
    start = [float(f.first()[0] or 0) for f in begun]
    size = coded.agg(F.sum("size").alias("words"), F.sum("places").alias("places")).first()
    word_buckets, pair_buckets = _buckets(df, size.words or 0, HOT_WORDS), _buckets(df, size.places or 0, HOT_PAIRS)

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for row in _rows(batches):
            own = _Chunk(row)
            yield _asked(row["chunk"], own.words, *own.counts(own.tokens, len(own.words)), word_buckets)

    answers = materialise(totals(marked.select("chunk", *_SHAPE).mapInArrow(ask_words, from_arrow_schema(_ASKED))), "lm-words")
    each = answers.where("sums is not null").select(F.explode(F.sequence(F.lit(0), (F.size("sums") / 4 - 1).cast("int"))).alias("i"), "sums")
    each = each.select(*(F.get("sums", 4 * F.col("i") + j).alias(c) for j, c in enumerate(("kind", "words", "n", "t"))))
    sums = each.groupBy("kind").agg(*(F.sum(c).alias(c) for c in ("words", "n", "t"))).collect()  # some hundreds at most
    least = None if vocabulary is None else _least(sums, vocabulary)

    def is_known(kind: int) -> bool:
        return kind % 2 == 1 if least is None else kind // 2 >= least

    words = sum(r.words for r in sums if is_known(r.kind))
    unknown = [float(sum(r[c] for r in sums if not is_known(r.kind))) for c in "nt"]
    whole = [float(sum(r[c] for r in sums)) + EXTRA * (words + 1) for c in "nt"]

    def known_of(n: np.ndarray) -> np.ndarray:
        return n >= LEAST if least is None else step_of(n) >= least

    parts = answers.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "size", "n", "t"))).alias("found"))
    counted = materialise(marked.join(parts.hint("merge"), "chunk", "left"), "lm-counted")
    remove(spark, path)

    def unpacked(found: list[dict] | None, c: str) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *(unpack(f[c], f["size"]) for f in found or [])]).astype(np.int64)

    def ask_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for row in _rows(batches):
            own = _Chunk(row)
            keys, place = np.unique(own.pairs(known_of(unpacked(row["found"], "n"))), return_inverse=True)
            yield _asked(row["chunk"], keys, *own.counts(place, len(keys)), pair_buckets)

    pairs = totals(counted.select("chunk", *_SHAPE, "found").mapInArrow(ask_pairs, from_arrow_schema(_ASKED))).drop("sums")
    kind = StructType([StructField("id", rows.schema["id"].dataType), *StructType.fromDDL("n_words long, lb long, lt long")])
    schema = to_arrow_schema(kind)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        order = np.argsort(right["bucket"].to_numpy())
        found = [{c: right[c][int(i)].as_py() for c in ("size", "n", "t")} for i in order]
        for batch in left.to_batches():
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("found", *_SHAPE)}
                own, n = _Chunk(row), unpacked(row["found"], "n")
                known = known_of(n)
                _, first, place = np.unique(own.pairs(known), return_index=True, return_inverse=True)
                begins = np.zeros(len(own.tokens), bool)
                begins[_starts(own.lengths)] = True
                begins, last = begins[first], own.tokens[first - 1]
                ends = np.cumsum(own.lengths)
                columns = []
                for c, many, rest, begin in zip("nt", whole, unknown, start):
                    alone = np.where(known, unpacked(row["found"], c), rest)
                    pair, v, w = unpacked(found, c), np.where(begins, begin, alone[last]), alone[own.tokens[first]]
                    single = (w + EXTRA) / many
                    loss = np.floor(-SCALE * np.log((pair + BACKOFF * single) / (np.maximum(v, pair) + BACKOFF)) + 0.5).astype(np.int64)
                    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(loss[place])])
                    columns.append(pa.array(total[ends] - total[ends - own.lengths]))
                ids = batch.column("ids")[i].values
                made.append(pa.Table.from_arrays([ids.cast(schema[0].type), pa.array(own.lengths), *columns], schema=schema))
        return pa.concat_tables(made) if made else schema.empty_table()

    sides = [f.select("chunk", *c).groupBy("chunk") for f, c in ((counted, ("ids", *_SHAPE, "found")), (pairs, ("bucket", "size", "n", "t")))]
    scored = sides[0].cogroup(sides[1]).applyInArrow(score, kind)
    mean = {c: F.when(F.col("n_words") > 0, F.col(c) / F.lit(float(SCALE)) / F.col("n_words")) for c in ("lb", "lt")}
    return scored.select(
        "id", "n_words", mean["lb"].alias("loss_background"), mean["lt"].alias("loss_target"),
        F.coalesce(mean["lb"] - mean["lt"], F.lit(0.0)).alias("score"),
    )
