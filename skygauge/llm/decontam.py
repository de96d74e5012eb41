"""Benchmark decontamination by spaced-seed hashing with verified overlaps."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from skygauge.llm.common import give_back, slices, text_of
from skygauge.sources.shared import materialise

#: An overlap is a stretch of WINDOW words (a whole item, if that is shorter) of which at least
#: SHARE are equal, in places that correspond; items of fewer than LEAST words must stand whole, with
#: all words equal.
WINDOW, SHARE, LEAST = 13, 0.8, 8
#: Fixed masks (1: the word counts, 0: it is ignored). Every stretch of 8 to 13 words with as
#: many substitutions as SHARE allows has a place where one of them sees equal words only.
MASKS = ("111111", "1101111", "11110011", "110101011", "111001011")
BLOCK_BYTES = 16 << 20
KEEP = 400_000
CHUNK = 1 << 20

_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_FACTORS = np.random.default_rng(20).integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Words(dict):
    """Word -> 64-bit hash, keeping the words seen."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


#: Scripts that are written without blanks between words: a character is a word there.
UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
_ALONE = regex.compile(f"[{UNSPACED}]")
_BETWEEN = regex.compile(r"[^\x00-\x7F\p{L}\p{M}\p{N}]")


def words_of(text: str) -> list[bytes]:
    """Lower-cased runs of letters, marks and digits, and single characters of scripts without blanks."""
    text = text.lower()
    if not text.isascii():
        text = _ALONE.sub(r" \g<0> ", _BETWEEN.sub(" ", text))
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def needed(length: int) -> tuple[int, int]:
    """For an item of so many words: the stretch's length and how many words must be equal."""
    stretch = min(WINDOW, length)
    return stretch, -int(-SHARE * stretch // 1) if length >= LEAST else length


def masked_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """A hash for every place of the mask, of the words that it does not ignore."""
    places = max(0, len(words) - len(mask) + 1)
    total = np.zeros(places, np.uint64)
    for at, factor in zip((i for i, c in enumerate(mask) if c == "1"), _FACTORS):
        total += words[at:at + places] * factor
    return total ^ (total >> np.uint64(29))


class Index:
    """The masked hashes of a block of benchmark items."""

    FLAGS = 22

    def __init__(self, items: list[tuple[int | None, str | None]]):
        known, kept = Words(), []
        for item, text in items:
            words = words_of(text or "")
            if words:
                kept.append((item, np.fromiter(map(known.__getitem__, words), np.uint64, len(words))))
        self.items = [item for item, _ in kept]
        self.lengths = np.array([len(w) for _, w in kept], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.words = np.concatenate([w for _, w in kept]) if kept else np.empty(0, np.uint64)
        self.stretch = np.array([needed(n)[0] for n in self.lengths], np.int64)
        self.equal = np.array([needed(n)[1] for n in self.lengths], np.int64)
        owner = np.repeat(np.arange(len(kept)), self.lengths)
        self.seeds = []
        length = self.lengths[owner] if len(kept) else np.empty(0, np.int64)
        whole = ["1" * n for n in sorted(set(self.lengths.tolist())) if n < LEAST]
        for mask in (*MASKS, *whole):
            hashes = masked_hashes(self.words, mask)
            place = np.arange(len(hashes))
            place = place[owner[place] == owner[place + len(mask) - 1]]
            place = place[length[place] == len(mask) if mask in whole else length[place] >= LEAST]
            place = place[np.argsort(hashes[place], kind="stable")]
            hashes = hashes[place]
            flags = np.zeros(1 << self.FLAGS, bool)
            flags[hashes >> np.uint64(64 - self.FLAGS)] = True
            self.seeds.append((mask, flags, hashes, place))
        self.owner = owner

    def overlaps(self, texts: list[str], known: Words) -> tuple[np.ndarray, ...]:
        """For each text and item with an overlap: text, item, equal words of the best stretch,
        its first word in the text. One row per pair; of equal stretches the first counts."""
        if len(known) > KEEP:
            known.clear()
        cut = [words_of(t) for t in texts]
        lengths = np.fromiter(map(len, cut), np.int64, len(cut))
        ends = np.cumsum(lengths)
        words = np.fromiter((known[w] for part in cut for w in part), np.uint64, int(lengths.sum()))
        text = np.repeat(np.arange(len(cut)), lengths)
        diagonals = [np.empty((0, 2), np.int64)]
        for mask, flags, hashes, place in self.seeds:
            own = masked_hashes(words, mask)
            at = np.flatnonzero(flags[own >> np.uint64(64 - self.FLAGS)])
            at = at[text[at] == text[at + len(mask) - 1]]
            low, high = (np.searchsorted(hashes, own[at], side) for side in ("left", "right"))
            at, low, count = at[high > low], low[high > low], (high - low)[high > low]
            for part in _chunks(count, CHUNK):
                n = count[part]
                entry = np.repeat(low[part], n) + _steps(n)
                seen = place[entry]
                # the text position where the item would begin, and the item
                begin = np.repeat(at[part], n) - (seen - self.starts[self.owner[seen]])
                diagonals.append(np.unique(np.stack([begin, self.owner[seen]], 1), axis=0))
        found = np.unique(np.concatenate(diagonals), axis=0)
        return self._verify(found[:, 0], found[:, 1], words, text, ends)

    def _verify(self, begin, item, words, text, ends):
        rows = [(np.empty(0, np.int64),) * 4]
        length = self.lengths[item]
        for part in _chunks(length, CHUNK):
            n, of = length[part], np.repeat(np.arange(part.stop - part.start), length[part])
            step = _steps(n)
            place = begin[part][of] + step
            inside = (place >= 0) & (place < len(words))
            mine = np.where(inside, place, 0)
            equal = inside & (words[mine] == self.words[self.starts[item[part]][of] + step])
            # a stretch lies in one text: counts are taken per run of one item over one text
            owner = np.where(inside, text[mine], -1)
            total = np.concatenate([[0], np.cumsum(equal)])
            stretch = self.stretch[item[part]][of]
            first = np.arange(len(of))
            whole = step + stretch <= n[of]
            first, stretch = first[whole], stretch[whole]
            score = total[first + stretch] - total[first]
            good = (score >= self.equal[item[part]][of[first]]) & (owner[first] >= 0)
            good &= owner[first] == owner[first + stretch - 1]
            first, score = first[good], score[good]
            rows.append((owner[first], item[part][of[first]], score, place[first]))
        owner, which, score, place = (np.concatenate(x) for x in zip(*rows))
        order = np.lexsort((place, -score, which, owner))
        owner, which, score, place = (x[order] for x in (owner, which, score, place))
        top = np.ones(len(owner), bool)
        top[1:] = (owner[1:] != owner[:-1]) | (which[1:] != which[:-1])
        owner, which, score, place = (x[top] for x in (owner, which, score, place))
        return owner, which, score, place - (ends - np.diff(ends, prepend=0))[owner]


def _steps(counts: np.ndarray) -> np.ndarray:
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _chunks(sizes: np.ndarray, most: int) -> Iterator[slice]:
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield slice(start, stop)
        start = stop


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list]:
    """The distinct items in blocks of about ``block_bytes``, each small enough to be sent."""
    items = benchmark.select(F.col(item_col).alias("item"), text_of(text_col).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = 1 + 2 * size // block_bytes
    for block in range(count):
        part = items if count == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == block)
        yield [(r.item, r.text) for r in part.collect()], count


def overlaps(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(id, item_id, n_equal, n_words, first_word) for every document and item that overlap.

    n_equal of the n_words words of the best stretch are equal; first_word is where that starts
    in the document (words from 0). The benchmark is the query set: its hashes are sent to all
    tasks in blocks whose size is checked, one pass over the documents each, whose hits are written
    before the next, so a benchmark of any size is searched whole and the documents are never shuffled. Tasks hash every
    place of every text under each mask, look the hashes up, and compare the words along the
    diagonals so found; no place is left out, so the result is that of comparing everything.

    A null text is empty; texts without words have no rows, nor has an empty table on either side. Items
    of fewer than LEAST words count where they stand whole. Documents in repeated rows give repeated rows; repeated items
    count once, and items under one id with different texts give a row each. Only the columns
    named are read.
    """
    picked = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    item_type = benchmark.schema[item_col].dataType
    numbers = [StructField(n, LongType()) for n in ("n_equal", "n_words", "first_word")]
    schema = StructType([picked.schema[0], StructField("item_id", item_type), *numbers])
    arrow = to_arrow_schema(schema)
    made = None
    for items, count in blocks(benchmark, item_col, item_text_col, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            index, known = Index(sent.value), Words()
            for batch in batches:
                for part in slices(batch, 4 << 20):
                    text, which, score, first = index.overlaps(part.column(1).to_pylist(), known)
                    if len(text):
                        ids = [part.column(0).take(pa.array(text)), pa.array([index.items[i] for i in which], arrow.field(1).type)]
                        rest = [pa.array(x) for x in (score, index.stretch[which], first)]
                        yield pa.RecordBatch.from_arrays(ids + rest, schema=arrow)

        found = picked.mapInArrow(run, schema)
        if count > 1:  # one block at a time is held by driver and tasks
            found = materialise(found, "overlaps")
            sent.destroy()
        made = found if made is None else made.unionByName(found)
    return made


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The documents, with all their columns, that overlap no benchmark item.

    A null text overlaps nothing and stays, as do empty ones; whole texts are compared, however long; repeated
    rows stay or go together; an empty benchmark drops nothing, an empty table stays empty.
    Columns of any name are kept as they are.
    """
    arrow = to_arrow_schema(docs.schema)
    for items, count in blocks(benchmark, item_col, item_text_col, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            give_back()
            index, known = Index(sent.value), Words()
            place = arrow.get_field_index(text_col)
            for batch in batches:
                texts = batch.column(place).cast(pa.string())
                pair = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), texts], names=["row", "text"])
                keep = np.ones(batch.num_rows, bool)
                for part in slices(pair, 4 << 20):
                    hit = index.overlaps([t or "" for t in part.column(1).to_pylist()], known)[0]
                    keep[part.column(0).to_numpy()[hit]] = False
                if keep.any():
                    yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
        if count > 1:
            docs = materialise(docs, "no-overlaps")
            sent.destroy()
    return docs
