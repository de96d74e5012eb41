"""Byte-level BPE: DuckDB contracts a slice's distinct words by recursive queries, inside Spark tasks."""

import base64
import heapq
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygauge.llm.common import per_row, text_of
from skygauge.llm.pieces import SAFE

#: Words per recursive query, words kept between slices, and the length from which a word,
#: which would take a round of the query per byte, is contracted by a heap instead.
WORDS, KEEP, LONG = 60_000, 300_000, 512

_PAIRS = """
    SELECT s.*, (m << 32) | pos AS key
    FROM seed s LEFT JOIN merge ON lr = CASE WHEN nxt >= 0 THEN (tok::BIGINT << 20) | nxt END
"""

#: Rows are a word's tokens: position, token, position and token to the right, and the rank of
#: the pair they form with that (with the position below it, so that the leftmost of equal ranks
#: is smallest). Each round every word that still has a pair contracts the smallest: the right
#: token's row becomes the merged one, the left one's goes, and only the two pairs that touch
#: it are looked up again.
_CONTRACT = f"""
WITH RECURSIVE run(w, pos, tok, npos, nxt, key, best) AS (
    SELECT p.*, best FROM ({_PAIRS}) p JOIN (SELECT w, min(key) AS best FROM ({_PAIRS}) GROUP BY w) USING (w)
  UNION ALL (
    WITH contracted AS MATERIALIZED (
        SELECT n.w, n.pos, n.tok, n.npos, n.nxt, CASE WHEN n.same THEN n.key ELSE (m << 32) | n.pos END AS key
        FROM (
            SELECT r.w,
                   CASE WHEN r.pos = x.npos THEN x.pos ELSE r.pos END AS pos,
                   CASE WHEN r.pos = x.npos THEN x.merged ELSE r.tok END AS tok,
                   r.npos,
                   CASE WHEN r.npos = x.pos THEN x.merged ELSE r.nxt END AS nxt,
                   r.key,
                   r.pos <> x.npos AND r.npos <> x.pos AS same
            FROM run r
            JOIN (SELECT w, pos, npos, (key >> 32)::INT AS merged FROM run WHERE key = best) x ON r.w = x.w
            WHERE r.pos <> x.pos
        ) n
        LEFT JOIN merge ON lr = CASE WHEN n.same OR n.nxt < 0 THEN NULL ELSE (n.tok::BIGINT << 20) | n.nxt END
    )
    SELECT c.*, g.best
    FROM contracted c JOIN (SELECT w, min(key) AS best FROM contracted GROUP BY w) g ON c.w = g.w
  )
)
SELECT w, pos, tok FROM run WHERE best IS NULL
"""

_DECODE = """
SELECT s, list(bytes ORDER BY place) AS parts FROM sequence JOIN vocabulary ON tok = id GROUP BY s ORDER BY s
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Encodes and decodes with a table of byte sequences and ranks; a rank is a token's id."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        if max(ranks.values()) >= 1 << 20 or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("ranks below 2**20 and all single bytes are needed")
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        get, pairs = ranks.get, []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = get(token[:cut]), get(token[cut:])
                if left is not None and right is not None:
                    pairs.append(((left << 20) | right, rank))
        self.pairs = dict(pairs)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "250MB", "preserve_insertion_order": False})
        merge = pa.table({"lr": pa.array(list(self.pairs), pa.int64()), "m": pa.array(list(self.pairs.values()), pa.int64())})
        vocabulary = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "bytes": pa.array(list(ranks), pa.binary())})
        for name, rows in (("merge", merge), ("vocabulary", vocabulary)):
            self.db.register("given", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")

    def _rows(self, sql: str, name: str, given: pa.Table) -> pa.Table:
        self.db.register(name, given)
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister(name)

    def words(self, words: list[bytes]) -> "Runs":
        """The ids of each word."""
        single, left, long = [], [], []
        for at, word in enumerate(words):
            if word in self.ranks:
                single.append(at)
            else:
                (left if len(word) < LONG else long).append(at)
        made = [(np.array(single, np.int64), Runs(np.array([self.ranks[words[i]] for i in single], np.uint32), np.ones(len(single), np.int64)))]
        for start in range(0, len(left), WORDS):
            some = left[start:start + WORDS]
            made.append((np.array(some), self._contract([words[i] for i in some])))
        made += [(np.array([at]), Runs.of([self._long(words[at])])) for at in long]
        return Runs.placed(len(words), made, np.uint32)

    def _contract(self, words: list[bytes]) -> "Runs":
        lengths = np.fromiter(map(len, words), np.int64)
        tokens = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        pos = steps(lengths)
        last = pos == np.repeat(lengths, lengths) - 1
        seed = {
            "w": np.repeat(np.arange(len(words)), lengths), "pos": pos, "tok": tokens,
            "npos": np.where(last, -1, pos + 1), "nxt": np.where(last, -1, np.append(tokens[1:], -1)),
        }
        table = self._rows(_CONTRACT, "seed", pa.table({n: pa.array(v.astype(np.int32)) for n, v in seed.items()}))
        w, at, tok = (table.column(n).to_numpy().astype(np.int64) for n in ("w", "pos", "tok"))
        order = np.argsort((w << 32) | at)
        return Runs(tok[order].astype(np.uint32), np.bincount(w, minlength=len(words)))

    def _long(self, word: bytes) -> np.ndarray:
        """The same rule for one long word: a heap of (rank, position) over linked tokens."""
        tokens = self.byte[np.frombuffer(word, np.uint8)].tolist()
        right = [*range(1, len(tokens)), -1]
        left = [-1, *range(len(tokens) - 1)]
        heap = []

        def offer(at):
            after = right[at]
            if at >= 0 and after >= 0:
                rank = self.pairs.get((tokens[at] << 20) | tokens[after])
                if rank is not None:
                    heapq.heappush(heap, (rank, at, tokens[at], tokens[after]))

        for at in range(len(tokens) - 1):
            offer(at)
        while heap:
            rank, at, one, two = heapq.heappop(heap)
            after = right[at]
            if tokens[at] != one or after < 0 or tokens[after] != two:
                continue
            tokens[at], tokens[after], right[at] = rank, -1, right[after]
            if right[at] >= 0:
                left[right[at]] = at
            offer(at)
            if left[at] >= 0:
                offer(left[at])
        return np.array([t for t in tokens if t >= 0], np.uint32)

    def decode(self, ids: "Runs") -> "Runs":
        """The bytes of each sequence of ids, by an aggregation ordered by position."""
        made, ends = [], np.cumsum(ids.counts)
        for start in range(0, len(ids.counts), WORDS):
            counts = ids.counts[start:start + WORDS]
            tok = ids.flat[ends[start] - counts[0]:ends[start + len(counts) - 1]]
            given = pa.table({
                "s": np.repeat(np.arange(len(counts)), counts), "place": np.arange(len(tok)),
                "tok": pa.array(tok.astype(np.int32)),
            })
            table = self._rows(_DECODE, "sequence", given)
            parts = table.column("parts").combine_chunks()
            pieces = parts.flatten()  # the bytes of all lists, one after the other
            sizes = pc.binary_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
            of = np.repeat(table.column("s").to_numpy(), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
            flat = np.frombuffer(b"".join(pieces.to_pylist()) if pieces.offset else pieces.buffers()[2] or b"", np.uint8)
            total = np.bincount(of, sizes, len(counts)).astype(np.int64)
            made.append((np.arange(start, start + len(counts)), Runs(flat[:total.sum()], total)))
        return Runs.placed(len(ids.counts), made, np.uint8)

    def texts(self):
        """A function from texts to their ids and decoded bytes, which keeps the codes of words
        and segments from slice to slice, up to KEEP of each."""
        kept = _Kept()

        def run(texts: list[str]) -> tuple["Runs", "Runs"]:
            nonlocal kept
            cut = [SAFE.findall(t) for t in texts]
            every = set().union(*cut)
            if max(len(kept.segments), len(kept.words)) + len(every) > KEEP:
                kept = _Kept()
            new = [s for s in every if s not in kept.segments]
            found = list(map(self.pattern.findall, new))
            fresh = [w for w in set().union(*found) if w not in kept.words]
            ids = self.words([w.encode() for w in fresh])
            kept.add(fresh, ids, self.decode(ids), new, found)
            counts = np.fromiter(map(len, cut), np.int64, len(cut))
            segments = np.fromiter(map(kept.segments.__getitem__, chain.from_iterable(cut)), np.int64, int(counts.sum()))
            words = kept.inner.pick(segments)
            text = np.repeat(np.arange(len(cut)), counts)
            text = np.repeat(text, kept.inner.counts[segments])
            return kept.ids.joined(words.flat, text, len(cut)), kept.raw.joined(words.flat, text, len(cut))
        return run


class _Kept:
    """Codes of words, and the words of segments, by place."""

    def __init__(self):
        self.words: dict[str, int] = {}
        self.segments: dict[str, int] = {}
        none = np.empty(0, np.int64)
        self.ids, self.raw, self.inner = Runs(none.astype(np.uint32), none), Runs(none.astype(np.uint8), none), Runs(none, none)

    def add(self, words, ids, raw, segments, parts):
        self.words.update(zip(words, range(len(self.words), len(self.words) + len(words))))
        self.ids, self.raw = self.ids.and_(ids), self.raw.and_(raw)
        self.segments.update(zip(segments, range(len(self.segments), len(self.segments) + len(segments))))
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        places = np.fromiter(map(self.words.__getitem__, chain.from_iterable(parts)), np.int64, int(counts.sum()))
        self.inner = self.inner.and_(Runs(places, counts))


class Runs:
    """Sequences of numbers, one after the other, and the length of each."""

    def __init__(self, flat: np.ndarray, counts: np.ndarray):
        self.flat, self.counts = flat, counts
        self.starts = np.cumsum(counts) - counts

    @classmethod
    def of(cls, arrays: list[np.ndarray]) -> "Runs":
        return cls(np.concatenate(arrays), np.array([len(a) for a in arrays], np.int64))

    @classmethod
    def placed(cls, size: int, parts: list[tuple[np.ndarray, "Runs"]], kind) -> "Runs":
        """Sequences that come in parts, each with the places of its own."""
        counts = np.zeros(size, np.int64)
        for places, runs in parts:
            counts[places] = runs.counts
        made = cls(np.empty(int(counts.sum()), kind), counts)
        for places, runs in parts:
            made.flat[np.repeat(made.starts[places], runs.counts) + steps(runs.counts)] = runs.flat
        return made

    def and_(self, other: "Runs") -> "Runs":
        return Runs(np.concatenate([self.flat, other.flat]), np.concatenate([self.counts, other.counts]))

    def pick(self, places: np.ndarray) -> "Runs":
        counts = self.counts[places]
        return Runs(self.flat[np.repeat(self.starts[places], counts) + steps(counts)], counts)

    def joined(self, places: np.ndarray, owners: np.ndarray, size: int) -> "Runs":
        """The picked sequences of each owner as one; owners are sorted."""
        picked = self.pick(places)
        return Runs(picked.flat, np.bincount(owners, picked.counts, size).astype(np.int64))

    def binary(self) -> pa.Array:
        """As binary values, little-endian."""
        width = self.flat.itemsize
        ends = np.concatenate([[0], np.cumsum(self.counts)]) * width
        data = pa.py_buffer(np.ascontiguousarray(self.flat.astype(self.flat.dtype.newbyteorder("<"), copy=False)))
        return pa.Array.from_buffers(pa.large_binary(), len(self.counts), [None, pa.py_buffer(ends.astype(np.int64)), data])


def steps(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def encode_decode(
    df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, n_tokens, ids, decoded) per row: ids as binary little-endian unsigned 32-bit
    integers, decoded as the bytes that the ids stand for.

    ``ranks`` is the path of a rank file that every executor has, ``pattern`` the public
    byte-level pattern; each of its matches is encoded separately, as if by the library, and
    strings of special tokens are ordinary text. A task handles its rows in slices of a few MB:
    the slice's distinct words are contracted and decoded by DuckDB on one thread, and texts are
    put together from these. Whole texts count, however long; a null text is empty and has no
    ids; repeated rows give repeated rows; an empty table gives none. Other columns are not
    read; there is no shuffle, and a lost task is simply run again.
    """
    def open_task():
        run = Codec(ranks, pattern).texts()

        def rows(texts):
            ids, decoded = run(texts)
            return pa.array(ids.counts), ids.binary(), decoded.binary()
        return rows

    return per_row(
        df, {"id": F.col(id_col), "text": text_of(text_col)},
        "n_tokens long, ids binary, decoded binary", open_task,
    )


def decode(df: DataFrame, ranks: str, pattern: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded) per row of ids in binary; null ids give null. An id that the table of ranks
    does not have stands for nothing."""
    def open_task():
        codec = Codec(ranks, pattern)

        def rows(ids):
            given = [np.frombuffer(i or b"", "<u4") for i in ids]
            flat = codec.decode(Runs.of(given)).binary().cast(pa.binary()).to_pylist()
            return ([None if i is None else raw for i, raw in zip(ids, flat)],)
        return rows

    return per_row(df, {"id": F.col(id_col), "ids": F.col(ids_col)}, "decoded binary", open_task)
