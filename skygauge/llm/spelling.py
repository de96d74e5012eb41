"""Spelling variants: words one edit apart, found by depth-first search in tries of letter counts."""

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygauge.llm.common import settle

#: Runs of letters, shortest word in code points, least number of its occurrences, by how much a form is more frequent.
RUN, SHORTEST, LEAST, TIMES = r"[A-Za-zÀ-ÿ]", 6, 5, 5
#: One run in so many, by crc32 of "id:run", loses a letter.
NOISE = 199
#: Letters with a group of their own; groups that the others share, by code point; words of a subtree that
#: one task holds, and subtrees at most at each depth; words of a leaf.
LETTERS, SHARED, SUBTREE, SUBTREES, LEAF = 60, 4, 4096, 1 << 14, 16
_SMALL, _CAPITAL = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def count_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int | None = NOISE) -> DataFrame:
    """(word, n): how often each word of SHORTEST code points or more is in all whole texts, LEAST times or more.

    A word is a maximal run of RUN with A-Z as a-z; where ``noise`` divides the crc32 h of "id:run", its
    code point h % length is left out. Counts combine in the tasks before their shuffle, so a
    frequent word sends one row per task. A null text has no words, a null id is written as nothing.
    """
    lowered = F.translate(F.col(text_col).cast("string"), _CAPITAL, _SMALL)
    runs = F.regexp_extract_all(lowered, F.lit(RUN + "{%d,}" % SHORTEST), F.lit(0))
    word = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    if noise:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        at = (h % F.length("run")).cast("int")
        less = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
        word = word.select(F.when(h % noise == 0, less).otherwise(F.col("run")).alias("word"))
    else:
        word = word.select(F.col("run").alias("word"))
    return word.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= LEAST) & (F.length("word") >= SHORTEST))


class Groups:
    """The letter groups in the order of the trie: all letters, then the most frequent one first, the rest last."""

    def __init__(self, letters: list[str]):
        alone = letters[:LETTERS]
        self.size = 1 + len(alone) + SHARED
        self.place = {c: 1 + i for i, c in enumerate(alone)}

    def vector(self, word: str) -> bytes:
        """How many letters of each group a word has, trailing zeros left out; counts end at 255.

        Counts of words one edit apart differ by one at most, and so do those that end at 255. Longer
        words than that are all of length 255 here, and search with one surplus and one deficit.
        """
        counts = [0] * self.size
        counts[0] = len(word)
        for c in word:
            counts[self.place.get(c) or self.size - 1 - ord(c) % SHARED] += 1
        return bytes(n if n < 255 else 255 for n in counts).rstrip(b"\0")


def at(vector: bytes, level: int) -> int:
    return vector[level] if level < len(vector) else 0


def one_edit(a: str, b: str) -> bool:
    """Whether one code point inserted, deleted or replaced turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    for x, y in zip(a, b):
        if x != y:
            break
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


#: What a search has left: a surplus and a deficit, a surplus, a deficit (its surplus spent), nothing.
BOTH, SURPLUS, DEFICIT, NOTHING = range(4)


def steps(count: int, state: int) -> tuple:
    """(count, what is left) of the children that a word with ``count`` at this level visits.

    Each pair of words is looked for from the smaller vector, so a surplus is spent first.
    """
    own = (count, state)
    if state < DEFICIT:
        return own, (count + 1, state + 2)
    return (own, (count - 1, NOTHING)) if state == DEFICIT and count else (own,)


def start(size: int) -> tuple:
    """The first level is the group of all letters: a replaced letter keeps their number and is one
    surplus and one deficit, an inserted one raises it and is one surplus."""
    return ((size, BOTH), (size + 1, SURPLUS)) if size < 255 else ((size, BOTH),)


class Trie:
    """Words by successive counts of their vectors, from a level on; leaves hold LEAF words or equal vectors.

    Many words search together: each step of the depth-first search takes those whose budget reaches a child.
    """

    def __init__(self, words: list[tuple[bytes, str]], level: int, size: int):
        self.words, self.level, self.size = words, level, size
        self.counts, self.ends = _matrix([vector for vector, _ in words], size), _ends([word for _, word in words])
        self.root = self._grow(np.arange(len(words)), level)

    def _grow(self, members: np.ndarray, level: int):
        if len(members) <= LEAF or level >= self.size:
            return members
        counts = self.counts[members, level]
        return {int(c): self._grow(members[counts == c], level + 1) for c in np.unique(counts)}

    def near(self, words: list[tuple[bytes, str]], states: np.ndarray) -> Iterator[tuple[str, str]]:
        """(word, other) for all words of the trie after one of ``words`` (by vector, then word) that are one edit away.

        ``states`` says what a word has left: 0 a surplus and a deficit, 1 a surplus, 2 a deficit, 3 nothing.
        """
        counts, ends = _matrix([vector for vector, _ in words], self.size), _ends([word for _, word in words])
        stack = [(self.root, self.level, np.arange(len(words)), states)]
        while stack:
            node, level, own, state = stack.pop()
            if not isinstance(node, dict):
                yield from self._verified(node, words, counts, ends, own)
                continue
            for count, child in node.items():
                more = count - counts[own, level]
                here = (more == 0) | (more == 1) & (state < 2) | (more == -1) & (state == 2)
                if here.any():
                    more, left = more[here], state[here]
                    stack.append((child, level + 1, own[here], np.where(more == 0, left, np.where(more == 1, left + 2, 3))))

    def _verified(self, members, words, counts, ends, own, block: int = 4096):
        """One edit leaves the first or the last letters as they are, and changes two counts at most."""
        for some in np.split(own, range(block, len(own), block)):
            same = (self.ends[members][None] == ends[some][:, None]).any(2)
            i, k = np.nonzero(same | (ends[some, 0] == 0)[:, None])
            i, k = some[i], members[k]
            more = self.counts[k, 1:] - counts[i, 1:]
            fits = (np.maximum(more, 0).sum(1) <= 1) & (np.maximum(-more, 0).sum(1) <= 1)
            for x, y in zip(i[fits], k[fits]):
                word, other = words[x], self.words[y]
                if word < other and one_edit(word[1], other[1]):
                    yield word[1], other[1]


def _ends(words: list[str]) -> np.ndarray:
    """The first and the last three letters of each word as numbers; 0 for words shorter than six."""
    long = [w if len(w) >= 6 else "\0" * 6 for w in words]
    codes = np.array([[*map(ord, w[:3]), *map(ord, w[-3:])] for w in long], np.int64).reshape(-1, 2, 3)
    return codes[..., 0] << 42 | codes[..., 1] << 21 | codes[..., 2]


def _matrix(vectors: list[bytes], size: int) -> np.ndarray:
    packed = b"".join(v.ljust(size, b"\0") for v in vectors)
    return np.frombuffer(packed, np.uint8).reshape(len(vectors), size).astype(np.int16)


def _variants(word: str) -> Iterator[str]:
    """What two words of one edit have in common: a place left open, or the longer one without a letter."""
    yield word
    for i in range(len(word)):
        yield f"{word[:i]}\0{word[i + 1:]}"
        yield word[:i] + word[i + 1:]


class Splitter:
    """Which subtrees hold a word and which ones it visits. ``large`` are the prefixes of too many words."""

    def __init__(self, groups: Groups, large: Iterable[bytes]):
        self.groups, self.large = groups, frozenset(large)

    def home(self, vector: bytes) -> tuple[bytes, bool]:
        """The subtree's prefix, and whether it is a single vector of too many words."""
        padded = vector.ljust(self.groups.size, b"\0")
        for depth in range(1, self.groups.size + 1):
            if padded[:depth] not in self.large:
                return padded[:depth], False
        return padded, True

    def visits(self, vector: bytes) -> Iterator[tuple]:
        """(prefix, what is left, is a single large vector) of all subtrees within the budget."""
        stack = [(bytes([count]), left) for count, left in start(vector[0])]
        while stack:
            prefix, left = stack.pop()
            if prefix not in self.large or len(prefix) == self.groups.size:
                yield prefix, left, prefix in self.large
            else:
                stack += [(prefix + bytes([count]), rest) for count, rest in steps(at(vector, len(prefix)), left) if count < 256]


def _large_prefixes(words: DataFrame, groups: Groups, limit: int, depths: int = 8) -> set[bytes]:
    """Prefixes of vectors that more than ``limit`` words have; ``depths`` levels are counted at a time, from
    the second time on for the words below large prefixes only."""
    large: set[bytes] = set()
    for depth in range(0, groups.size, depths):
        known, last = frozenset(large), min(depth + depths, groups.size)

        def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                seen = defaultdict(int)
                for word in batch.column(0).to_pylist():
                    vector = groups.vector(word).ljust(groups.size, b"\0")
                    if not depth or vector[:depth] in known:
                        for end in range(depth + 1, last + 1):
                            seen[vector[:end]] += 1
                yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["prefix", "n"])

        counted = words.mapInArrow(prefixes, "prefix binary, n long").groupBy("prefix").agg(F.sum("n").alias("n"))
        new = {bytes(r.prefix) for r in counted.where(F.col("n") > limit).collect()}
        large |= new
        if not any(len(p) == last for p in new):
            break
    return large


_ROW = "node binary, visits boolean, word string, vector binary, left byte, variant string"


def near_pairs(words: DataFrame, subtree: int = SUBTREE) -> DataFrame:
    """(a, b): the distinct strings of ``words`` (word) that are one inserted, deleted or replaced code point apart, once.

    Words are arranged in a trie by the number of their letters, then by how many they have of
    each letter, frequent letters first. The trie is cut into subtrees of at most ``subtree`` words (or
    SUBTREES at a depth): counts of all prefixes show where, and only the prefixes of more words
    than that are collected. A word is dealt to its own subtree and visits those within its budget:
    one surplus and one deficit for a replaced letter, one surplus for an inserted one. In a subtree
    a depth-first search spends what is left, and the words of the leaves are verified. A
    vector with more words than a subtree may hold is dealt by what words of one edit share
    instead, so no group of anagrams meets in one task.
    """
    words = words.select("word").where("word is not null").distinct()
    letters = [r.c for r in words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").groupBy("c").count().orderBy(F.desc("count"), "c").limit(LETTERS).collect()]
    groups = Groups(letters)
    limit = max(subtree, words.count() // SUBTREES)

    splitter = Splitter(groups, _large_prefixes(words, groups, limit))
    sent = words.sparkSession.sparkContext.broadcast(splitter)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for some in range(0, batch.num_rows, 2000):
                rows = []
                for word in batch.column(0).slice(some, 2000).to_pylist():
                    vector = known.groups.vector(word)
                    home, large = known.home(vector)
                    spread = _variants(word) if large else [None]
                    rows += [(home + _part(v), False, word, vector, BOTH, v) for v in spread]
                    for prefix, left, large in known.visits(vector):
                        for v in _variants(word) if large else [None]:
                            rows.append((prefix + _part(v), True, word, vector, left, v))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held, known, size = None, [], None, sent.value.groups.size
        for batch in batches:
            found, columns = [], [c.to_pylist() for c in batch.columns]
            ends = [i + 1 for i in range(batch.num_rows - 1) if columns[0][i] != columns[0][i + 1] or columns[1][i] != columns[1][i + 1]]
            for begin, end in zip([0, *ends], [*ends, batch.num_rows]):
                own, visits, words, vectors, left, variants = (c[begin:end] for c in columns)
                if own[0] != node:
                    node, held, known = own[0], [], None
                rows = list(zip(vectors, words))
                if not visits[0]:
                    held += zip(rows, variants)
                elif held and variants[0] is not None:
                    known = known or _shared(held)
                    found += {(w[1], o[1]) for w, v in zip(rows, variants) for o in known.get(v, ()) if w < o and one_edit(w[1], o[1])}
                elif held:
                    known = known or Trie([row for row, _ in held], len(node), size)
                    found += known.near(rows, np.array(left, np.int8))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in (0, 1)], names=["a", "b"])

    dealt = words.mapInArrow(deal, _ROW).repartition("node").sortWithinPartitions("node", "visits")
    pairs = dealt.mapInArrow(search, "a string, b string")
    return pairs.distinct() if any(len(p) == groups.size for p in splitter.large) else pairs


def _part(variant: str | None) -> bytes:
    """Where rows of one large vector go; two words of one edit share a variant and so a place."""
    return b"" if variant is None else zlib.crc32(variant.encode()).to_bytes(4, "big")


def _shared(held: list) -> dict:
    known = defaultdict(list)
    for row, variant in held:
        known[variant].append(row)
    return known


_NAMES = [c.split()[0] for c in _ROW.split(", ")]
_TYPES = [pa.binary(), pa.bool_(), pa.string(), pa.binary(), pa.int8(), pa.string()]


def variant_forms(words: DataFrame, pairs: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the most frequent near word of each of ``words`` (word, n), if it has
    ``times`` the word's n (of equal ones the smallest in code-point order), and the end of the forms from there.

    A form has ``times`` its word's n, so forms are followed in as few doublings as the largest n has
    powers of ``times``.
    """
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    named = words.select(F.col("word").alias("b"), F.col("n").alias("form_n"))
    near = both.join(named.hint("merge"), "b").groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), F.col("b").alias("form"))).alias("best"))
    told = words.join(near.hint("merge"), "word", "left")
    is_form = F.coalesce(-F.col("best.less") >= times * F.col("n"), F.lit(False))
    out = settle(told.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    bounds = out.agg(F.max("n").alias("high"), F.min("n").alias("low")).first()
    hops, reach = 0, max(1, bounds.low or 1)
    while reach * times <= (bounds.high or 0):
        hops, reach = hops + 1, reach * times
    roots = out.where("form is not null").select("word", F.col("form").alias("root"))
    done = 1
    while done < hops:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = settle(roots.join(on.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root")))
        done *= 2
    found = out.join(roots.hint("merge"), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_spellings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int | None = NOISE, subtree: int = SUBTREE) -> DataFrame:
    """``variant_forms`` of the words of all whole texts of ``df``.

    Null and empty texts have no words, repeated rows count each time, an empty table gives no rows; other
    columns are not read. A long text is a row of words before it is counted.
    """
    words = settle(count_words(df, id_col, text_col, noise))
    return variant_forms(words, near_pairs(words, subtree))
