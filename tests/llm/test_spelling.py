import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from skygauge.llm import spelling as S

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def slow_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def edits(word, letters):
    """All strings one edit away, by trying each."""
    out = {word[:i] + word[i + 1:] for i in range(len(word))}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    return (out | {word[:i] + c + word[i + 1:] for i in range(len(word)) for c in letters}) - {word}


def slow_pairs(words):
    letters = {c for w in words for c in w}
    return {tuple(sorted((w, e))) for w in words for e in edits(w, letters) if e in words}


def slow_forms(words):
    letters, out = {c for w in words for c in w}, {}
    for w, n in words.items():
        near = sorted(e for e in edits(w, letters) if e in words)
        best = max(near, key=lambda e: words[e], default=None)
        out[w] = best if best and words[best] >= 5 * n else None, len(near)

    def root(w):
        return root(out[w][0]) if out[w][0] else w

    return {(w, f, root(w), words[w], n, words[f] if f else None) for w, (f, n) in out.items()}


def texts(seed, rows):
    rng = random.Random(seed)
    base = ["".join(rng.choices("etaoinsé", k=rng.randrange(5, 10))) for _ in range(120)]
    words = base + [w for b in base for w in rng.sample(sorted(edits(b, "eztÀ÷×")), 6)]
    weights = [rng.choice((1, 3, 15, 80, 400, 2000)) for _ in words]
    return [(i, " ".join(w.capitalize() if rng.random() < 0.1 else w for w in rng.choices(words, weights, k=rng.randrange(60)))) for i in range(rows)]


@pytest.mark.parametrize("subtree", [4, 50, 10 ** 6])
def test_groups_are_those_of_brute_force(spark, subtree):
    rows = texts(1, 1500)
    rows += [(None, rows[3][1]), (7, None), (8, ""), (9, "x" * 40000), rows[5], rows[5], (10, "ÀÀÀÀÀÀ Ààààaa strasse×straße " * 9)]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, word string, n long")
    got = [tuple(r) for r in S.group_spellings(frame, subtree=subtree).collect()]
    want = slow_forms(slow_words(rows))
    assert len(got) == len(want) and set(got) == want
    assert any(f and f != r for _, f, r, *_ in want)  # forms of forms


def test_large_vectors_are_dealt_by_what_words_share(spark):
    rng = random.Random(2)
    words = {"".join(rng.sample("aabbcd", 6)) for _ in range(400)} | {"".join(rng.sample("aabbcde", 7)) for _ in range(400)} | {"".join(rng.sample("aabbdd", 6)) for _ in range(300)}
    words |= {"日本語日本語", "日本語日本", "x" * 300, "x" * 301, "x" * 299 + "y"}
    frame = spark.createDataFrame([(w,) for w in words] * 2 + [(None,)], "word string")
    for subtree in (20, 10 ** 6):
        got = [tuple(sorted(r)) for r in S.near_pairs(frame, subtree=subtree).collect()]
        assert len(got) == len(set(got)) and set(got) == slow_pairs(words)


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert S.group_spellings(frame).count() == 0


def test_one_edit():
    words = ["abc", "abd", "ab", "abcd", "xabc", "acb", "abc", "", "a"]
    for a in words:
        for b in words:
            assert S.one_edit(a, b) == (b in edits(a, "abcdx"))


def test_search_finds_each_pair_from_its_smaller_vector():
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("abcd", k=rng.randrange(3, 6))) for _ in range(300)})
    groups = S.Groups(list("abcd"))
    vectors = [(groups.vector(w), w) for w in words]
    found = []
    for n in range(3, 6):
        trie = S.Trie([v for v in vectors if v[0][0] == n], 1, groups.size)
        for state in (S.BOTH, S.SURPLUS):
            some = [v for v in vectors if (n, state) in S.start(v[0][0])]
            found += trie.near(some, np.full(len(some), state))
    assert len(found) == len(set(found)) and {tuple(sorted(f)) for f in found} == slow_pairs(set(words))
