import math
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from skygauge.llm import lm_score
from skygauge.llm.queries import op8
from skygauge.sources import shared

TABLES = "/root/testdata/sf0.001"


def slow(texts, chosen, vocabulary):
    """The same models word by word, with exact counts of pairs."""
    cut = [lm_score.words_of(t or "") for t in texts]
    every = Counter(w for words in cut for w in words)
    step = lambda n: math.floor(8 * math.log2(n))
    by_step = Counter(step(n) for n in every.values())
    known, taken = set(), 0
    for s in sorted(by_step, reverse=True):
        if taken + by_step[s] > vocabulary:
            break
        taken += by_step[s]
        known |= {w for w, n in every.items() if step(n) == s}
    cut = [["<s>"] + [w if w in known else "<unk>" for w in words] for words in cut]
    models = []
    for rows in (cut, [c for c, t in zip(cut, chosen) if t]):
        models.append((Counter(w for c in rows if len(c) > 1 for w in c), Counter(p for c in rows for p in zip(c, c[1:]))))
    out = []
    for words in cut:
        losses = []
        for single, pairs in models:
            whole = sum(n for w, n in single.items() if w != "<s>") + lm_score.EXTRA * (len(known) + 1)
            loss = [-math.log((pairs[v, w] + lm_score.BACKOFF * (single[w] + lm_score.EXTRA) / whole)
                              / (max(single[v], pairs[v, w]) + lm_score.BACKOFF)) for v, w in zip(words, words[1:])]
            losses.append(sum(loss) / len(loss) if loss else None)
        out.append((len(words) - 1, *losses))
    return out


@pytest.mark.parametrize("vocabulary", [10, 150, 1 << 16])
def test_losses_are_those_of_exact_counts(spark, vocabulary):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.5, rng.integers(0, 80)) % 200) for _ in range(120)]
    texts += ["", None, "... !!", "One ONE one", "x " * 5000]
    rows = [(i, t, 0) for i, t in enumerate(texts)]
    chosen = [i % 3 == 0 for i in range(len(texts))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score int")
    ids = spark.createDataFrame([(i,) for i, c in enumerate(chosen) if c] + [(0,), (None,), (10**9,)], "doc_id long")
    got = {r.id: r for r in lm_score.cross_entropy_difference(frame, ids, vocabulary=vocabulary).collect()}
    assert len(got) == len(texts)
    for i, (n, background, target) in enumerate(slow(texts, chosen, vocabulary)):
        assert got[i].n_words == n
        if n:
            assert got[i].loss_background == pytest.approx(background, abs=1e-6)
            assert got[i].loss_target == pytest.approx(target, abs=1e-6)
            assert got[i].score == pytest.approx(got[i].loss_background - got[i].loss_target)
        else:
            assert (got[i].loss_background, got[i].score) == (None, 0.0)


def test_scores_tell_held_out_good_documents(spark):
    """Fitted without a fifth of the labels, the score still ranks good above bad there."""
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    labels = spark.read.parquet(f"{TABLES}/labels.parquet").collect()
    seen = [(r.doc_id,) for r in labels if r.quality == 1 and not r.toxic and r.doc_id % 5]
    scored = lm_score.cross_entropy_difference(docs, spark.createDataFrame(seen, "doc_id long"))
    got = {r.id: r.score for r in scored.collect()}
    held = [(got[r.doc_id], r.quality) for r in labels if r.doc_id % 5 == 0]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) > 0.6 * len(good) * len(bad)


def test_query_and_odd_tables(spark, tmp_path):
    rows = op8(spark, TABLES)
    assert rows.count() == spark.read.parquet(f"{TABLES}/documents.parquet").count()
    frame = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    got = lm_score.cross_entropy_difference(frame, none).collect()
    assert len(got) == 3 and len({r.score for r in got}) == 1
    assert lm_score.cross_entropy_difference(frame.where(F.lit(False)), none).count() == 0


def test_a_vocabulary_beyond_any_fixed_size_has_exact_counts(spark, monkeypatch):
    """More words and pairs than the models once held, most of them joined instead of sent."""
    monkeypatch.setattr(lm_score, "HOT_WORDS", 50)
    monkeypatch.setattr(lm_score, "HOT_PAIRS", 50)
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{int(x)}" for x in rng.integers(0, 90_000, 4000)) for _ in range(120)]
    texts += [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 500) % 90_000) for _ in range(20)] + ["", None, "once " * 9]
    chosen = [i % 3 == 0 for i in range(len(texts))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i, c in enumerate(chosen) if c], "doc_id long")
    got = {r.id: r for r in lm_score.cross_entropy_difference(frame, ids).collect()}
    assert len(got) == len(texts)
    for i, (n, background, target) in enumerate(slow_by_count(texts, chosen, lm_score.LEAST)):
        assert got[i].n_words == n
        if n:
            assert got[i].loss_background == pytest.approx(background, abs=1e-6)
            assert got[i].loss_target == pytest.approx(target, abs=1e-6)


def slow_by_count(texts, chosen, least):
    """``slow`` with the words that are seen ``least`` times."""
    cut = [lm_score.words_of(t or "") for t in texts]
    every = Counter(w for words in cut for w in words)
    known = {w for w, n in every.items() if n >= least}
    assert len(known) > 1 << 16
    cut = [["<s>"] + [w if w in known else "<unk>" for w in words] for words in cut]
    models = []
    for rows in (cut, [c for c, t in zip(cut, chosen) if t]):
        models.append((Counter(w for c in rows if len(c) > 1 for w in c), Counter(p for c in rows for p in zip(c, c[1:]))))
    wholes = [sum(n for w, n in single.items() if w != "<s>") + lm_score.EXTRA * (len(known) + 1) for single, _ in models]
    for words in cut:
        losses = []
        for (single, pairs), whole in zip(models, wholes):
            loss = [-math.log((pairs[v, w] + lm_score.BACKOFF * (single[w] + lm_score.EXTRA) / whole)
                              / (max(single[v], pairs[v, w]) + lm_score.BACKOFF)) for v, w in zip(words, words[1:])]
            losses.append(sum(loss) / len(loss) if loss else None)
        yield len(words) - 1, *losses


def test_what_is_written_is_packed(spark):
    """Texts of random pairs of words: what is put on shared storage is smaller than the texts, ids of any kind mark them."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)}" for x in rng.integers(0, 20_000, 2000)) for _ in range(150)]
    frame = spark.createDataFrame([(f"id {i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    ids = spark.createDataFrame([(f"id {i}",) for i in range(0, 150, 2)], "doc_id string")
    folder = Path(shared._scratch(spark).removeprefix("file:"))
    before = set(folder.glob("lm-*"))
    rows = lm_score.cross_entropy_difference(frame, ids).collect()
    made = [f for d in set(folder.glob("lm-*")) - before for f in d.rglob("*.parquet")]
    assert made and sum(f.stat().st_size for f in made) < 0.8 * sum(map(len, texts))
    assert len(rows) == 150 and all((r.score > 0) == (int(r.id[3:]) % 2 == 0) for r in rows)
