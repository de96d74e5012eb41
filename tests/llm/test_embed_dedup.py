import numpy as np
import pytest

from skygauge.llm import embed_dedup
from skygauge.llm.queries import op1
from tests.llm.test_simhash import slow_groups

TABLES = "/root/testdata/sf0.001"


def slow(rows):
    """All pairs, in double precision."""
    good = {}
    for at, (_, v) in enumerate(rows):
        if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v):
            good[at] = np.array(v, float) / np.linalg.norm(np.array(v, float) / np.abs(v).max()) / np.abs(v).max()
    linked = lambda a, b: len(good[a]) == len(good[b]) and float(good[a] @ good[b]) >= 0.95
    ats = sorted(good)
    counts = {a: sum(linked(a, b) for b in ats if a != b) for a in ats}
    root = slow_groups(ats, linked)
    least = {}
    for at in ats:
        least.setdefault(root[at], []).append(rows[at][0])
    out = []
    for at, (i, _) in enumerate(rows):
        ids = [x for x in least[root[at]] if x is not None] if at in good else [i]
        component = min(ids) if ids else None
        out.append((i, counts.get(at, 0), component, i == component))
    return sorted(out, key=str)


def test_query_agrees_with_all_pairs(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{TABLES}/embeddings.parquet").collect()]
    got = sorted((tuple(r) for r in op1(spark, TABLES).collect()), key=str)
    assert got == slow(rows)


def test_dense_clouds_in_many_blocks_and_chains(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 8)
    rng = np.random.default_rng(7)
    cloud = rng.normal(size=16) + 0.03 * rng.normal(size=(120, 16))
    angles = np.arange(0, 3, 0.25)
    chain = np.stack([np.cos(angles), np.sin(angles), *np.zeros((14, len(angles)))], 1)
    vectors = [*cloud, *chain, *rng.normal(size=(60, 16)), *cloud[:5], *(cloud[:5] * 1e200), *(chain[:3] * 1e-200)]
    rows = [(900 - i, v.tolist()) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, cls int")
    got = sorted((tuple(r) for r in embed_dedup.embedding_dedup(frame, miss=1e-9).collect()), key=str)
    assert got == slow(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (7, [1.0, 0.0]),
            (7, [1.0, -0.0]), (8, [2.0, 0.0]), (None, [1.0, 0.0]), (9, [1.0]), (10, [1.0, 0.0, 0.0]), (None, None), (2, [0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((tuple(r) for r in embed_dedup.embedding_dedup(frame, miss=1e-9).collect()), key=str)
    want = [(1, 0, 1, True), (2, 0, 2, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True),
            (7, 3, 7, True), (7, 3, 7, True), (8, 3, 7, False), (None, 3, 7, False), (9, 0, 9, True), (10, 0, 10, True), (None, 0, None, True)]
    assert got == sorted(want, key=str)
    assert embed_dedup.embedding_dedup(frame.limit(0)).count() == 0


def test_tables_for_sizes():
    for classes in (0, 1, 10**3, 10**6, 10**9):
        bits, tables = embed_dedup.tables_for(classes)
        meet = (1 - np.arccos(0.95) / np.pi) ** bits
        assert (1 - meet) ** tables <= 1e-3 and 1 <= tables < 400


@pytest.mark.parametrize("cosine", [0.95, 0.97])
def test_recall_over_hard_pairs(spark, cosine):
    """Pairs just above the limit, many of them: what brute force finds and the tables find."""
    rng, pairs = np.random.default_rng(11), []
    for i in range(600):
        a, b = rng.normal(size=(2, 64))
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        b /= np.linalg.norm(b)
        c = cosine + 0.002
        pairs += [(2 * i, a.tolist()), (2 * i + 1, (c * a + np.sqrt(1 - c * c) * b).tolist())]
    frame = spark.createDataFrame(pairs, "vec_id long, embedding array<double>")
    found = sum(r.n_links == 1 for r in embed_dedup.embedding_dedup(frame).collect())
    assert found >= 0.99 * len(pairs)
