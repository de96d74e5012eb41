import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skygauge.llm.components import components
from skygauge.llm.simhash import code_links, fingerprint, simhash_dedup


def slow_print(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[i + 1:]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


TEXTS = ["", None, " \n\t", "One", "two words", "a b c", "a b c d", "A B C D", "é É x y z",
         "word " * 70000, "same same same same", "x\x1cy z\x85w q"]


def test_fingerprint_is_the_definition():
    for text in TEXTS:
        assert fingerprint(text or "") == slow_print(text)


def test_spark_hash_agrees(spark):
    row = spark.sql("select xxhash64('a b c') as h").first()
    assert row.h & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("count,spread", [(300, 6), (4000, 12), (3000, 64)])
def test_links_connect_what_all_pairs_connect(spark, count, spread):
    """Codes in a narrow cloud (many leaves below one pattern), and codes at random."""
    rng = np.random.default_rng(count)
    base = rng.integers(0, 2**63, dtype=np.uint64)
    places = rng.choice(64, spread, replace=False).astype(np.uint64)
    flips = (rng.random((count, spread)) < (0.5 if spread < 64 else 0.02)).astype(np.uint64)
    codes = np.unique(base ^ (flips << places).sum(1, dtype=np.uint64))
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 2
    label = np.arange(len(codes))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    frame = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "code long")
    links = code_links(frame, 2)
    pairs = {(r.a, r.b) for r in links.collect()}
    signed = codes.view(np.int64)
    place = {int(c): i for i, c in enumerate(signed)}
    assert all(near[place[a], place[b]] or label[place[a]] == label[place[b]] for a, b in pairs)
    roots = {r.node: r.root for r in components(links).collect()}
    mine = [roots.get(int(c), int(c)) for c in signed]
    assert len(set(zip(mine, label.tolist()))) == len(set(mine)) == len(set(label.tolist()))


def test_components_of_chains_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(200, 300)] + [(5, i) for i in range(1000, 1100)] + [(7, 7), (9, None)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 200 for i in range(200, 301)} | {i: 5 for i in range(1000, 1100)} | {5: 5}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dedup_agrees_with_brute_force(spark):
    words = [f"w{i}" for i in range(400)]
    texts = {i: t for i, t in enumerate(TEXTS)}
    texts |= {100 + i: " ".join(words[:i] + ["changed"] + words[i + 1:]) for i in range(0, 400, 40)}
    texts |= {200 + i: " ".join(words) for i in range(5)}
    frame = spark.createDataFrame([(i, t, i, 0) for i, t in texts.items()], "doc_id long, text string, fp long, component_id long")
    got = {r.id: (r.fingerprint, r.component_id) for r in simhash_dedup(frame).collect()}
    prints = {i: slow_print(t) for i, t in texts.items()}
    groups = slow_groups(sorted(texts), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert got == {i: (f"{prints[i]:016x}", groups[i]) for i in texts}


def test_odd_ids(spark):
    frame = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c"), (None, "q r s")], "doc_id long, text string")
    got = sorted((str(r.id), str(r.component_id)) for r in simhash_dedup(frame).collect())
    assert got == [("3", "3"), ("3", "3"), ("None", "3"), ("None", "None")]
    assert simhash_dedup(frame.where(F.lit(False))).count() == 0
