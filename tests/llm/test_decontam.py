import itertools
import random

import pytest
from pyspark.sql import functions as F

from skygauge.llm.decontam import LEAST, MASKS, drop_contaminated, needed, overlaps, words_of


def slow(docs, items):
    """Compare every stretch of every document and item."""
    rows = set()
    for (d, text), (i, item) in itertools.product(docs, items):
        a, b = words_of(text or ""), words_of(item or "")
        if not b:
            continue
        length, least = needed(len(b))
        best = max(((sum(x == y for x, y in zip(a[p:p + length], b[q:q + length])), -p)
                    for p in range(len(a) - length + 1) for q in range(len(b) - length + 1)), default=(0, 0))
        if best[0] >= least:
            rows.add((d, i, best[0], length, -best[1]))
    return rows


def test_masks_see_every_allowed_stretch():
    for length in range(LEAST, 14):
        stretch, least = needed(length)
        for wrong in itertools.combinations(range(stretch), stretch - least):
            assert any(
                all(c == "0" or at + j not in wrong for j, c in enumerate(mask))
                for mask in MASKS for at in range(stretch - len(mask) + 1)
            )


@pytest.fixture(scope="module")
def data():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["the", "of", "and"] * 10

    def some(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    items = [(i, " ".join(some(rng.randrange(3, 40)))) for i in range(30)]
    items += [(30, None), (31, ""), (32, "the " * 20), (None, " ".join(some(15))), items[9], (9, " ".join(some(20)))]
    docs = []
    for d in range(150):
        words = some(rng.randrange(0, 120))
        if d % 2:
            passage = (rng.choice(items)[1] or "").split()
            cut = rng.randrange(0, max(1, len(passage) - 8))
            passage = passage[cut:cut + rng.randrange(8, 30)]
            for _ in range(rng.randrange(0, 4)):
                if passage:
                    passage[rng.randrange(len(passage))] = "other"
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage
        docs.append((d, " ".join(words).upper() if d % 3 else ", ".join(words) + "."))
    return docs + [(200, None), (201, ""), (202, "the " * 5000), (None, items[20][1])], items


@pytest.mark.parametrize("block_bytes", [1 << 24, 900])
def test_overlaps_are_all_overlaps(spark, data, block_bytes):
    docs, items = data
    frame = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n_equal int")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, id string")
    got = overlaps(frame, bench, block_bytes=block_bytes).collect()
    want = slow(docs, items)
    flat = lambda rows: sorted((tuple(r) for r in rows), key=str)
    once = {(r[0], r[1]) for r in got}
    assert once == {(r[0], r[1]) for r in want} and len(want) > 25
    assert flat(r for r in got if r[1] != 9) == flat(r for r in want if r[1] != 9)
    kept = [r.doc_id for r in drop_contaminated(frame, bench, block_bytes=block_bytes).collect()]
    assert sorted(kept, key=str) == sorted((i for i, _ in docs if i not in {r[0] for r in want}), key=str)


def test_empty_tables_and_repeated_rows(spark, data):
    docs, items = data
    frame = spark.createDataFrame([(1, items[20][1]), (1, items[20][1])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len([r for r in overlaps(frame, bench).collect() if r.item_id == 20]) == 2
    assert overlaps(frame.where(F.lit(False)), bench).count() == 0
    assert overlaps(frame, bench.where(F.lit(False))).count() == 0
    assert drop_contaminated(frame, bench.where(F.lit(False))).count() == 2


@pytest.mark.parametrize("item, hit, miss", [
    ("What is the capital of Peru?", "ask: what is, the CAPITAL of Peru! now", "what was the capital of peru"),
    ("今天的天气非常好我们去公园散步吧。你想一起去吗?", "他说:“今天的天气非常好，我们去公园散步吧。你想一起去吗?”然后走了", "今天的天气不好他们去商店买东西了"),
    ("ตอบคำถามนี้ให้ถูกต้อง", "โปรด ตอบคำถามนี้ให้ถูกต้อง ครับ", "ตอบ"),
    ("Élan vital — naïve", "un élan vital, naïve", "elan vital naive"),
    ("x", "x", "y x1"),
    ("a b c d e f g", "0 a b c d e f g 1", "a b c d e f h"),
])
def test_short_items_and_scripts_without_blanks(spark, item, hit, miss):
    frame = spark.createDataFrame([(1, hit), (2, miss), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [(r.id, r.item_id, r.n_equal == r.n_words) for r in overlaps(frame, bench).collect()] == [(1, 7, True)]
    assert sorted(r.doc_id for r in drop_contaminated(frame, bench).collect()) == [2, 3]


def test_sql_has_short_items_too(spark, tmp_path):
    import duckdb

    from skygauge.llm.queries import ORACLES, QUERIES
    docs = [(1, "What is up, doc? 今天的天气非常好我们去公园散步吧"), (2, "one two three four five six seven eight nine"), (3, None), (4, "naïve—ÉLAN")]
    items = [(1, "what is up"), (2, "今天的天气非常好我们去公园散步"), (3, "two three FOUR five six seven eight nine"), (4, "élan"), (5, ""), (6, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    columns = ["doc_id", "item_id", "n_equal", "n_words", "first_word"]
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES['op10_decontamination']})").fetchall()
    got = [tuple(r) for r in QUERIES["op10_decontamination"](spark, str(tmp_path)).select(columns).collect()]
    assert sorted(got) == sorted(want) and len(got) == 4
