import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skygauge.llm import lang_id
from skygauge.llm.queries import op9

TABLES = "/root/testdata/sf0.001"


def slow_path(scores, penalty):
    """Dynamic programming word by word."""
    total, back = scores[0].copy(), []
    for row in scores[1:]:
        moves = total[:, None] - penalty * (1 - np.eye(len(row)))
        back.append(moves.argmax(0))
        total = moves.max(0) + row
    return total.max()


def value(scores, path, penalty):
    return scores[np.arange(len(path)), path].sum() - penalty * (np.diff(path) != 0).sum()


def test_paths_are_best():
    rng = np.random.default_rng(1)
    lengths = np.array([0, 1, 5, 31, 32, 33, 64, 65, 200, 0, 1000])
    scores = np.round(rng.normal(size=(lengths.sum(), 3)) * 3, 3)
    scores[200:300, 1] += 2
    path = lang_id.viterbi(scores, lengths, 4.0)
    for length, end in zip(lengths, np.cumsum(lengths)):
        if length:
            part = slice(end - length, end)
            assert value(scores[part], path[part], 4.0) == pytest.approx(slow_path(scores[part], 4.0))
    few = np.round(rng.normal(size=(6, 3)), 3)
    best = max(value(few, np.array(p), 1.0) for p in itertools.product(range(3), repeat=6))
    assert value(few, lang_id.viterbi(few, np.array([6]), 1.0), 1.0) == pytest.approx(best)


@pytest.fixture(scope="module")
def found(spark):
    return {r.doc_id: r for r in op9(spark, TABLES).collect()}


def test_held_out_accuracy(spark, found):
    rows = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "lang", "text").collect()
    assert len(rows) == len(found)
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert {r.doc_id for r in held} == {i for i, r in found.items() if r.held_out}
    assert sum(found[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)


def test_mixed_texts_scripts_and_odd_rows(spark, tmp_path):
    latin = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text", "lang", "source")
    greek = [(10**6 + i, "και το είναι στην από για με " * 9, "el", "") for i in range(30)]
    table = latin.unionByName(spark.createDataFrame(greek, latin.schema)).withColumn("score", F.lit("x"))
    model = lang_id.train(table)
    by = {r.lang: r.text for r in latin.where(F.length("text") > 1500).collect()}
    mixed = by["de"][:700] + " " + by["fr"][:600] + " και το είναι στην από για με " + by["de"][700:900]
    odd = [(1, mixed, "en"), (2, None, "en"), (3, "", None), (4, "123 ... ²½ !!", "en"), (5, "και το", None), (5, "και το", None),
           (None, by["es"][:400], None), (6, by["de"] * 300, "zz"), (7, "ж", None), (8, "x", None)]
    frame = spark.createDataFrame(odd, "doc_id long, text string, lang string").withColumn("spans", F.lit(0))
    rows = lang_id.label_languages(frame, model).collect()
    got = {r.id: r for r in rows}
    assert len(rows) == len(odd)
    assert [s.lang for s in got[1].spans] == ["de", "fr", "el", "de"] and got[1].lang_pred == "de" and 0.4 < got[1].score < 0.8
    assert [s.n_words for s in got[1].spans][2] == 7
    for i in (2, 3, 4):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[5].lang_pred == "el" and got[None].lang_pred == "es" and got[6].lang_pred == "de" and got[7].lang_pred != "und"
    kept = lang_id.keep_identified(frame, model)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "5", "5", "None", "6", "7", "8"])
    assert lang_id.label_languages(frame.limit(0), model).count() == 0
    nothing = lang_id.train(table.limit(0))
    assert {r.lang_pred for r in lang_id.label_languages(frame, nothing).collect()} == {"und"}


def test_texts_in_scripts_of_no_learned_language_go(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text", "lang")
    model = lang_id.train(docs)
    english = docs.where("lang = 'en' and length(text) > 500").first().text[:300]
    planted = [(1, "это текст на языке, которого модель не знает", None), (2, "这是一个模型不认识的语言的文本", "en"), (3, "да", None),
               (4, english + " это слово", None), (5, "α", None), (6, english, None), (7, "это " * 200 + english, "en")]
    kept = lang_id.keep_identified(spark.createDataFrame(planted, "doc_id long, text string, lang string"), model).collect()
    assert sorted(r.doc_id for r in kept) == [4, 5, 6]
    assert lang_id.keep_identified(docs, model).count() == docs.where("text rlike '[A-Za-z]'").count()


def test_gibberish_and_other_languages_of_a_learned_script_go(spark):
    rng = random.Random(1)
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text", "lang")
    model = lang_id.train(docs)

    def words(letters):
        return " ".join("".join(rng.choices(letters, k=rng.randrange(3, 10))) for _ in range(60))

    planted = [(i, words("bcdfghjklmnpqrstvwxz"), "en") for i in range(50)] + [(50 + i, words("abcdefghijklmnopqrstuvwxyz"), None) for i in range(50)]
    planted += [(100, "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan", "en"),
                (101, "To be or not to be, that is the question: whether tis nobler in the mind to suffer", None),
                (102, "All rights reserved.", None), (103, "zxq bvw", None)]
    kept = lang_id.keep_identified(spark.createDataFrame(planted, "doc_id long, text string, lang string"), model).collect()
    assert sorted(r.doc_id for r in kept) == [101, 102, 103]
