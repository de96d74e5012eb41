import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skygauge.llm.license_scan import BASE, COMMON, LOOKED_UP, RARE, SHARE, TEMPLATES, scan_licenses
from skygauge.llm.queries import op3

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    "", None, " .,; ", "one", ".MIT License.", "the MIT-License, mit license mit license", "GNU General Public License",
    "général public license", "mit licenseé", "mİt license", "Released under the MIT License. Apache\nlicense",
    "mit LICENSE " * 3000, "general public general public license", "x \x00mit\x7flicense\x1f y", "license mit license",
    "apache", "apache license apache license general public license",
]


def slow(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    places = [(i, label) for phrase, label in BASE.items() for k in [phrase.split()]
              for i in range(len(words)) if words[i:i + len(k)] == k]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), sorted({x for _, x in places})


def test_base_is_that_of_a_plain_scan(spark):
    frame = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, score int")
    got = scan_licenses(frame).collect()
    assert len(got) == len(TEXTS)
    for row in got:
        mine = (row.n_words, row.n_base, row.first_word, row.last_word, list(row.base_labels))
        assert mine == slow(TEXTS[row.id]), TEXTS[row.id]
        assert set(row.base_labels) <= set(row.labels) and 0 <= row.score <= 1


def test_templates_are_found_whole_and_with_gaps_but_not_scattered(spark):
    filler = "the of and in to some other words with no meaning at all "
    rows = [(i, filler * 3 + text.title() + ". " + filler) for i, (_, text, _) in enumerate(TEMPLATES)]
    rows += [(100 + i, " ".join(sorted(text.split()))) for i, (_, text, _) in enumerate(TEMPLATES)]
    rows += [(200, filler * 50), (201, "permission of the general in the public source software is free")]
    got = {r.id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (label, _, _) in enumerate(TEMPLATES):
        assert label in got[i].labels and got[i].score >= 0.5, (label, got[i])
        assert got[100 + i].labels == got[100 + i].base_labels
    assert got[200].labels == got[201].labels == [] and got[200].score == 0


def test_query_and_odd_tables(spark, tmp_path):
    frame = spark.createDataFrame([(1, TEXTS[10]), (1, TEXTS[10]), (None, None)], "doc_id long, text string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    rows = sorted((tuple(r) for r in op3(spark, str(tmp_path)).collect()), key=str)
    assert [r[:6] for r in rows] == [(1, 7, 2, 3, 5, "apache,mit")] * 2 + [(None, 0, 0, None, None, "")]
    assert rows[0][6].split(",") == sorted(set(rows[0][6].split(","))) and rows[2][6] == ""
    assert scan_licenses(frame.where(F.lit(False))).count() == 0


def test_notices_in_one_text_do_not_starve_each_other(spark):
    filler = "the of and in to some other words with no meaning at all "
    many = [("mit", "bsd"), ("isc", "bsd", "zlib"), ("mpl", "bsd"), ("mit", "isc", "bsd", "gpl"), tuple({label for label, _, _ in TEMPLATES})]
    whole = {label: " ".join(t for n, t, _ in TEMPLATES if n == label) for label, _, _ in TEMPLATES}
    rows = [(i, (filler * 200).join(whole[label] + ". " for label in labels)) for i, labels in enumerate(many)]
    # words that are rarer than the notice's own, elsewhere in a long text
    others = "unencumbered mozilla eclipse boost attribution affero creative lesser warranty implied liable damages "
    rows.append((50, others * 20 + filler * 200 + whole["mit"]))
    rows += [(100 + i, whole["mit"]) for i in range(30)]
    got = {r.id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, labels in enumerate(many):
        assert set(labels) <= set(got[i].labels), (labels, got[i].labels)
    assert "mit" in got[50].labels and got[50].score == 1


def slow_labels(texts):
    """Labels and scores of the templates, by trying every template at every place of every text."""
    cut = [WORD.findall(t.lower()) for t in texts]
    templates = [(label, text.split(), [k.split() for k in keys]) for label, text, keys in TEMPLATES]
    spread = Counter(w for _, words, _ in templates for w in set(words))
    anchors = {phrase.split()[0] for phrase in BASE}
    rare = {w for w in spread if spread[w] <= COMMON and len(w) > 1} | anchors
    idf = {w: math.log((len(cut) + 1) / (sum(w in words for words in cut) + 1)) + 1e-9 for w in rare}
    out = []
    for words in cut:
        labels, score = set(), 0.0
        for label, own, keys in templates:
            best = sorted(rare & set(own), key=lambda w: (-idf[w], w))[:LOOKED_UP]
            best = {w for w in best if idf[w] >= RARE * idf[best[0]]}
            whole = sum(idf[w] for w in own if w in best)
            first = [next(i for i in range(len(own)) if own[i:i + len(k)] == k) for k in keys]
            for at in range(-len(own), len(words)):
                got = sum(idf[w] for i, w in enumerate(own) if w in best and 0 <= at + i < len(words) and words[at + i] == w)
                sure = all(at + f >= 0 and words[at + f:at + f + len(k)] == k for f, k in zip(first, keys))
                if sure and got >= SHARE * whole - 1e-12:
                    labels.add(label)
                    score = max(score, min(1.0, got / whole))
        out.append((labels, score))
    return out


def test_labels_and_scores_are_those_of_trying_every_place(spark):
    rng = random.Random(4)
    filler = "the of and in to for by with that it no is software license permission warranty other words".split()
    texts = [" ".join(rng.choices(filler, k=40)) for _ in range(30)]
    for _ in range(60):
        words = rng.choice(TEMPLATES)[1].split() + rng.choices(filler, k=3) + rng.choice(TEMPLATES)[1].split()
        for _ in range(rng.choice((0, 1, 2, 4, 8))):
            words[rng.randrange(len(words))] = rng.choice(filler)
        if rng.random() < 0.3:
            del words[rng.randrange(len(words))]
        texts.append(" ".join(rng.choices(filler, k=rng.randrange(5)) + words))
    got = {r.id: r for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, (labels, score) in enumerate(slow_labels(texts)):
        assert set(got[i].labels) == labels | set(got[i].base_labels), texts[i]
        assert got[i].score == pytest.approx(score), texts[i]
