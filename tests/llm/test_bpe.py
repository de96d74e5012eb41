import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from skygauge.llm import bpe
from skygauge.llm.bpe import decode, encode_decode, read_ranks
from tests.llm.test_token_count import PARTS

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyzäöüéèñ"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 30))) for _ in range(2000)]
    mixed = ["".join(rng.choice(PARTS + words[:20]) for _ in range(rng.randrange(1, 40))) for _ in range(800)]
    long = ["".join(rng.choice(letters) for _ in range(n)) for n in (511, 512, 513, 20000)]
    return ["", None, " ", "a" * 5000, " " * 3000, " ".join(words * 20), *words, *mixed, *long]


def test_ids_and_bytes_are_the_librarys(spark, texts, library):
    frame = spark.createDataFrame([(i, t, b"x") for i, t in enumerate(texts)], "doc_id long, text string, ids binary")
    for row in encode_decode(frame, PATH, PATTERN).collect():
        text = texts[row.id] or ""
        assert np.frombuffer(row.ids, "<u4").tolist() == library.encode_ordinary(text), text[:100]
        assert row.n_tokens * 4 == len(row.ids) and row.decoded == text.encode()


def test_words_by_query_and_by_heap_agree(library):
    codec, rng = bpe.Codec(PATH, PATTERN), random.Random(3)
    words = [bytes(rng.choice(b"aeiouthnsr\xc3\xa9") for _ in range(rng.randrange(1, 200))) for _ in range(400)]
    assert codec._long(b"ab").tolist() == codec.words([b"ab"]).flat.tolist()
    assert bpe.Runs.of([codec._long(w) for w in words]).binary().equals(codec._contract(words).binary())


def test_known_segments_are_dropped_when_many(monkeypatch, library):
    monkeypatch.setattr(bpe, "KEEP", 5)
    run = bpe.Codec(PATH, PATTERN).texts()
    for text in ("one two three", "two three four five", "one one six", "two seven eight nine ten"):
        ids, decoded = run([text])
        assert ids.flat.tolist() == library.encode_ordinary(text) and decoded.flat.tobytes().decode() == text


def test_decode(spark, library):
    ids = [np.array(library.encode_ordinary(t), "<u4").tobytes() for t in ("some text", "", "é\n")]
    rows = list(enumerate([*ids, None, np.array([2**20], "<u4").tobytes()]))
    got = {r.id: r.decoded for r in decode(spark.createDataFrame(rows, "id long, ids binary"), PATH, PATTERN).collect()}
    assert got == {0: b"some text", 1: b"", 2: "é\n".encode(), 3: None, 4: b""}


def test_query_and_odd_tables(spark, tmp_path, library):
    from skygauge.llm.queries import op7

    frame = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    frame.withColumn("n_tokens", F.lit(0)).write.parquet(str(tmp_path / "documents.parquet"))
    sha = hashlib.sha256(np.array(library.encode_ordinary("a b"), "<u4").tobytes()).hexdigest()
    got = [tuple(r) for r in op7(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(
        [(i, 2, sha, hashlib.sha256(b"a b").hexdigest()) for i in (None, 1, 1)]
        + [(2, 0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest())], key=str)
    assert encode_decode(frame.limit(0), PATH, PATTERN).count() == 0
