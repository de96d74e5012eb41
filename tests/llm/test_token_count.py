import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skygauge.llm.token_count import count_tokens

JSON = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [" ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", " ", " ", "　", "​", "\x00", "word", "don't", "'s", "É",
         "naïve", "12", "³", "१२", "日本", "🙂", "é", "<|endoftext|>", "<|endof", "text|>", "$$", "'", "ll", "_", " ", " ", "﻿", "᠎"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    texts = ["", None, " ", "<|endoftext|>", "a  <|endoftext|>  b", "x" * 3000, " " * 500, "long text, " * 40000]
    return texts + ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]


def test_counts_are_the_librarys(spark, texts):
    frame = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens long")
    got = {r.id: r for r in count_tokens(frame, JSON).collect()}
    library = Tokenizer.from_file(JSON)
    for i, text in enumerate(texts):
        n = len(library.encode(text or "", add_special_tokens=False))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((text or "").encode()), n > 512), repr(text)[:200]


def test_piece_model(spark, texts):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    some = texts[:5] + texts[8:200]
    frame = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    got = {r.id: r.n_tokens for r in count_tokens(frame, path).collect()}
    assert got == {i: len(library.encode(t or "")) for i, t in enumerate(some)}


def test_odd_tables(spark):
    frame = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert sorted(r.n_tokens for r in count_tokens(frame, JSON).collect()) == [2, 2, 2]
    assert count_tokens(frame.limit(0), JSON).count() == 0
