import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from skygauge.llm import fill_middle as M

ALPHABET = ["a", "B", "word", " ", "\n", "<", ">", "P", "<P>", "<S", "M>", "é", "日", "🙂", "1", "\x00", "½"]


def slowly(doc_id, text):
    """The contract, word for word."""
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, digest = len(tokens), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    parts = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    form, output = ("spm", f"<S>{parts[2]}<P>{parts[0]}<M>{parts[1]}") if h4 % 100 < 20 else ("psm", f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}")
    return n, form, len(parts[0]), len(parts[1]), output


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def test_rows_are_the_contracts(spark):
    rng = random.Random(3)
    texts = [None, "", " ", "x", "<P> in a text", "ab<M>", "long words and more, é日🙂 " * 60000]
    texts += ["".join(rng.choices(ALPHABET, k=rng.randrange(1, 60))) for _ in range(1500)]
    rows = [(i if i % 50 else None, t, "clash", "clash") for i, t in enumerate(texts)] + [(7, texts[7], "a", "b")] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string, id string, output string")
    made = M.fill_in_middle(frame)
    got = [(str(r.id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.output_sha256, r.restored_sha256) for r in made.collect()]
    want = [(str(i), *(s := slowly(i, t)), sha(s[4]), sha(t)) for i, t, _, _ in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert sorted(r.text for r in M.restore_texts(made).collect()) == sorted(t or "" for _, t, _, _ in rows)
    digests = M.fill_in_middle(frame, outputs=False)
    assert "output" not in digests.columns
    assert sorted(r.output_sha256 for r in digests.collect()) == sorted(w[6] for w in want)


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert M.fill_in_middle(frame).count() == 0 and M.restore_texts(M.fill_in_middle(frame)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join), st.integers(0, 10 ** 6))
def test_round_trip_and_cuts(text, doc_id):
    draw = hashlib.sha256(str(doc_id).encode()).hexdigest()
    n, form, *_, table = M.transform(text.encode(), draw, 100, 50)
    assert M.restore(table.bytes(), form).bytes().decode() == text
    assert table.sha256() == hashlib.sha256(table.bytes()).hexdigest()
    assert n == len(re.findall("[A-Za-z]+|[^A-Za-z]", text))


def test_cutting_splits_descriptors_and_copies_nothing():
    text = b"some text"
    table = M.PieceTable.of(text).cut([4, 4, 9])
    assert table.pieces == [(text, 0, 4), (text, 4, 4), (text, 4, 9), (text, 9, 9)]
    assert all(p[0] is text for p in table.arrange((2, 0, 1)).pieces)
    assert table.led_by([b"<"] * 4).bytes() == b"<some<< text<"
