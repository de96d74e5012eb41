import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from skygauge.llm import mixing as M


def level_targets(sizes, weights, total):
    """Sources above their cap leave the excess to the others, until none is above."""
    caps, open_, targets = {s: 2 * n for s, n in sizes.items()}, set(sizes), {}
    while open_:
        left = total - sum(targets.values())
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > caps[s]}
        if not above:
            return targets | share
        targets |= {s: caps[s] for s in above}
        open_ -= above
    return targets


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "a", "é", "z", None, "tiny" if i % 97 == 0 else "b"]), " ".join(["w"] * rng.randrange(0, 60))) for i in range(700)]
    rows += [(9000, "b", "same words here")] * 300 + [(None, "z", "no id"), (9001, "a", None), (9002, "a", "\t\n "), (9003, "é", "long " * 9000), (5, "b", "clash of ids")]
    return rows


@pytest.fixture(scope="module")
def mixed(spark, rows):
    frame = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], "doc_id long, source string, text string, size long, slot long, id long")
    out = M.mix(frame.repartition(7), block_words=16)
    return frame, [part.collect() for part in out], out


def name(r):
    return None if r.no_source else r.source


def test_targets_are_shared_by_level(rows, mixed):
    sizes = Counter()
    for _, source, text in rows:
        sizes[source] += len((text or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = level_targets(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    got = {name(r): r.target for r in mixed[1][2]}
    assert got == pytest.approx(want) and sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert any(want[s] == 2 * sizes[s] for s in sizes) and any(want[s] < 2 * sizes[s] for s in sizes)
    taken = Counter()
    for r in mixed[1][1]:
        taken[name(r)] += r.n_words
    assert taken == {s: round(t) for s, t in want.items()}


def test_spans_are_equal_blocks_of_whole_shuffled_passes(rows, mixed):
    _, (all_rows, spans, sources), _ = mixed
    assert len(all_rows) == len(rows)
    assert len({(r.source, r.no_source, r.id, r.digest, r.copy) for r in all_rows}) == len(rows)
    size = {(r.no_source, r.source, r.id, r.digest, r.copy): r.size for r in all_rows}
    by_slot, by_row = defaultdict(list), defaultdict(Counter)
    for r in spans:
        by_slot[r.slot].append(r)
        for word in range(r.first_word, r.first_word + r.n_words):
            by_row[r.no_source, r.source, r.id, r.digest, r.copy][word] += 1
    short = 0
    for pieces in by_slot.values():
        pieces.sort(key=lambda r: r.place)
        assert len({(r.no_source, r.source) for r in pieces}) == 1
        ends = [r.place + r.n_words for r in pieces]
        assert [r.place for r in pieces] == [0, *ends[:-1]]
        short += ends[-1] != 16
    assert short <= len(sources) and len(by_slot) == sum(r.blocks for r in sources)
    passes = {name(r): r.target / r.source_size for r in sources if r.source_size}
    for key, words in by_row.items():
        assert set(words) <= set(range(size[key])) and max(words.values()) <= 2
        if passes[None if key[0] else key[1]] >= 1.01:
            assert len(words) == size[key]


def test_any_stretch_of_slots_has_each_sources_share(mixed):
    _, (_, spans, sources), _ = mixed
    blocks = {name(r): r.blocks for r in sources}
    slots = sorted({(r.slot, name(r)) for r in spans}, key=lambda s: s[0])
    scale = 1 << (sum(blocks.values()) - 1).bit_length()
    for start in range(0, scale, 64):
        seen = Counter(s for t, s in slots if start <= t < start + 256)
        for source, n in blocks.items():
            if start + 256 <= scale:
                assert abs(seen[source] - 256 * n / scale) <= 9, (source, seen)


def test_reruns_agree_and_rows_are_taken_once(spark, rows, mixed):
    frame, (_, spans, _), out = mixed
    again = M.mix(frame.orderBy(F.rand()).repartition(3), block_words=16)[1]
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, spans))
    taken = M.with_targets(M.words_taken(out[0], out[1]), out[2]).collect()
    assert len(taken) == len(rows) and all(r.taken <= 2 * r.size for r in taken)
    assert sum(r.taken for r in taken) == sum(r.n_words for r in spans)
    texts = M.mixed_texts(frame, out[1]).collect()
    assert len(texts) == len(spans) and sum(len(r.text.split()) for r in texts) == sum(r.n_words for r in spans)
    assert all(re.fullmatch(r"\S+( \S+)*", r.text) for r in texts)


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "a", "")]])
def test_nothing_to_mix(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    all_rows, spans, sources = M.mix(frame)
    assert all_rows.count() == len(rows) and spans.count() == 0
    assert [r.target for r in sources.collect()] == [0.0] * len(rows)


def test_runs_without_python(spark):
    frame = spark.createDataFrame([(1, "a", "b c")], "doc_id long, source string, text string")
    text = M.words_taken(*M.mix(frame)[:2])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Cartesian" not in text and "NestedLoop" not in text
