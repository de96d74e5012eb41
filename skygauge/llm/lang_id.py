"""Language identification: scripts narrow the candidates, Viterbi labels spans of mixed texts."""

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygauge.llm.common import give_back, per_row, slices, text_of

#: Training documents per language (expected), hash buckets of n-grams, sizes of n-grams.
TRAIN_ROWS, BUCKETS, SIZES = 3000, 1 << 17, (1, 2, 3, 4)
#: Nats lost at every change of language, weight of the overlapping n-grams, chunk of the search.
PENALTY, WEIGHT, CHUNK = 8.0, 0.5, 32
KEEP = 150_000
#: Letters in scripts of no learned language that are evidence of another language: one may be a symbol.
EVIDENCE = 2
#: Words of a text that can be told from gibberish, and how many times the way from the median to the
#: lowest thousandth of the labelled texts the level lies below the median.
FEWEST, BELOW = 5, 3.0
UNKNOWN = "und"

#: First code points of runs of one script (fixed values, Unicode blocks), in order.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0E00, "thai"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "latin"), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF00, "latin"),
    (0x10000, "other"), (0x20000, "han"),
)
_STARTS, _NAMES = [s for s, _ in SCRIPTS], sorted({n for _, n in SCRIPTS})
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def script_of(word: str) -> int:
    """The script of the word's first letter; -1 if it has none."""
    for c in word:
        if c.isalpha():
            return _NAMES.index(SCRIPTS[bisect_right(_STARTS, ord(c)) - 1][1])
    return -1


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of every word's n-grams, its ends marked, and the word of each."""
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    blank = codes == 32
    word = np.cumsum(blank) - 1
    buckets, owners = [], []
    for size in SIZES:
        places = len(codes) - size + 1
        if places <= 0:
            continue
        total, inner = np.full(places, size, np.uint64), np.zeros(places, bool)
        for i in range(size):
            total = (total ^ codes[i:i + places]) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(29)
            if 0 < i < size - 1 or size == 1:
                inner |= blank[i:i + places]
        keep = np.flatnonzero(~inner)
        buckets.append((total[keep] >> np.uint64(40)) % np.uint64(BUCKETS))
        owners.append(word[keep])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


class Model:
    """Log-probabilities of n-gram buckets per language, which scripts a language uses, and the mean
    log-probability of an n-gram below which a text is in none of the languages."""

    def __init__(self, languages: list[str], table: np.ndarray, scripts: np.ndarray, level: float = -np.inf):
        self.languages, self.table, self.scripts, self.level = languages, table, scripts, level

    def parts(self) -> tuple:
        """What a task needs to build the model again, in types that every executor knows."""
        return self.languages, self.table, self.scripts, self.level

    def foreign(self, words: list[str]) -> np.ndarray:
        """Whether each word has letters, but of a script that no learned language uses."""
        script = np.array([script_of(w) for w in words], np.int64)
        return (script >= 0) & ~self.scripts[script].any(1)

    def scores(self, words: list[str]) -> np.ndarray:
        """One row per word: its score per language; languages of other scripts are far below."""
        return self.told(words)[0]

    def told(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``scores``, the log-probability of each word's n-grams in its best language, and their number."""
        bucket, owner = features(words)
        made = np.stack([np.bincount(owner, self.table[bucket, l], len(words)) for l in range(len(self.languages))], 1)
        allowed = self.scripts[[script_of(w) for w in words]]
        allowed |= ~allowed.any(1, keepdims=True)
        best, grams = made.max(1), np.bincount(owner, minlength=len(words))
        made = WEIGHT * made - 1e4 * ~allowed
        return (made - made.max(1, keepdims=True)).astype(np.float32), best, grams


def train(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    train_rows: int = TRAIN_ROWS,
) -> Model:
    """Fit on texts with a language: about ``train_rows`` of each, those whose ids hash lowest.

    Counts of n-gram buckets are added up in the tasks and by a shuffle; buckets times
    languages of them reach the driver. Rows without id or language are not learned from.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(_NAMES) + 1, 0), bool))
    languages = sorted(sizes)
    share = F.element_at(F.create_map(*(x for l in languages for x in (F.lit(l), F.lit(train_rows / sizes[l])))), F.col("lang"))
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")
    place = {l: i for i, l in enumerate(languages)}
    width = BUCKETS + len(_NAMES) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(languages), width), np.int64)
        for batch in batches:
            for part in slices(batch, 1 << 20):
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words = words_of(text)
                    if words:
                        own = sums[place[lang]]
                        own += np.bincount(features(words)[0], minlength=width)
                        own[BUCKETS:] += np.bincount([script_of(w) for w in words if script_of(w) >= 0], minlength=width - BUCKETS)
        l, b = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(l), pa.array(b), pa.array(sums[l, b])], names=["l", "b", "n"])

    counts = some.mapInArrow(count, "l long, b long, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros((len(languages), width))
    sums[counts["l"].to_numpy(), counts["b"].to_numpy()] = counts["n"].to_numpy()
    grams = sums[:, :BUCKETS] + 0.2
    table = np.log(grams / grams.sum(1, keepdims=True)).T.astype(np.float32)
    used = sums[:, BUCKETS:]
    scripts = (used >= 0.01 * np.maximum(1, used.sum(1, keepdims=True))).T
    model = Model(languages, table, scripts)
    model.level = _level(some, model)
    return model


def _level(some: DataFrame, model: Model) -> float:
    """The level below which gibberish lies, from the texts that the model was fitted on."""
    sent = some.sparkSession.sparkContext.broadcast(model.parts())

    def open_task():
        label = Labeller(Model(*sent.value))

        def run(texts):
            label(texts)
            return pa.array(label.quality, mask=label.words < FEWEST, from_pandas=False),
        return run

    found = per_row(some, {"id": F.lit(0), "text": text_of("text")}, "quality double", open_task)
    low, middle = found.agg(F.percentile_approx("quality", [0.001, 0.5], 10_000).alias("q")).first().q or (-np.inf, -np.inf)
    return middle - BELOW * (middle - low) if middle > low else -np.inf


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Best label of every row of ``scores``, for runs of rows of the given lengths: the path of
    largest total score, where each change of label within a run costs ``penalty``.

    Runs are cut into chunks; best scores from each label before a chunk to each label at its end
    are found for all chunks at once, chained along each run, and then traced back.
    """
    labels = scores.shape[1]
    chunks = -(-lengths // CHUNK)
    first = np.cumsum(chunks) - chunks
    total = int(chunks.sum())
    if not total:
        return np.empty(0, np.int64)
    run = np.repeat(np.arange(len(lengths)), lengths)
    step = np.arange(len(run)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    slot = (first[run] + step // CHUNK) * CHUNK + step % CHUNK
    padded = np.zeros((total * CHUNK, labels), np.float64)
    padded[slot] = scores
    padded = np.ascontiguousarray(padded.reshape(total, CHUNK, labels).transpose(1, 0, 2))

    best = np.where(np.eye(labels, dtype=bool), 0.0, -penalty)[None] + np.zeros((total, 1, 1))
    for t in range(CHUNK):
        if t:
            best = np.maximum(best, best.max(2, keepdims=True) - penalty)
        best = best + padded[t][:, None, :]

    before = np.zeros((total, labels))
    end = np.zeros(total, np.int64)
    start = np.zeros(total, np.int64)
    order = np.argsort(-chunks, kind="stable")
    many = np.searchsorted(-chunks[order], -np.arange(1, int(chunks.max()) + 1), side="right")
    for c, n in enumerate(many):
        at = first[order[:n]] + c
        after = (before[at][:, :, None] + best[at]).max(1)
        last = chunks[order[:n]] == c + 1
        end[at[last]] = after[last].argmax(1)
        before[at[~last] + 1] = after[~last] - after[~last].max(1, keepdims=True)
    for c in range(len(many) - 1, -1, -1):
        at = first[order[:many[c]]] + c
        start[at] = (before[at] + best[at, :, end[at]]).argmax(1)
        if c:
            end[at - 1] = start[at]

    value = np.where(np.arange(labels)[None] == start[:, None], 0.0, -penalty)
    source = np.empty((CHUNK, total), np.int64)
    stayed = np.empty((CHUNK, total, labels), bool)
    for t in range(CHUNK):
        if t:
            top = value.argmax(1)
            jump = np.take_along_axis(value, top[:, None], 1) - penalty
            source[t], stayed[t] = top, value >= jump
            value = np.maximum(value, jump)
        value = value + padded[t]
    path = np.empty((CHUNK, total), np.int64)
    here = end
    for t in range(CHUNK - 1, -1, -1):
        path[t] = here
        if t:
            here = np.where(stayed[t][np.arange(total), here], here, source[t])
    return path.T.reshape(-1)[slot]


class Labeller:
    """Labels the words of texts; scores of frequent words are kept."""

    def __init__(self, model: Model, penalty: float = PENALTY):
        self.model, self.penalty = model, penalty
        self.names = [*model.languages, UNKNOWN]
        self._forget()

    def _forget(self):
        self.known: dict[str, int] = {}
        self.rows = np.empty((0, len(self.model.languages)), np.float32)
        self.strange = np.empty(0, bool)
        self.best, self.grams = np.empty(0), np.empty(0, np.int64)

    def __call__(self, texts: list[str]):
        """Per text: language, share of its letters, and arrays of spans' offsets, languages, first words, counts."""
        cut = [words_of(t) for t in texts]
        if len(self.known) > KEEP:
            self._forget()
        new = list({w for words in cut for w in words}.difference(self.known))
        if new and self.model.languages:
            self.known.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            scores, best, grams = self.model.told(new)
            self.rows = np.concatenate([self.rows, scores])
            self.best, self.grams = np.concatenate([self.best, best]), np.concatenate([self.grams, grams])
            self.strange = np.concatenate([self.strange, self.model.foreign(new)])
        lengths = np.array([len(w) for w in cut], np.int64) if self.model.languages else np.zeros(len(cut), np.int64)
        count, languages = int(lengths.sum()), len(self.model.languages)
        words = [w for part in cut for w in part] if count else []
        row = np.fromiter(map(self.known.__getitem__, words), np.int64, count)
        size = np.fromiter(map(len, words), np.int64, count)
        text = np.repeat(np.arange(len(cut)), lengths)
        label = viterbi(self.rows[row], lengths, self.penalty) if count else np.empty(0, np.int64)
        letters = np.bincount(text * max(1, languages) + label, size, len(cut) * max(1, languages)).reshape(len(cut), -1)
        whole = letters.sum(1)
        # of the texts last labelled: how many of their letters stand in words of foreign scripts, and their share
        self.foreign = np.bincount(text, size * self.strange[row], len(cut))
        self.foreign_share = self.foreign / np.maximum(1, whole)
        # and how many words they have, and the mean log-probability of the words' n-grams
        self.words = lengths
        self.quality = np.bincount(text, self.best[row], len(cut)) / np.maximum(1, np.bincount(text, self.grams[row], len(cut)))
        share = letters.max(1) / np.maximum(1, whole)
        none = np.array([not n or not any(c.isalpha() for w in part for c in w) for n, part in zip(whole, cut)], bool)
        top = np.where(none, languages, letters.argmax(1))
        new_span = np.ones(count, bool)
        new_span[1:] = (label[1:] != label[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(new_span)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(text[at], minlength=len(cut)))])
        starts = np.cumsum(lengths) - lengths
        spans = offsets, label[at], at - starts[text[at]], np.diff(np.append(at, count))
        return [self.names[t] for t in top], np.where(none, 0.0, share), spans


def label_languages(
    df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY,
) -> DataFrame:
    """(id, lang_pred, score, spans) per row: the language of most letters, its share of them (0 to
    1), and the runs of words in one language as (lang, first_word, n_words).

    Only the text is looked at. Words are runs of letters, lower-cased; each gets a score per
    language whose script it has, and the path of best total score, less ``penalty`` per change of
    language, labels the words. Ties go to the language that sorts first. A text that is null
    or has no letter is "und" with score 0, as is every text where the model knows no language.
    Whole texts are labelled, in chunks; repeated rows give repeated rows; an empty table gives
    none. The model (buckets times languages) is broadcast; nothing is shuffled.
    """
    sent = df.sparkSession.sparkContext.broadcast(model.parts())

    def open_task():
        label = Labeller(Model(*sent.value), penalty)

        def run(texts):
            lang, score, (offsets, which, first, count) = label(texts)
            names = pa.array(label.names).take(pa.array(which))
            span = pa.StructArray.from_arrays([names, pa.array(first), pa.array(count)], names=["lang", "first_word", "n_words"])
            return lang, score, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), span)
        return run

    return per_row(
        df, {"id": F.col(id_col), "text": text_of(text_col)},
        "lang_pred string, score double, spans array<struct<lang:string,first_word:long,n_words:long>>", open_task,
    )


def keep_identified(df: DataFrame, model: Model, text_col: str = "text", least: float = 1 / 3) -> DataFrame:
    """The rows, with all their columns, whose text has a language with ``least`` of its letters, not most of
    them (EVIDENCE or more) in scripts that no learned language uses, and n-grams that are not
    much rarer in their best language than those of the labelled texts (``Model.level``; texts of FEWEST
    words or more). So texts in other languages of a learned script and gibberish go.

    Null, empty and letterless texts go; whole texts count, however long; repeated rows stay or go
    together; an empty table stays empty. Columns of any name are kept as they are.
    """
    sent = df.sparkSession.sparkContext.broadcast(model.parts())
    column = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = None
        for batch in batches:
            label = label or Labeller(Model(*sent.value))
            texts = batch.column(column).cast(pa.string())
            pair = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), texts], names=["row", "text"])
            keep = []
            for part in slices(pair, 4 << 20):
                lang, score, _ = label([t or "" for t in part.column(1).to_pylist()])
                other = (label.foreign >= EVIDENCE) & (label.foreign_share > 0.5)
                other |= (label.words >= FEWEST) & (label.quality < label.model.level)
                keep += [l != UNKNOWN and s >= least and not o for l, s, o in zip(lang, score, other)]
            if any(keep):
                yield batch.filter(pa.array(keep, pa.bool_()))
        label = None
        give_back()

    return df.mapInArrow(run, df.schema)
