"""Secret scans with SQL functions only: fixed forms, and strings that look random to Markov models."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygauge.llm.common import text_of
from skygauge.llm.rows import let, starts

# The forms of secrets, the least length of what matters in them, their order.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: Characters of the Markov models and the runs of them that are judged.
CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = "[A-Za-z0-9+/_=-]{%d,}"
SHORTEST = 16
#: Nats by which the random model must beat the other, and the documents and random strings
#: of each sort that the models are fitted on at most.
MARGIN = 4.0
TRAIN_ROWS = 4000
_MARK, _OTHER = "\u0001", "\u0002"
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _clean(text: Column) -> Column:
    """The text without the character that marks ends of matches; lengths stay."""
    return F.replace(text, F.lit(_MARK), F.lit(_OTHER))


def _matches(text: Column, pattern: str, kind: str, keep, maybe: Column) -> Column:
    """Spans of the matches of ``pattern`` (leftmost, not overlapping) that ``keep`` accepts.

    Matches are set between marks, the text is split at these, and every second part is a
    match that starts where the parts before it end.
    """
    marked = F.regexp_replace(text, f"({pattern})", f"{_MARK}$1{_MARK}")

    def spans(parts: Column) -> Column:
        odd = F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2))
        kept = F.filter(odd, lambda i: keep(F.get(parts, i)))
        return let(kept, lambda places: F.when(
            F.size(places) > 0,
            F.zip_with(
                places, starts(F.transform(parts, lambda p: F.length(p)), places),
                lambda i, at: F.struct(
                    at.alias("start"), F.lit(KINDS.index(kind)).alias("rank"),
                    (at + F.length(F.get(parts, i))).alias("end"), F.lit(kind).alias("kind"),
                ),
            ),
        ).otherwise(F.array().cast(_SPAN)))

    return F.when(maybe, let(
        F.split(marked, _MARK, -1),
        lambda parts: F.when(F.size(parts) > 1, spans(parts)).otherwise(F.array().cast(_SPAN)),
    )).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """Spans of the fixed forms, by start and then kind."""
    clean = _clean(text)
    found = (
        # the forms with their least length name the same matches, but of an assignment,
        # where a match that is too short still uses up its text
        _matches(clean, ASSIGN, "assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST["assign"], F.lit(True)),
        _matches(clean, "AKIA[A-Z0-9]{%d,}" % (LEAST["access"] - 4), "access", lambda m: F.lit(True), F.contains(clean, F.lit("AKIA"))),
        _matches(clean, "[0-9a-f]{%d,}" % LEAST["hex"], "hex", lambda m: F.lit(True), F.lit(True)),
    )
    return F.array_sort(F.concat(*found))


def _pairs(words: DataFrame) -> DataFrame:
    pairs = F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring(F.col("w"), i, F.lit(2)))
    return words.where(F.length("w") > 1).select(F.explode(pairs).alias("pair")).groupBy("pair").count()


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> list[int]:
    """Log-likelihood ratios, random against ordinary, of every two characters that follow each
    other, in thousandths of a nat: a square table by places in CHARS, row by row.

    Labelled samples: ordinary are the runs of CHARS in the ``train_rows`` documents of smallest
    hash (rows repeated throughout count as one, dealt out over tasks again) outside the fixed forms; random are the values in the fixed forms of
    these, and ``train_rows`` digests of each of four sorts. Both models have half a count more for
    every pair, so an empty table still gives a model.
    """
    spark = df.sparkSession
    texts = df.select(text_of(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"))
    last = texts.select("h").distinct().orderBy("h").limit(train_rows).agg(F.max("h")).first()[0]
    some = texts.where(F.col("h") <= F.lit(last)).dropDuplicates(["h"]).repartition(spark.sparkContext.defaultParallelism)
    fixed = f"{ASSIGN}|{ACCESS}|[0-9a-f]{{{LEAST['hex']},}}"
    ordinary = some.select(
        F.explode(F.regexp_extract_all(F.regexp_replace("text", fixed, " "), F.lit(RUN % 4), F.lit(0))).alias("w")
    )
    digest = F.sha2(F.col("id").cast("string"), 256)
    sorts = F.array(digest, F.upper(digest), F.base64(F.unhex(digest)), F.conv(F.substring(digest, 1, 15), 16, 36))
    random = spark.range(train_rows).select(F.explode(sorts).alias("w")).unionByName(
        some.select(F.explode(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2))).alias("w"))
        .where(F.length("w") >= SHORTEST)
    )
    counts = _pairs(ordinary).select("pair", "count", F.lit(0).alias("random")).unionByName(
        _pairs(random).select("pair", "count", F.lit(1).alias("random"))
    )
    seen = ([[0.5] * len(CHARS) for _ in CHARS], [[0.5] * len(CHARS) for _ in CHARS])
    place = {c: i for i, c in enumerate(CHARS)}
    for row in counts.collect():  # at most two models times the pairs of CHARS
        if row.pair[0] in place and row.pair[1] in place:
            seen[row.random][place[row.pair[0]]][place[row.pair[1]]] += row["count"]
    logs = [[[math.log(n / sum(line)) for n in line] for line in model] for model in seen]
    return [round(1000 * (r - o)) for rs, os in zip(logs[1], logs[0]) for r, o in zip(rs, os)]


def ratio(word: Column, model: list[int]) -> Column:
    """Thousandths of nats by which the random model likes a word of CHARS more."""
    table = F.from_json(F.lit(str(model)), "array<int>")
    places = F.transform(F.split(word, "(?!^)"), lambda c: F.instr(F.lit(CHARS), c))
    width = len(CHARS)

    def walk(path: Column) -> Column:
        steps = F.zip_with(
            F.slice(path, 1, F.size(path) - 1), F.slice(path, F.lit(2), F.size(path) - 1),
            lambda a, b: F.get(table, (a - 1) * width + b - 1),
        )
        return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)

    return let(places, walk)


def random_spans(text: Column, model: list[int], margin: float = MARGIN) -> Column:
    """Spans of runs of SHORTEST and more CHARS, a letter among them, that look random."""
    def keep(run):
        return run.rlike("[A-Za-z]") & (ratio(run, model) >= round(1000 * margin))

    return _matches(_clean(text), RUN % SHORTEST, "random", keep, F.lit(True))


def spans(text: Column, model: list[int], margin: float = MARGIN) -> tuple[Column, Column]:
    """The spans of the fixed forms, and these with the random ones that overlap none of them."""
    def apart(base: Column, found: Column) -> Column:
        return F.filter(found, lambda r: ~F.exists(base, lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))

    base = base_spans(text)
    both = let(
        F.struct(base.alias("base"), random_spans(text, model, margin).alias("found")),
        lambda s: F.struct(
            s["base"].alias("base"), F.array_sort(F.concat(s["base"], apart(s["base"], s["found"]))).alias("spans")
        ),
    )
    return both["base"], both["spans"]


def find_secrets(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    model: list[int] | None = None, margin: float = MARGIN,
) -> DataFrame:
    """(id, base, spans) per row: arrays of (start, rank, end, kind) by start and then kind.

    base holds the fixed forms (assign, access, hex); spans adds "random" ones: runs of
    characters that a Markov model of random strings explains better, by ``margin`` nats, than one
    of ordinary identifiers, where they overlap no base span. Starts and ends are code points, end
    exclusive. The model is fitted on ``df`` unless given. Whole texts are scanned where they
    are; nothing is shuffled but the model's counts. A null text is empty and has no spans;
    repeated rows give repeated rows; an empty table gives none. Other columns are not read.
    """
    model = model or train(df, id_col, text_col)
    picked = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    base, every = spans(F.col("text"), model, margin)
    both = picked.select("id", F.struct(base.alias("base"), every.alias("spans")).alias("s"))
    return both.select("id", "s.base", "s.spans")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]",
           model: list[int] | None = None, margin: float = MARGIN) -> DataFrame:
    """``df`` with every stretch of overlapping spans of its text replaced by ``mask``.

    All rows and columns stay; texts without secrets, null ones among them, are untouched.
    """
    model = model or train(df, id_col, text_col)
    text = F.col(text_col)
    _, found = spans(text_of(text_col), model, margin)

    def cut(every: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("made"))

        def step(state, s):
            fresh = (s["start"] >= state["at"]) & ~((s["start"] == state["at"]) & F.endswith(state["made"], F.lit(mask)))
            return F.struct(
                F.greatest(state["at"], s["end"]).alias("at"),
                F.when(fresh, F.concat(state["made"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(mask)))
                .otherwise(state["made"]).alias("made"),
            )

        return F.aggregate(every, begin, step, lambda s: F.concat(s["made"], F.substring(text, s["at"] + 1, F.length(text))))

    new = let(found, lambda every: F.when(F.size(every) > 0, cut(every)).otherwise(text))
    return df.withColumn(text_col, new)
