"""A training-data pipeline over the documents table, from raw texts to token ids.

Each stage takes (spark, docs, sf_dir) and gives a frame that is written as Parquet and read
again as the next one's docs; all but the last keep the columns of docs. Nulls in any
column, empty tables and repeated rows pass every stage; each says what becomes of them.
"""

from itertools import count

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skygauge.llm import lang_id, secret_scan
from skygauge.llm.bpe import encode_decode
from skygauge.llm.common import table
from skygauge.llm.decontam import drop_contaminated
from skygauge.llm.simhash import simhash_dedup
from skygauge.sources.shared import materialise

RANKS = "byte_bpe_multi_50k.tiktoken"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, without a language for a third of their letters, mostly in scripts
    that no learned language uses, or with n-grams far rarer than those of labelled texts.

    The model learns from the documents that name their language. Null texts go.
    """
    return lang_id.keep_identified(docs, lang_id.train(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked SimHash fingerprints: the smallest doc_id.

    Rows with null ids come last; among rows of one id the smallest hash of the row stays, and of
    rows that are equal throughout, one. Keys meet the documents in one shuffle.
    """
    # the row is nested, so its columns may have any name
    key = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), F.xxhash64(*docs.columns).alias("hash"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"))
    groups = simhash_dedup(keyed.select("key", "row.text"), "key", "text")
    kept = groups.where("id = component_id or (id is null and component_id is null)").select(
        F.col("id.id").alias("kept_id"), F.col("id.hash").alias("kept_hash")
    )
    same = F.col("key.hash").eqNullSafe(F.col("kept_hash")) & F.col("key.id").eqNullSafe(F.col("kept_id"))
    once = keyed.select("row", "key", "key.id", "key.hash").join(kept, same, "left_semi").dropDuplicates(["hash", "id"])
    return once.select("row.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap a benchmark item; null texts overlap nothing."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts and sets n_chars anew where that changed one; keeps every row."""
    before = next(name for i in count() if (name := f"text{i}") not in docs.columns)
    found = secret_scan.redact(docs.withColumn(before, F.col("text")))
    changed = F.col("text").isNotNull() & (F.col("text") != F.col(before))
    length = F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", length).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, round_trip): byte-level BPE ids, as little-endian
    unsigned 32-bit integers, and whether they decode to the text. A null text is empty."""
    row = F.struct("doc_id", "lang", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    coded = encode_decode(
        docs.select(row.alias("row"), "text"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, "row"
    )
    return coded.select(
        "id.doc_id", "id.lang", "id.source", "n_tokens", "ids",
        (F.sha2("decoded", 256) == F.col("id.digest")).alias("round_trip"),
    )


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("secret_scan", redact_secrets),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL has no word for learned models, fingerprints and merges; tests hold the rows to brute force.
ORACLE_SQL = None

REGISTERED = {"QUERIES": {"pipeline": run}, "ORACLES": {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}}
