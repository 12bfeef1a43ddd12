"""A training-data pipeline over `documents`: language, near duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the
next stage's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import _text, language_id, packing, pii, simhash, substring_dedup, token_rollup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Documents whose likeliest language has a smaller probability are rejected.
LEAST_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or a clear language; `lang` becomes the language found. Without any labelled document all go."""
    model = language_id.fit(docs)
    found = language_id.predict(docs, model, keep=COLUMNS)
    clear = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return clear.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (similarity 0.8 of 5-word shingles): the smallest doc_id, then the first by a hash of the text.

    Groups are of texts, so rows that share a doc_id stand for themselves. A row without a doc_id stands behind all
    others, under a number made of its text. Texts without words are one group.
    """
    from pyspark.sql import Window

    key = F.coalesce("doc_id", F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61)))
    rows = docs.select(*COLUMNS, key.alias("row_key"), simhash.text_node(F.col("text")).alias("node"))
    firsts = rows.groupBy("node").agg(F.min("row_key").alias("row_key")).join(simhash.near_copies(rows), "node", "left")
    keepers = firsts.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("row_key", "node")).alias("x")).select("x.*")
    first = Window.partitionBy("row_key", "node").orderBy("lang", "source", "n_chars")
    kept = rows.join(keepers, ["row_key", "node"], "left_semi").withColumn("place", F.row_number().over(first)).where("place = 1")
    return kept.select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out passages of 50 words and more that stand in a smaller document; a document of which nothing is left goes."""
    marked = docs.withColumn("had_text", F.col("text").isNotNull())
    found = substring_dedup.deduplicated(marked, keep=("had_text", "lang", "source", "n_chars"), untouched=True)
    cut = F.col("n_removed") > 0
    return found.where((F.col("n_words") > F.col("n_removed")) | ~cut).select(
        "doc_id", F.when(F.col("had_text"), F.col("kept_text")).alias("text"), "lang", "source", F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    )


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind, in angle brackets, in place of personal data."""
    found = pii.find(docs, pii.fit(docs), keep=COLUMNS).withColumn("clean", pii.masked(F.col("text"), F.col("spans")))
    some = F.size("spans") > 0
    return found.select("doc_id", F.col("clean").alias("text"), "lang", "source", F.when(some, F.length("clean").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences, by words."""
    return packing.pack_documents(docs, token_rollup.words_count(F.col("text")), keep=("lang", "source"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("personal_data", personal_data), ("packing", packed)]

#: The language model and the field over spans are fitted models, so SQL can't express the result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again; what no stage reads any more is deleted."""
    folder = _text.shared_dir(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _text.removed(spark, f"{folder}/{before}")
        before = name
    return docs
