"""From documents to training files: language, near-duplicates, benchmark leaks, mixture, token ids in training order.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last keep the columns of docs. Stages work on
whole texts, accept null, empty and very long texts, repeated rows, empty tables and columns of any other name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelwarden.llm import decontamination, language_id, mixing, simhash, training_order
from modelwarden.llm.common import table
from modelwarden.session import materialise

#: A text goes if its language has less than this posterior probability.
LEAST_SURE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in one of the languages that the rows' own lang teaches; `und` and unsure ones go."""
    whole = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    named = language_id.predict(whole, language_id.fit(docs), ["_row"])
    return named.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SURE)).select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of every group linked by 0.8 of their five-word shingles; the smallest doc_id stays."""
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold no benchmark item; rows that share a doc_id, or have none, are told apart by their texts."""
    key = F.struct("doc_id", F.xxhash64("text").alias("text_key"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("key"))
    found = decontamination.leaks(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    found = materialise(found.select("doc_id.doc_id", "doc_id.text_key").distinct(), "leaks")
    same = F.col("key.doc_id").eqNullSafe(found["doc_id"]) & (F.col("key.text_key") == found["text_key"])
    return rows.join(found, same, "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in which the shares of sources, languages and topics are tempered, of half the tokens at least."""
    facts = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "source", "lang", mixing.topic().alias("topic"),
                        mixing.tokens().alias("n_tokens"))
    mixed = mixing.calibrate(facts, dict.fromkeys(mixing.DIMENSIONS, mixing.POWER), keep=mixing.KEEP,
                             tolerance=mixing.TOLERANCE)
    return mixed.where("taken").select("_row.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Index of the files that hold the sample as token ids in training order."""
    return training_order.write_training_order(docs, training_order.new_folder(spark))


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_tokens),
]
#: SQL expresses neither the classifier nor the fingerprints; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.split(" ")[0].replace("/", "-"))
    return docs
