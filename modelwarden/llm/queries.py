"""Queries of the corpus operators over whole tables, with check SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from modelwarden.llm import (
    ann, decontamination, language_id, licence_scan, lm_scoring, mixing, periodic_runs, sharding, simhash, spelling,
    substring_dedup, toxicity, training_order,
)
from modelwarden.llm.common import fold, table
from modelwarden.session import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECK_SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents outside fold 2 of 4."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 4) == 2)
    return language_id.identify(docs, docs.where("not held_out"), ["doc_id", "held_out"])


@query
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint of every document and the component of fingerprints within 3 bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), ["doc_id"]).drop("root")


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside fold 0 of 5."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(fold("doc_id", 5) != 0))
    return toxicity.score(docs.withColumn("held_out", fold("doc_id", 5) == 0), model, ["doc_id", "held_out"])


@query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of equal row counts, uniformly shuffled."""
    # Written whole, so that texts are dealt and not only numbers about them.
    dealt = materialise(sharding.shuffle_to_shards(table(spark, sf_dir, "documents"), 16, seed=3), "shards", "zstd")
    text = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    return dealt.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
                        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index of the shard files that hold all documents as token ids in training order."""
    return training_order.write_training_order(table(spark, sf_dir, "documents"), training_order.new_folder(spark))


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds, with up to a fifth of the words of a window substituted."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


CHECK_SQL["op2_decontamination"] = decontamination.check_sql()


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling probability of every document, raked to tempered shares of sources, languages and topics."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", mixing.topic().alias("topic"),
                                                    mixing.tokens().alias("n_tokens"))
    mixed = mixing.calibrate(docs, dict.fromkeys(mixing.DIMENSIONS, mixing.POWER))
    return mixed.withColumn("probability", F.round("probability", 9))


CHECK_SQL["op4_mixing"] = mixing.check_sql()


@query
def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found for every embedding whose vec_id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where("vec_id % 20 = 0"))


@query
def op8_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the bytes of 400-byte strings that recur, and the removed runs (in bytes)."""
    return substring_dedup.repeated_spans(table(spark, sf_dir, "documents"))


@query
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document, learned from the documents outside fold 2 of 7."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 7) == 2)
    return lm_scoring.score_texts(docs)


def repeated_from(text: str, mark: str) -> Column:
    """The words of `text` from word mark % n on made periodic: word i is word a + (i - a) % p, a = mark % n."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, mark = F.size(words), F.col(mark)
    head = F.pmod(mark, n).cast("int")
    period = (1 + F.floor((n - head) / (3 + mark % 8))).cast("int")
    block = F.slice(words, head + 1, period)
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil((n - head) / period).cast("int"))), F.lit(1), n - head)
    return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), head), tail), " ")).otherwise(F.col(text))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal periodic runs of words in every document, a tenth of the documents made periodic first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    docs = docs.withColumn("mark", F.floor(F.col("h") / 10))
    docs = docs.withColumn("text", F.when(F.col("h") % 10 == 0, repeated_from("text", "mark")).otherwise(F.col("text")))
    found = periodic_runs.periodic_runs(docs, ["doc_id"])
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("longest.before")).alias("start"),
        F.col("longest.length").alias("length"), (-F.col("longest.shorter")).alias("period"),
        F.expr("1000 * longest.length div -longest.shorter").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op12_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and the notices that cover every document's words."""
    found = licence_scan.scan_licences(table(spark, sf_dir, "documents"), ["doc_id"])

    def listed(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    return found.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min("places.first").alias("first_word"),
        F.array_max("places.first").alias("last_word"), listed(F.col("places.label")).alias("base_labels"),
        listed(F.concat("places.label", "spans.label")).alias("labels"), "score")


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common form of every word of at least 7 letters that occurs twice, a letter of some words left out first."""
    word = F.col("word")
    h = F.crc32(F.concat(F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    gone = (h % F.length(word)).cast("int")
    left_out = F.concat(word.substr(F.lit(1), gone), word.substr(gone + 2, F.length(word)))
    words = spelling.vocabulary(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                word=F.when(h % 31 == 0, left_out).otherwise(word))
    return spelling.variants(words)


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over all documents."""
    return corpus_pipeline.run(spark, sf_dir)
