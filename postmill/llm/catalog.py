"""Registered queries of the operators here, each with its oracle SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import bpe, clusters, codes, decontam, embdup, fingerprint, langid, neardup, sharding, tokencount, toxicity, urlfilter, warc
from postmill.llm.learning import held_out
from postmill.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_bpe_automaton")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digests(table(spark, sf, "documents"), WORD_BPE)


@query("op2_url_filter")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf, "pages"))


@query("op3_minhash_forest", neardup.oracle())
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf, "documents"))


@query("op4_token_counts")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    """Three edits of every text: its head replaced, words put into the middle, some letters cut later on."""
    size = F.length("text").cast("bigint")
    edits = F.array(
        F.struct(F.lit(0).alias("at"), F.least(size, F.lit(7)).alias("cut"), F.lit("Edited: ").alias("put")),
        F.struct(F.floor(size / 2).alias("at"), F.lit(3).alias("cut"), F.lit("'re 42  new words").alias("put")),
        F.struct(F.floor(size * 3 / 4).alias("at"), F.lit(9).alias("cut"), F.lit("").alias("put")),
    )
    return tokencount.count_edits(table(spark, sf, "documents"), BYTE_BPE, public_tokenizers.PATTERN, edits)


@query("op5_sharding", sharding.oracle())
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.place(table(spark, sf, "documents"))


@query("op6_language_codes")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("held_out", held_out(F.col("doc_id"), 3, 1))
    found = langid.predict(docs, langid.train(docs.filter(~F.col("held_out"))))
    return found.withColumn("held_out", held_out(F.col("doc_id"), 3, 1))


@query("op7_suffix_decontamination", decontam.oracle())
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.digest(decontam.scan(table(spark, sf, "documents"), table(spark, sf, "benchmark")))


@query("op8_warc", warc.oracle())
def op8(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_pages(table(spark, sf, "pages"), path)
    read = warc.read_pages(spark, path, payload=False)
    return read.select(
        F.col("page_id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"),
    )


@query("op9_embedding_grid", embdup.oracle())
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return embdup.near_duplicates(table(spark, sf, "embeddings"))


@query("op10_toxicity_pu")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    out = held_out(F.col("doc_id"), 5, 0)
    model = toxicity.train(docs.filter(~out), labels.filter(~out))
    return toxicity.score(docs, model).withColumn("held_out", out)


@query("op11_ns_bounds", clusters.oracle())
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.cluster(table(spark, sf, "embeddings")).drop("evaluations")


@query("op12_laesa_codes", codes.oracle())
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return codes.codes(table(spark, sf, "embeddings")).drop("evaluations")


@query("op13_scaled_fingerprints", fingerprint.oracle())
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf, "documents"))
