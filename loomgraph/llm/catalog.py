"""The registered queries of the text operators: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, codes, conversation, exact, html_text, language_model, pii, quality, repair, simhash, suffixes, tiling, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def entry(name: str, table: str = "documents", sql: str | None = None):
    """Register ``fn(spark, rows of the table, folder) -> DataFrame``."""

    def add(fn: Callable[[SparkSession, DataFrame, str], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(spark, spark.read.parquet(f"{folder}/{table}.parquet"), folder)
        if sql:
            SQL[name] = sql
        return fn

    return add


@entry("op1_quality")
def op1(spark, docs, folder):
    return quality.scored(docs, spark.read.parquet(f"{folder}/labels.parquet"))


@entry("op2_token_shards")
def op2(spark, docs, folder):
    return repair.stored(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@entry("op3_bpe_round_trip")
def op3(spark, docs, folder):
    return bpe.encoded(docs, public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@entry("op4_toxicity")
def op4(spark, docs, folder):
    return toxicity.scored(docs, spark.read.parquet(f"{folder}/labels.parquet"))


@entry("op5_simhash_near_dedup")
def op5(spark, docs, folder):
    return simhash.near_groups(docs)


@entry("op6_lm_score")
def op6(spark, docs, folder):
    return language_model.scored(docs)


@entry("op7_decontamination")
def op7(spark, docs, folder):
    return tiling.coverage(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


@entry("op8_exact_dedup", sql=exact.SQL)
def op8(spark, docs, folder):
    return exact.groups(docs)


@entry("op9_html_text", table="pages")
def op9(spark, pages, folder):
    return html_text.extracted(pages)


@entry("op10_personal_data")
def op10(spark, docs, folder):
    found = pii.spans(docs)
    return found.select(
        "doc_id", *(pii.count_of(kind, "base").alias(f"n_{kind}") for kind in pii.KINDS),
        F.sha2(pii.listed("base").cast("binary"), 256).alias("base_sha256"), pii.listed(F.concat("base", "added")).alias("spans"),
    )


@entry("op11_conversation_repair", table="conversations", sql=conversation.SQL)
def op11(spark, rows, folder):
    return conversation.report(conversation.damaged(rows))


@entry("op12_vector_codes", table="embeddings", sql=codes.SQL)
def op12(spark, rows, folder):
    return codes.compressed(rows)


@entry("op13_suffix_dedup")
def op13(spark, docs, folder):
    return suffixes.cleaned(docs, body=False).drop("kept")
