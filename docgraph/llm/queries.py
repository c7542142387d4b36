"""The operators' queries over whole tables, with production parameters, and SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, language_model, near_dedup, neighbours, packing, substring_dedup, suffix_dedup, token_counts, toxicity
from .common import checkpointed, read


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), toxicity.fold("doc_id") != 2)
    return toxicity.score(docs, model).select("doc_id", (toxicity.fold("doc_id") == 2).alias("held_out"), "score", "predicted")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.dedup(read(spark, sf_dir, "documents")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, after two edits: a sentence in the middle, then eight bytes less at a quarter."""
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    half, quarter = F.floor(n / 2), F.floor(n / 4)
    one = F.struct(half.alias("start"), half.alias("end"), F.lit(" An added sentence.").alias("text"))
    two = F.struct(quarter.alias("start"), (quarter + 8).alias("end"), F.lit("").alias("text"))
    found = token_counts.count_edited(docs.withColumn("edits", F.array(one, two)), path)
    return found.select("doc_id", "n_before", "n_tokens", "encoded_bytes", F.sha2("text", 256).alias("text_sha256"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(read(spark, sf_dir, "documents"), shingle=2, percent=80)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return decontamination.digests(found)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(substring_dedup.dedup(read(spark, sf_dir, "documents")))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionAll(spark.range(2).select(F.lit(-1).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(said)))
    return chat.digests(chat.formatted(chat.ranked_paths(chat.from_turns(rows), best=1)))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", language_model.fold("doc_id", 5) == 1)
    model = language_model.train(docs.where("NOT coalesce(held_out, false)"), order=3)
    found = language_model.score(docs, model)
    # a row of numbers for each document; the model isn't needed any more
    found = checkpointed(found.select("doc_id", (language_model.fold("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"))
    model.delete(spark)
    return found


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_neighbours": op4_neighbours,
    "op5_near_dedup": op5_near_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_chat": op8_chat,
    "op9_packing": op9_packing,
    "op10_language_model": op10_language_model,
}
ORACLE_SQL: dict[str, str] = {"op8_chat": chat.ORACLE}
