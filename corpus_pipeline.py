"""A corpus pipeline: five stages from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a DataFrame; all but the last
return the columns of documents. run() writes every stage as Parquet to the shared folder and reads it
again, so a stage never depends on executors of the one before.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.llm import decontamination, near_dedup, packing, substring_dedup, toxicity
from docgraph.llm.common import new_folder, read


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.3. A fourth of the labels is held out of training."""
    return toxicity.keep_clean(docs, toxicity.train(docs, read(spark, sf_dir, "labels"), toxicity.fold("doc_id") != 2))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group on 5-word shingles at a similarity of 0.8: the one with the smallest doc_id."""
    return near_dedup.keep_first(docs, shingle=5, percent=80)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 13 words that a document with a smaller doc_id holds. Documents that lose all words go."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = substring_dedup.dedup(docs, keep=rest or None, spacing=True)
    found = found.where("size(removed) = 0 OR kept <> ''")
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return found.select(*[new[c].alias(c) if c in new else F.col(f"rest.{c}") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of 2048."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can't express compression distances or tokenizers; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
