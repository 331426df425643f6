"""The corpus pipeline: toxicity, near-duplicates, repeated passages, contamination, byte-level BPE.

Each stage works on all documents that the one before kept and decides by its own input alone. Documents
are told apart by ``doc_id`` and text; rows that repeat both are near-duplicates like others, of which one
stays, and texts that share an id only are judged each by itself. Null texts and empty tables pass through.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, decontam, minhash, suffix_dedup, toxicity
from quarry.llm.common import Scratch

#: Columns of ``documents``, in order.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of these documents, scores below one half."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_documents(docs.select(*COLUMNS), model, score="_score").where("_score < 0.5").drop("_score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by similarity 0.8 or more of five-word shingle sets: of least id, then least text.

    Where an id repeats, each of its texts belongs to its own group. Documents without words and rows without id stay.
    """
    key = ["doc_id", "k1", "k2"]
    scratch = Scratch(spark, "near")
    found = scratch.table(minhash.near_groups(docs, words=5).where("`group` IS NOT NULL"), "found")
    best = found.groupBy("group").agg(F.min(F.struct(*key)).alias("best")).select("best.*")
    rows = found.groupBy(*key).agg(F.count("*").alias("rows"))
    judged = scratch.table(rows.join(best.withColumn("stays", F.lit(True)), key, "left"), "judged")
    gone = judged.where("stays IS NULL OR rows > 1").select(*key)
    named = docs.select(*COLUMNS, *minhash.text_keys("text"))
    kept = named.join(gone, key, "left_anti").select(*COLUMNS)
    repeated = judged.where("stays AND rows > 1").select(*key)
    if repeated.isEmpty():
        return kept
    least = named.join(repeated, key, "left_semi").groupBy(*key).agg(F.min(F.struct(*COLUMNS)).alias("r")).select("r.*")
    return kept.unionByName(least)


#: Bytes from which a passage that repeats is cut: what 50 words come to, less what short words may save.
PASSAGE = 240
#: More than 50 words are a passage even where they come to fewer bytes.
WORDS = 51


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without what strings of ``PASSAGE`` bytes or ``WORDS`` words cover that also stand elsewhere; ``n_chars`` follows the text."""
    found = suffix_dedup.cleaned(docs.select(*COLUMNS), PASSAGE, words=WORDS)
    return found.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in a window of a benchmark item."""
    found = decontam.judge(decontam.scan_documents(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    return found.where("NOT _contaminated").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of the bytes they decode to."""
    return bpe.roundtrip_digests(docs, public_tokenizers.path(bpe.RANKS))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_level_bpe", encode),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
