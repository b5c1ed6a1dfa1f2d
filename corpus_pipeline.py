"""The corpus pipeline: five stages over documents.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of
documents. ``run`` writes and rereads the documents between stages.

Null and empty texts and null ids go through every stage as its operator says:
they are scored as empty, link with nothing, lose nothing and are not repeated.
Repeated rows stay where a stage keeps one of them. Columns of other names are
left out; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, minhash, mixing, quality, suffix
from sparkloom.llm.common import Scratch, made, release

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows that the quality classifier predicts as good."""
    docs = docs.select(*COLUMNS)
    return quality.score_quality(spark, docs, quality.fit_quality(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), keep=COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near-duplicates (similarity of 0.8 or more)."""
    docs = docs.select(*COLUMNS)
    gone = minhash.near_duplicates(spark, docs, 80, 100).where("not kept").select("doc_id").distinct()
    once = docs.join(gone.hint("merge"), "doc_id", "left_anti")
    return once.select(*COLUMNS)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document has; n_chars follows the new text."""
    return suffix.without_repeats(spark, docs.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats rows by their rates; no row goes."""
    docs = docs.select(*COLUMNS)
    return mixing.mixed_documents(spark, docs, mixing.labelled_domains(spark, docs, sf_dir), mixing.tempered(0.7, True))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(spark, docs, *bpe.production_codec())


STAGES = [
    ("quality classifier", quality_stage),
    ("minhash near-dedup", near_duplicate_stage),
    ("suffix-array dedup", repeats_stage),
    ("mixing to target weights", mixing_stage),
    ("byte-level bpe", encoding_stage),
]

#: The stages learn models and encode tokens; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for no, (_, stage) in enumerate(STAGES):
        before = made()
        docs = stage(spark, docs, sf_dir)
        if no < len(STAGES) - 1:
            docs = scratch.write(docs, f"stage-{no}")
            release(before)  # the stage's own tables
            if no:
                scratch.drop(f"stage-{no - 1}")
    return docs
