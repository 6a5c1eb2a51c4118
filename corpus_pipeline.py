"""Corpus pipeline: raw documents to packed training sequences.

Each stage takes the whole output of the one before it. All stages but the last
return the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelyst.llm import common, decontaminate, langid, line_dedup, minhash_dedup, packing

STAGES = [
    ("language ID", langid.stage),
    ("line dedup", line_dedup.stage),
    ("MinHash near-dedup", minhash_dedup.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("packing", packing.stage),
]

#: Learned languages, similarity classes and a trained tokenizer's ids are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared scratch folder and read back."""
    tables = common.Tables(spark, "pipeline")
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = tables.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        common.release(spark)
    return docs
