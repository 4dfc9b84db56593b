"""Documents to packed training sequences, one operator a stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordlens.llm.base import table
from recordlens.llm.jaccard import keep_first_of_component
from recordlens.llm.language import reject_unclear_language
from recordlens.llm.packing import pack_documents
from recordlens.llm.quality import reject_low_quality
from recordlens.session import written

#: Each takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("language", reject_unclear_language),
    ("quality", reject_low_quality),
    ("near_copies", keep_first_of_component),
    ("packing", pack_documents),
]

#: Language and packing are not expressible in SQL; tests hold the rows against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
