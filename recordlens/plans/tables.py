"""Reading the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day_text(col):
    return F.date_format(col, "yyyy-MM-dd")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread rows by key when the input has fewer than four pieces a core.

    For work that is heavy per row (whole texts), or rows that become many and are sorted:
    four pieces a core keep what one task holds small. Inputs with many files are left alone.
    """
    pieces = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(pieces, key) if df.rdd.getNumPartitions() < pieces else df
