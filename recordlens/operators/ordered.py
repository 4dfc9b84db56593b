"""Ordered-scan helpers that hold when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def previous_row(
    df: DataFrame, keys: list[str], segment: list[str], order: list[str], values: list[str]
) -> DataFrame:
    """Add ``prev``: the struct of ``values`` of the preceding row of the same key.

    ``segment`` cuts a key's rows into ordered pieces of bounded size. The row before is
    looked up inside a piece first; only one closing row per piece travels to the
    key-level window, so a hot key is spread over as many tasks as it has pieces.
    """
    inside = Window.partitionBy(*keys, *segment).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(*segment)
    rows = df.withColumn("_value", F.struct(*values)).withColumn("_lag", F.lag("_value").over(inside))
    rows = rows.withColumn("_head", F.row_number().over(inside) == 1)
    tails = (
        df.groupBy(*keys, *segment)
        .agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_tail"))
        .withColumn("_carried", F.lag("_tail").over(across))
        .drop("_tail")
    )
    return (
        rows.join(tails, [*keys, *segment])
        .withColumn("prev", F.when(F.col("_head"), F.col("_carried")).otherwise(F.col("_lag")))
        .drop("_value", "_lag", "_head", "_carried")
    )


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of every key; Spark prunes to ``n`` per task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def calendar_array(df: DataFrame, day: str) -> DataFrame:
    """One row holding the sorted distinct days. Bounded by the number of days on record."""
    return df.agg(F.array_sort(F.collect_set(day)).alias("days"))


def day_index(df: DataFrame, day: str) -> DataFrame:
    """(day, day_idx): dense zero-based position of every distinct day."""
    return calendar_array(df, day).select(F.posexplode("days").alias("day_idx", day))
