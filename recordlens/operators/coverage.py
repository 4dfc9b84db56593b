"""Observed footprints against declared positions on the fixed grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlens import vocab as v
from recordlens.functions import grid
from recordlens.functions.rates import rounded
from recordlens.operators.ordered import first_per_key


def footprint_cells(scenes: DataFrame, *, rings: str = "rings") -> DataFrame:
    """Add ``cells``: the grid cells whose centre lies in any of the outer rings."""
    return scenes.withColumn("cells", grid.covered_cells(F.col(rings)))


def acquisitions(scenes: DataFrame, *, night: str = "night") -> DataFrame:
    """One scene per (platform, start, end): the first by start and name."""
    return first_per_key(scenes, [night, "platform", "start", "end"], [F.col("start"), F.col("name")])


def observed_passes(acquired: DataFrame, *, night: str = "night") -> DataFrame:
    """(night, cell, observed_passes)."""
    return (
        acquired.select(night, F.explode("cells").alias("cell"))
        .groupBy(night, "cell")
        .agg(F.count(F.lit(1)).alias("observed_passes"))
    )


def point_cells(positions: DataFrame, *, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Add ``cell``: null outside the region."""
    return positions.withColumn("cell", grid.cell_of(F.col(lon), F.col(lat)))


def declared_counts(positions: DataFrame, *, night: str = "night") -> DataFrame:
    """(night, cell, declared_sample) from positions that carry a cell."""
    return (
        positions.filter("cell IS NOT NULL")
        .groupBy(night, "cell")
        .agg(F.count(F.lit(1)).alias("declared_sample"))
    )


def declared_totals(positions: DataFrame, *, night: str = "night") -> DataFrame:
    """Per night: positions in the feed and inside the region."""
    return positions.groupBy(night).agg(
        F.count(F.lit(1)).alias("in_feed"), F.count("cell").alias("in_region")
    )


def two_axes(observed: DataFrame, declared: DataFrame, *, night: str = "night") -> DataFrame:
    """Full outer comparison per cell; a side without a row counts 0."""
    return observed.join(declared, [night, "cell"], "full").select(
        night,
        "cell",
        F.coalesce("observed_passes", F.lit(0)).alias("observed_passes"),
        F.coalesce("declared_sample", F.lit(0)).alias("declared_sample"),
    )


def coverage_figures(cells: DataFrame, scenes: DataFrame, acquired: DataFrame, *, night: str = "night") -> DataFrame:
    """Per night: products, acquisitions, and the five cell counts of the comparison."""
    o, d = F.col("observed_passes") > 0, F.col("declared_sample") > 0
    counted = cells.groupBy(night).agg(
        F.count_if(o).alias("cells_observed"),
        F.count_if(d).alias("cells_declared"),
        F.count_if(o & d).alias("cells_both"),
        F.count_if(o & ~d).alias("cells_observed_silent"),
        F.count_if(~o & d).alias("cells_declared_unobserved"),
    )
    products = scenes.groupBy(night).agg(F.count(F.lit(1)).alias("catalog_products"))
    acq = acquired.groupBy(night).agg(F.count(F.lit(1)).alias("acquisitions"))
    joined = products.join(acq, night, "full").join(counted, night, "full")
    return joined.na.fill(0)


def _spread(name: str, value: Column) -> list[Column]:
    return [
        F.median(value).alias(f"{name}_median"),
        F.min(value).alias(f"{name}_min"),
        F.max(value).alias(f"{name}_max"),
        rounded(F.stddev_samp(value), 4).alias(f"{name}_sd"),
    ]


def sampled_on_time(samples: DataFrame, scheduled: str, minutes: int = v.SAMPLE_TOLERANCE_MIN, *, at: str = "sampled_at") -> DataFrame:
    """samples with ``on_time``: taken within so many minutes of the scheduled time of day (HH:mm, UTC).

    The nearest scheduled time counts, also across midnight. A sample without a time is late.
    """
    time = F.col(at).try_cast("timestamp")
    hour, minute = (int(x) for x in scheduled.split(":"))
    off = F.pmod(F.unix_seconds(time) / 60 - (hour * 60 + minute), F.lit(1440))
    return samples.withColumn("on_time", F.coalesce(F.least(off, 1440 - off) <= minutes, F.lit(False)))


def window_figures(cells: DataFrame, *, night: str = "night", samples: DataFrame | None = None) -> DataFrame:
    """Median, extremes and spread over the nights of a window.

    ``samples`` (night, on_time, see :func:`sampled_on_time`): nights whose declared sample
    was not taken on time stay on record but don't enter the figures.

    The envelope is every cell declared at least once in the window; the discrepancy rate
    is the share of a night's observed envelope cells without a declaration.
    """
    if samples is not None:
        cells = cells.join(samples.filter("on_time").select(night).distinct(), night, "left_semi")
    envelope = cells.filter("declared_sample > 0").select("cell").distinct()
    o, d = F.col("observed_passes") > 0, F.col("declared_sample") > 0
    inside = cells.join(envelope, "cell", "left_semi").groupBy(night).agg(
        F.count_if(o).alias("_o"), F.count_if(o & ~d).alias("_silent")
    )
    nights = (
        cells.groupBy(night)
        .agg(F.count_if(o).alias("observed"), F.count_if(d).alias("declared"))
        .join(inside, night, "left")
        .withColumn("rate", F.when(F.col("_o") > 0, F.col("_silent") / F.col("_o")))
    )
    rate = rounded(F.col("rate"), 4)
    return nights.agg(
        F.count(F.lit(1)).alias("nights"),
        *_spread("observed", F.col("observed")),
        *_spread("declared", F.col("declared")),
        *_spread("discrepancy", rate),
    )
