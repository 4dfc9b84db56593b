"""Drift of held products: what the source says now against what was first preserved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

from recordlens import vocab as v


def first_seen(readings: DataFrame, *, key: str = "id", order: tuple[str, ...] = ("date", "pos")) -> DataFrame:
    """The first reading of every product, with ``first_seen`` its date.

    A minimum over an ordered struct: combined map-side, whatever a product's share of
    the readings.
    """
    rest = [c for c in readings.columns if c not in (key, *order)]
    out = readings.groupBy(key).agg(F.min_by(F.struct(order[0], *rest), F.struct(*order)).alias("_f"))
    return out.select(key, F.col(f"_f.{order[0]}").alias("first_seen"), *[F.col(f"_f.{c}").alias(c) for c in rest])


def _held_text(value: Column, is_map: bool) -> Column:
    """Comparable text of a value; null for nothing held (null or an empty map)."""
    if not is_map:
        return value.cast("string")
    entries = F.array_sort(F.map_entries(value))
    return F.when(
        F.size(entries) > 0,
        F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","),
    )


def held_values(products: DataFrame, fields: tuple[str, ...] = v.DRIFT_FIELDS) -> DataFrame:
    """Each compared field as comparable text."""
    schema: StructType = products.schema
    texts = {f: _held_text(F.col(f), isinstance(schema[f].dataType, MapType)) for f in fields}
    return products.withColumns(texts)


def with_baselines(
    held: DataFrame, baselines: DataFrame, fields: tuple[str, ...] = v.DRIFT_FIELDS, *, key: str = "id",
    date: str = "date",
) -> DataFrame:
    """Fill fields never preserved with the earliest baseline established for them.

    ``held`` as from :func:`held_values`; ``baselines``: key, field, value, date.
    """
    aggs = [
        F.min_by("value", F.when(F.col("field") == f, F.col(date))).alias(f"_b_{f}") for f in fields
    ]
    first = baselines.groupBy(key).agg(*aggs)
    filled = {f: F.coalesce(F.col(f), F.col(f"_b_{f}")) for f in fields}
    return held.join(first, key, "left").withColumns(filled).drop(*[f"_b_{f}" for f in fields])


def drift(
    held: DataFrame, current: DataFrame, asked: DataFrame, fields: tuple[str, ...] = v.DRIFT_FIELDS, *,
    key: str = "id",
) -> DataFrame:
    """Compare held with current values, field by field.

    kind 'changed': both sides differ, given side by side; 'baseline': nothing was held
    and the source names a value now; 'gone_from_catalog': the product's batch was
    answered without it. ``asked``: key, answered. A batch without an answer proves
    nothing. One join brings both sides together; the fields are then compared in the row.
    """
    probed = asked.filter("answered").select(key).distinct()
    now = current.select(key, F.lit(True).alias("_there"), *[F.col(f).alias(f"_now_{f}") for f in fields])
    rows = held.join(probed, key, "left_semi").join(now, key, "left")
    there = F.col("_there").isNotNull()

    def finding(kind, field, then, current_value):
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(field).cast("string").alias("field"),
            then.alias("preserved"), current_value.alias("current"),
        )

    null = F.lit(None).cast("string")
    found = [F.when(~there, finding("gone_from_catalog", None, null, null))]
    for f in fields:
        then, value = F.col(f), F.col(f"_now_{f}")
        found.append(F.when(there & then.isNull() & value.isNotNull(), finding("baseline", f, then, value)))
        found.append(
            F.when(there & then.isNotNull() & ~then.eqNullSafe(value), finding("changed", f, then, value))
        )
    exploded = rows.select(key, "first_seen", F.explode(F.array_compact(F.array(*found))).alias("_x"))
    return exploded.select(key, "first_seen", "_x.*")


def product_states(held: DataFrame, findings: DataFrame, any_probe: bool = True, *, key: str = "id") -> DataFrame:
    """diverged if any probe caught a change or an absence, else held (unchecked without probes)."""
    caught = findings.filter("kind <> 'baseline'").select(key).distinct().withColumn("_caught", F.lit(True))
    quiet = "held" if any_probe else "unchecked"
    return held.join(caught, key, "left").select(
        key, "first_seen", F.when(F.col("_caught"), "diverged").otherwise(quiet).alias("state")
    )


def night_states(held: DataFrame, catches: DataFrame, nights: DataFrame, *, key: str = "id", night: str = "night") -> DataFrame:
    """Per night: products not yet recorded, still the same, and changed on that night.

    Counted from first-seen totals per day, so no product-by-night grid is built.
    """
    diverged = catches.join(held.select(key, "first_seen"), key).filter(F.col("first_seen") <= F.col(night))
    diverged = diverged.groupBy(night).agg(F.countDistinct(key).alias("diverged"))
    days = held.groupBy(F.col("first_seen").alias(night)).agg(F.count(F.lit(1)).alias("_n"), F.lit(False).alias("_asked"))
    asked = nights.select(night, F.lit(0).cast("bigint").alias("_n"), F.lit(True).alias("_asked"))
    days = days.unionByName(asked).groupBy(night).agg(F.sum("_n").alias("_n"), F.max("_asked").alias("_asked"))
    # One row per day is left here, so the running total is bounded by the days on record.
    so_far = F.sum("_n").over(Window.orderBy(night))
    known = days.withColumn("_known", so_far).filter("_asked")
    total = held.agg(F.count(F.lit(1))).scalar()
    return known.join(diverged, night, "left").select(
        night,
        (total - F.col("_known")).alias("before"),
        (F.col("_known") - F.coalesce("diverged", F.lit(0))).alias("same"),
        F.coalesce("diverged", F.lit(0)).alias("diverged"),
    )
