"""Grid and drift queries: embeddings as places, events as product readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlens.operators import coverage as cov
from recordlens.operators import drift as dr
from recordlens.plans.tables import day_text, table
from recordlens.session import written


def _vec(i: int):
    return F.col("embedding")[i].cast("double")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id",
        "label",
        F.concat(F.lit("2024-01-0"), (F.col("vec_id") % 7 + 1).cast("string")).alias("night"),
        (_vec(0) * 40 + 19.5).alias("lon"),
        (_vec(1) * 22 + 59.75).alias("lat"),
        (F.abs(_vec(2)) * 3 + 0.6).alias("w"),
        (F.abs(_vec(3)) * 2 + 0.5).alias("h"),
    )


def _point(x, y):
    return F.struct(x.alias("lon"), y.alias("lat"))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tilted footprint per vector; every third label adds a box beside it."""
    p = _places(spark, sf_dir)
    x, y, w, h = (F.col(c) for c in ("lon", "lat", "w", "h"))
    tilted = F.array(_point(x - w, y), _point(x, y - h), _point(x + w, y), _point(x, y + h), _point(x - w, y))
    box = F.array(
        _point(x + 1, y - h), _point(x + 1 + w, y - h), _point(x + 1 + w, y), _point(x + 1, y), _point(x + 1, y - h)
    )
    rings = F.when(F.col("label") % 3 == 0, F.array(tilted, box)).otherwise(F.array(tilted))
    platform = F.when(F.col("label") % 2 == 0, "S1A").otherwise("S1C")
    start = F.concat("night", F.lit("T0"), F.col("label").cast("string"), F.lit(":00"))
    return p.select(
        "vec_id", "night", platform.alias("platform"), start.alias("start"),
        F.concat("night", F.lit("T2"), (F.col("vec_id") % 3).cast("string"), F.lit(":00")).alias("end"),
        F.concat(platform, F.lit("_GRD_"), F.col("vec_id").cast("string")).alias("name"),
        rings.alias("rings"),
    )


def footprint_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = cov.footprint_cells(scenes(spark, sf_dir))
    return cells.select("vec_id", F.explode("cells").alias("cell"))


def acquisition_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.acquisitions(scenes(spark, sf_dir)).select("night", "platform", "start", "end", "name")


def point_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.point_cells(_places(spark, sf_dir)).select("vec_id", "night", "cell")


def declared_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.declared_totals(cov.point_cells(_places(spark, sf_dir)))


def _axes(spark, sf_dir):
    sc = scenes(spark, sf_dir)
    acq = cov.footprint_cells(cov.acquisitions(sc))
    declared = cov.declared_counts(cov.point_cells(_places(spark, sf_dir)))
    return sc, acq, cov.two_axes(cov.observed_passes(acq), declared)


def grid_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _axes(spark, sf_dir)[2]


def coverage_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    sc, acq, cells = _axes(spark, sf_dir)
    return cov.coverage_figures(cells, sc, acq)


def window_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nights sampled on time only; a night's sample is taken some minutes after one o'clock, by its date."""
    cells = _axes(spark, sf_dir)[2]
    late = (F.dayofmonth(F.to_date("night")) * 37) % 240
    at = F.date_format(F.timestamp_seconds(F.unix_seconds(F.to_timestamp("night")) + 3600 + late * 60), "yyyy-MM-dd'T'HH:mm:ss")
    samples = cov.sampled_on_time(cells.select("night").distinct().withColumn("sampled_at", at), "02:15")
    return cov.window_figures(cells, samples=samples)


# --- drift: every (event type, user) is a product, every event a reading ----------------


def _product_fields(df: DataFrame) -> DataFrame:
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    text = lambda p, m: F.concat(F.lit(p), (k % m).cast("string"))
    sums = F.create_map(F.lit("md5"), text("m", 2), F.lit("blake3"), text("b", 3))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return df.withColumns(
        {
            "online": k % 4 > 0,
            "eviction_date": F.when(k % 5 > 0, text("2024-06-0", 2)),
            "modification_date": F.when(k % 3 > 0, text("2024-02-0", 2)),
            "checksums": F.when(k % 11 > 0, sums).otherwise(empty),
        }
    )


def product_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _product_fields(table(spark, sf_dir, "events"))
    return ev.select(
        F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("id"),
        day_text("ts").alias("date"), F.col("event_id").alias("pos"), "user_id",
        "online", "eviction_date", "modification_date", "checksums",
    )


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    last = ev.groupBy("event_type", "user_id").agg(F.max(F.struct("ts", "event_id", "value", "props")).alias("e"))
    flat = last.select("event_type", "user_id", "e.*")
    return _product_fields(flat).withColumn("id", F.concat_ws("-", "event_type", F.col("user_id").cast("string")))


def _drift_inputs(spark, sf_dir):
    held = dr.held_values(dr.first_seen(product_readings(spark, sf_dir)))
    late = _product_fields(table(spark, sf_dir, "events"))
    ids = F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("id")
    base = late.filter("eviction_date IS NOT NULL").select(
        ids, F.lit("eviction_date").alias("field"), F.col("eviction_date").alias("value"),
        F.struct(day_text("ts").alias("day"), "event_id").alias("date"),
    )
    held = dr.with_baselines(held, base)
    latest = _latest(spark, sf_dir)
    answered = ~F.col("value").between(9, 10)
    asked = latest.select("id", answered.alias("answered"))
    current = dr.held_values(latest.filter((F.col("value") >= 3) & answered))
    return held, current, asked


def drift_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dr.drift(*_drift_inputs(spark, sf_dir))


def product_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, current, asked = _drift_inputs(spark, sf_dir)
    return dr.product_states(held, dr.drift(held, current, asked))


def first_seen_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dr.held_values(dr.first_seen(product_readings(spark, sf_dir)))
    return out.select("id", "first_seen", F.col("online"), "eviction_date", "modification_date", "checksums")


def night_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nights of the month; a product diverges on nights its readings differ from the first."""
    readings = written(product_readings(spark, sf_dir), "product-readings")
    held = dr.held_values(dr.first_seen(readings))
    now = dr.held_values(readings)
    differs = now.alias("n").join(held.alias("h"), "id").filter(
        F.col("h.eviction_date").isNotNull() & ~F.col("h.eviction_date").eqNullSafe(F.col("n.eviction_date"))
    )
    catches = differs.select("id", F.col("n.date").alias("night")).distinct()
    nights = readings.select(F.col("date").alias("night")).distinct()
    return dr.night_states(held, catches, nights)


# --- the same in SQL ---------------------------------------------------------

_PLACES = """
WITH place AS (SELECT vec_id, label, '2024-01-0' || (vec_id % 7 + 1) AS night,
    CAST(embedding[1] AS DOUBLE) * 40 + 19.5::DOUBLE AS lon, CAST(embedding[2] AS DOUBLE) * 22 + 59.75::DOUBLE AS lat,
    abs(CAST(embedding[3] AS DOUBLE)) * 3 + 0.6::DOUBLE AS w, abs(CAST(embedding[4] AS DOUBLE)) * 2 + 0.5::DOUBLE AS h FROM embeddings),
scene AS (SELECT vec_id, night, CASE WHEN label % 2 = 0 THEN 'S1A' ELSE 'S1C' END AS platform,
    night || 'T0' || label || ':00' AS "start", night || 'T2' || (vec_id % 3) || ':00' AS "end", lon AS x, lat AS y, w, h, label,
    CASE WHEN label % 2 = 0 THEN 'S1A' ELSE 'S1C' END || '_GRD_' || vec_id AS name FROM place),
edge AS (
  SELECT vec_id, 1 AS ring, unnest([{'px': x-w, 'py': y, 'x': x, 'y': y-h}, {'px': x, 'py': y-h, 'x': x+w, 'y': y},
     {'px': x+w, 'py': y, 'x': x, 'y': y+h}, {'px': x, 'py': y+h, 'x': x-w, 'y': y}]) AS e FROM scene
  UNION ALL
  SELECT vec_id, 2, unnest([{'px': x+1, 'py': y-h, 'x': x+1+w, 'y': y-h}, {'px': x+1+w, 'py': y-h, 'x': x+1+w, 'y': y},
     {'px': x+1+w, 'py': y, 'x': x+1, 'y': y}, {'px': x+1, 'py': y, 'x': x+1, 'y': y-h}]) FROM scene WHERE label % 3 = 0),
cell AS (SELECT 'E' || printf('%.1f', 9 + i * 0.5) || '_N' || printf('%.1f', 53.5 + j * 0.5) AS cell,
    CAST(9.25 + i * 0.5 AS DOUBLE) AS cx, CAST(53.75 + j * 0.5 AS DOUBLE) AS cy
  FROM generate_series(0, 41) a(i), generate_series(0, 24) b(j)),
hit AS (SELECT vec_id, cell FROM (
    SELECT vec_id, ring, cell, count(*) FILTER ((e.y > cy) <> (e.py > cy) AND cx < (e.px - e.x) * (cy - e.y) / (e.py - e.y) + e.x) AS n
    FROM edge, cell GROUP BY vec_id, ring, cell) WHERE n % 2 = 1 GROUP BY vec_id, cell),
acq AS (SELECT * FROM scene QUALIFY row_number() OVER (PARTITION BY night, platform, "start", "end" ORDER BY "start", name) = 1),
obs AS (SELECT night, cell, count(*) AS n FROM acq JOIN hit ON hit.vec_id = acq.vec_id GROUP BY night, cell),
pc AS (SELECT vec_id, night, CASE WHEN lon >= 9 AND lon < 30 AND lat >= 53.5 AND lat < 66 THEN
    'E' || printf('%.1f', 9 + floor((lon - 9) / 0.5) * 0.5) || '_N' || printf('%.1f', 53.5 + floor((lat - 53.5) / 0.5) * 0.5) END AS cell FROM place),
dec AS (SELECT night, cell, count(*) AS n FROM pc WHERE cell IS NOT NULL GROUP BY night, cell),
both_axes AS (SELECT coalesce(o.night, d.night) AS night, coalesce(o.cell, d.cell) AS cell, coalesce(o.n, 0) AS observed_passes,
    coalesce(d.n, 0) AS declared_sample FROM obs o FULL JOIN dec d ON d.night = o.night AND d.cell = o.cell)
"""

_PRODUCTS = """
WITH ev AS (SELECT *, event_type || '-' || user_id AS id, strftime(ts, '%Y-%m-%d') AS date,
    CAST(regexp_extract(props, '(\\d+)', 1) AS INT) AS k FROM events),
f AS (SELECT *, CASE WHEN k % 4 > 0 THEN 'true' ELSE 'false' END AS online,
    CASE WHEN k % 5 > 0 THEN '2024-06-0' || (k % 2) END AS eviction_date,
    CASE WHEN k % 3 > 0 THEN '2024-02-0' || (k % 2) END AS modification_date,
    CASE WHEN k % 11 > 0 THEN 'blake3=b' || (k % 3) || ',md5=m' || (k % 2) END AS checksums FROM ev),
first_f AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY date, event_id) = 1),
base AS (SELECT id, arg_min(eviction_date, date || lpad(CAST(event_id AS VARCHAR), 12, '0')) AS b
         FROM f WHERE eviction_date IS NOT NULL GROUP BY id),
held AS (SELECT first_f.id, first_f.date AS first_seen, first_f.online, coalesce(first_f.eviction_date, b) AS eviction_date,
    first_f.modification_date, first_f.checksums FROM first_f LEFT JOIN base ON base.id = first_f.id),
now_f AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) = 1),
probe AS (SELECT h.*, n.value >= 3 AS there, n.online AS n1, n.eviction_date AS n2, n.modification_date AS n3, n.checksums AS n4
          FROM held h JOIN now_f n ON n.id = h.id WHERE NOT n.value BETWEEN 9 AND 10),
long AS (SELECT id, first_seen, unnest([
    {'field': 'online', 'a': online, 'b': n1}, {'field': 'eviction_date', 'a': eviction_date, 'b': n2},
    {'field': 'modification_date', 'a': modification_date, 'b': n3}, {'field': 'checksums', 'a': checksums, 'b': n4}], recursive := true)
  FROM probe WHERE there),
found AS (
  SELECT id, first_seen, 'gone_from_catalog' AS kind, NULL AS field, NULL AS preserved, NULL AS current FROM probe WHERE NOT there
  UNION ALL SELECT id, first_seen, 'baseline', field, a, b FROM long WHERE a IS NULL AND b IS NOT NULL
  UNION ALL SELECT id, first_seen, 'changed', field, a, b FROM long WHERE a IS NOT NULL AND a IS DISTINCT FROM b)
"""


def _spread_sql(name: str, col: str) -> str:
    return (
        f"CAST(median({col}) AS DOUBLE) AS {name}_median, min({col}) AS {name}_min, max({col}) AS {name}_max, "
        f"round_even(stddev_samp({col}) * 10000, 0) / 10000 AS {name}_sd"
    )


QUERIES = {
    "footprint_cells": footprint_cells,
    "acquisition_dedup": acquisition_dedup,
    "point_cells": point_cells,
    "declared_totals": declared_totals,
    "grid_counts": grid_counts,
    "coverage_figures": coverage_figures,
    "window_figures": window_figures,
    "first_seen_products": first_seen_products,
    "drift_findings": drift_findings,
    "product_states": product_states,
    "night_states": night_states,
}

ORACLES = {
    "footprint_cells": _PLACES + "SELECT vec_id, cell FROM hit",
    "acquisition_dedup": _PLACES + 'SELECT night, platform, "start", "end", name FROM acq',
    "point_cells": _PLACES + "SELECT vec_id, night, cell FROM pc",
    "declared_totals": _PLACES + "SELECT night, count(*) AS in_feed, count(cell) AS in_region FROM pc GROUP BY night",
    "grid_counts": _PLACES + "SELECT night, cell, observed_passes, declared_sample FROM both_axes",
    "coverage_figures": _PLACES + """
      , c AS (SELECT night, count(*) FILTER (observed_passes > 0) AS cells_observed, count(*) FILTER (declared_sample > 0) AS cells_declared,
        count(*) FILTER (observed_passes > 0 AND declared_sample > 0) AS cells_both,
        count(*) FILTER (observed_passes > 0 AND declared_sample = 0) AS cells_observed_silent,
        count(*) FILTER (observed_passes = 0 AND declared_sample > 0) AS cells_declared_unobserved FROM both_axes GROUP BY night)
      SELECT s.night, s.n AS catalog_products, (SELECT count(*) FROM acq WHERE acq.night = s.night) AS acquisitions, c.* EXCLUDE (night)
      FROM (SELECT night, count(*) AS n FROM scene GROUP BY night) s JOIN c ON c.night = s.night""",
    "window_figures": _PLACES + f"""
      , timely AS (SELECT * FROM both_axes WHERE 60 + (day(CAST(night AS DATE)) * 37) % 240 BETWEEN 135 - 90 AND 135 + 90),
      env AS (SELECT DISTINCT cell FROM timely WHERE declared_sample > 0),
      n AS (SELECT night, count(*) FILTER (observed_passes > 0) AS observed, count(*) FILTER (declared_sample > 0) AS declared,
        round_even(count(*) FILTER (observed_passes > 0 AND declared_sample = 0 AND cell IN (SELECT cell FROM env))
          / nullif(count(*) FILTER (observed_passes > 0 AND cell IN (SELECT cell FROM env)), 0) * 10000, 0) / 10000 AS rate
        FROM timely GROUP BY night)
      SELECT count(*) AS nights, {_spread_sql('observed', 'observed')}, {_spread_sql('declared', 'declared')},
        {_spread_sql('discrepancy', 'rate')} FROM n""",
    "first_seen_products": _PRODUCTS + """SELECT id, date AS first_seen, online, eviction_date, modification_date, checksums
      FROM first_f""",
    "drift_findings": _PRODUCTS + "SELECT * FROM found",
    "product_states": _PRODUCTS + """SELECT id, first_seen, CASE WHEN id IN (SELECT id FROM found WHERE kind <> 'baseline')
      THEN 'diverged' ELSE 'held' END AS state FROM held""",
    "night_states": _PRODUCTS + """
      , c AS (SELECT DISTINCT f.id, f.date AS night FROM f JOIN first_f h ON h.id = f.id
              WHERE h.eviction_date IS NOT NULL AND h.eviction_date IS DISTINCT FROM f.eviction_date),
      n AS (SELECT DISTINCT date AS night FROM f)
      SELECT night, (SELECT count(*) FROM first_f WHERE date > night) AS before,
        (SELECT count(*) FROM first_f WHERE date <= night) - (SELECT count(*) FROM c WHERE c.night = n.night) AS same,
        (SELECT count(*) FROM c WHERE c.night = n.night) AS diverged FROM n""",
}
