"""Streaming queries; each must agree with the batch form over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlens import vocab as v
from recordlens.operators import drift as dr
from recordlens.operators.reaction import trailing_baseline
from recordlens.functions.rates import share
from recordlens.plans import coverage_plans as cvp
from recordlens.plans import register_plans as rgp
from recordlens.plans.tables import day_text, table
from recordlens.session import shared_folder, written
from recordlens.streaming import nights as st


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.withColumn("at", st.utc_instant(F.col("ts")))


def stream_register_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month of nights, announced in three parts, one night ten days late, folded batch by batch."""
    base = shared_folder(spark, "fold-stream")
    obs = rgp.nightly_observations(spark, sf_dir)
    obs.repartition("run_date").write.partitionBy("run_date").parquet(f"{base}/observations")
    stored = spark.read.schema(obs.schema).parquet(f"{base}/observations")
    dates = stored.select("run_date").distinct()
    for part in ("run_date <= '2024-01-10'", "run_date > '2024-01-10' AND run_date <= '2024-01-20' AND run_date <> '2024-01-13'", "run_date > '2024-01-20' OR run_date = '2024-01-13'"):
        dates.filter(part).coalesce(1).write.mode("append").parquet(f"{base}/announced")
    announced = spark.readStream.schema("run_date string").option("maxFilesPerTrigger", 1).parquet(f"{base}/announced")
    writer = st.fold_night_batches(
        announced, lambda ns: stored.filter(F.col("run_date").isin(ns)), base, carried=rgp.CARRIED, one_per_night=True
    )
    st.run_to_end(writer)
    return rgp._event_view(st.folded_events(spark, base))


def stream_daily_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed days only; the running ones stay open."""
    ev = _event_stream(spark, sf_dir)
    rows = ev.select(
        "at", F.concat(F.lit("F"), (F.col("user_id") % 25).cast("string")).alias("country"),
        F.floor("value").cast("bigint").alias("articles"),
        F.regexp_extract("props", r"(\d+)", 1).cast("bigint").alias("mentions"),
    )
    base = shared_folder(spark, "volume-stream")
    st.run_to_end(st.append_stream(st.daily_volume_stream(rows, "at", "country"), base))
    return spark.read.parquet(f"{base}/data")


def stream_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing baseline over the days a stream has committed."""
    daily = stream_daily_volume(spark, sf_dir).select("country", "day", "articles")
    out = trailing_baseline(daily, daily.select("day"), key="country")
    return out.select("country", "day", "baseline_median", share(F.col("articles"), F.col("baseline_median"), 2).alias("ratio"))


def stream_first_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message per event type and user."""
    ev = _event_stream(spark, sf_dir)
    first = st.first_message_wins(ev.select("event_type", "user_id", "at"), ["event_type", "user_id"], "at", "60 days")
    base = shared_folder(spark, "first-stream")
    st.run_to_end(st.append_stream(first.select("event_type", "user_id"), base))
    return spark.read.parquet(f"{base}/data")


def stream_first_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's first message per event type and user with its payload, from files dealt by chance."""
    base = shared_folder(spark, "payload-stream")
    ev = table(spark, sf_dir, "events").withColumn("at", st.utc_instant(F.col("ts")))
    ev.repartition(6, F.xxhash64("event_id")).write.parquet(f"{base}/events")
    stream = spark.readStream.schema(spark.read.parquet(f"{base}/events").schema).parquet(f"{base}/events")
    first = st.least_message_stream(stream, ["event_type", "user_id"], "at", ["at", "event_id"], ["value", "props"])
    out = first.select(st.utc_day(F.col("starts")).alias("day"), "event_type", "user_id", "event_id", "value", "props")
    st.run_to_end(st.append_stream(out, base))
    return spark.read.parquet(f"{base}/data")


def stream_late_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily volume from four deliveries: rows of a reported day come too late, rows of an open one don't.

    The third delivery brings a tenth of the third of January when that day has been
    reported; the fourth brings a tenth of the nineteenth, which is still open.
    """
    base = shared_folder(spark, "late-stream")
    ev = table(spark, sf_dir, "events").select(
        st.utc_instant(F.col("ts")).alias("at"), day_text("ts").alias("d"), (F.col("event_id") % 10 == 0).alias("held_back"),
        F.col("event_type").alias("country"), F.floor("value").cast("bigint").alias("articles"), F.regexp_extract("props", r"(\d+)", 1).cast("bigint").alias("mentions"),
    )
    early, late = F.col("held_back") & (F.col("d") == "2024-01-03"), F.col("held_back") & (F.col("d") == "2024-01-19")
    between = F.col("d").between
    for part in ((F.col("d") <= "2024-01-10") & ~early, between("2024-01-11", "2024-01-15"), (between("2024-01-16", "2024-01-20") & ~late) | early, (F.col("d") > "2024-01-20") | late):
        ev.filter(part).drop("d", "held_back").coalesce(1).write.mode("append").parquet(f"{base}/deliveries")
    schema = spark.read.parquet(f"{base}/deliveries").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/deliveries")
    st.run_to_end(st.append_stream(st.daily_volume_stream(stream, "at", "country"), base))
    return spark.read.parquet(f"{base}/data")


def stream_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-back answers arriving as files, compared with the first-held values."""
    held, _, _ = cvp._drift_inputs(spark, sf_dir)
    held = written(held, "held")
    latest = cvp._latest(spark, sf_dir)
    base = shared_folder(spark, "drift-stream")
    answers = dr.held_values(latest).select(
        "id", (~F.col("value").between(9, 10)).alias("asked"), (F.col("value") >= 3).alias("present"), *v.DRIFT_FIELDS
    )
    answers.repartition(2).write.parquet(f"{base}/answers")
    schema = spark.read.parquet(f"{base}/answers").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/answers")
    st.run_to_end(st.drift_stream(stream, held, v.DRIFT_FIELDS, base))
    return spark.read.parquet(f"{base}/findings").drop("epoch")


# --- the same in SQL ---------------------------------------------------------

_DAYS = """
WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, 'F' || (user_id % 25) AS country, count(*) AS events,
    CAST(sum(floor(value)) AS BIGINT) AS articles, CAST(sum(CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT)) AS BIGINT) AS mentions
  FROM events GROUP BY 1, 2),
done AS (SELECT * FROM d WHERE CAST(day AS DATE) + 2 <= (SELECT max(ts) FROM events))
"""

QUERIES = {
    "stream_register_fold": stream_register_fold,
    "stream_daily_volume": stream_daily_volume,
    "stream_baseline": stream_baseline,
    "stream_first_message": stream_first_message,
    "stream_first_payload": stream_first_payload,
    "stream_late_volume": stream_late_volume,
    "stream_drift": stream_drift,
}

ORACLES = {
    "stream_register_fold": rgp.ORACLES["register_fold"],
    "stream_daily_volume": _DAYS + "SELECT * FROM done",
    "stream_baseline": _DAYS + """
      , days AS (SELECT day, row_number() OVER (ORDER BY day) AS i FROM (SELECT DISTINCT day FROM done)),
      f AS (SELECT done.*, i FROM done JOIN days ON days.day = done.day),
      b AS (SELECT f.country, f.day, f.articles, median(coalesce(h.articles, 0)) FILTER (w.i IS NOT NULL) AS m
            FROM f LEFT JOIN days w ON w.i BETWEEN f.i - 28 AND f.i - 1
            LEFT JOIN done h ON h.country = f.country AND h.day = w.day GROUP BY ALL)
      SELECT country, day, m AS baseline_median, CASE WHEN m <> 0 THEN round_even((articles / m) * 100, 0) / 100 END AS ratio FROM b""",
    "stream_first_message": "SELECT DISTINCT event_type, user_id FROM events",
    "stream_first_payload": """
      SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, user_id, event_id, value, props FROM events
      WHERE CAST(ts AS DATE) + 2 <= (SELECT max(ts) FROM events)
      QUALIFY row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d'), event_type, user_id ORDER BY ts, event_id) = 1""",
    "stream_late_volume": """
      SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS country, count(*) AS events, CAST(sum(floor(value)) AS BIGINT) AS articles,
        CAST(sum(CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT)) AS BIGINT) AS mentions FROM events
      WHERE CAST(ts AS DATE) + 2 <= (SELECT max(ts) FROM events)
        AND NOT (strftime(ts, '%Y-%m-%d') = '2024-01-03' AND event_id % 10 = 0)
      GROUP BY 1, 2""",
    "stream_drift": cvp.ORACLES["drift_findings"],
}
