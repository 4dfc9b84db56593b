"""Measured verdicts for closed records, from the event table alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens import vocab as v
from recordlens.functions import clock, text
from recordlens.functions.rates import rounded
from recordlens.operators.register import EVENT_ORDER, cold_start_flags


def severity_paths(events: DataFrame, *, key: str = "id", night: str = "run_date") -> DataFrame:
    """(key, severity_path, escalated, revisions): levels in order of change, blanks dropped.

    Escalated: the top of the ladder was reached after the first level, and not held from
    the start. The path has one entry per recorded change of level.
    """
    at = F.struct(night, *EVENT_ORDER)
    change = F.col("changes")["severity"]
    step = F.when(change.isNotNull(), F.struct(at.alias("at"), change["from"].alias("a"), change["to"].alias("b")))
    grouped = events.groupBy(key).agg(
        F.array_sort(F.collect_list(step)).alias("_steps"),
        F.max_by(F.col("held")["severity"], at).alias("_held"),
        F.count_if(F.col("event") == "REVISED").alias("revisions"),
    )
    moved = F.concat(
        F.slice(F.transform("_steps", lambda s: s["a"]), 1, 1), F.transform("_steps", lambda s: s["b"])
    )
    path = F.when(F.size("_steps") > 0, moved).otherwise(F.array("_held"))
    out = grouped.withColumn("severity_path", F.filter(path, lambda s: s.isNotNull() & (s != "")))
    top = lambda s: s.isin(*v.TOP_OF_LADDER)
    started = F.get("severity_path", F.lit(0))
    rest = F.when(F.size("severity_path") > 1, F.slice("severity_path", 2, F.size("severity_path") - 1)).otherwise(
        F.array().cast("array<string>")
    )
    escalated = F.exists(rest, top) & ~F.coalesce(top(started), F.lit(False))
    return out.select(key, "severity_path", escalated.alias("escalated"), "revisions")


def evidence(events: DataFrame, *, key: str = "id") -> DataFrame:
    """(key, evidence): sorted distinct files the record's events rest on."""
    return (
        events.filter(F.coalesce("snapshot", F.lit("")) != "")
        .groupBy(key)
        .agg(F.array_sort(F.collect_set("snapshot")).alias("evidence"))
    )


def storm_matches(current: DataFrame, *, key: str = "id") -> DataFrame:
    """(token, matched, matched_from): smallest cyclone alert record per storm name."""
    return (
        current.filter((F.col("kind") == "ALERT_EPISODE") & (F.col("hazard") == "tropical cyclone"))
        .withColumn("token", text.storm_token(F.col("what")))
        .filter("token IS NOT NULL")
        .groupBy("token")
        .agg(
            F.min(key).alias("matched"),
            F.min_by(F.col("window")["from"], F.col(key)).alias("matched_from"),
        )
    )


def verdicts(
    current: DataFrame, events: DataFrame, *, done: DataFrame | None = None, key: str = "id",
    night: str = "run_date",
) -> DataFrame:
    """One verdict per closed record not yet in ``done``.

    Alert episodes end as EPISODE_ENDED; forecasts are MATERIALIZED_AS_ALERT when an alert
    record of the same storm is in the register, else NO_ALERT_MATCH. A verdict is dated by
    the closing event it rests on.
    """
    none = F.array().cast("array<string>")
    closed = cold_start_flags(current).filter(F.col("status") != v.OPEN)
    if done is not None:
        closed = closed.join(done.select(key), key, "left_anti")
    forecast = F.col("kind") != "ALERT_EPISODE"
    files = evidence(events, key=key)
    # Only forecasts with a storm's name look for a match; the rest never meet on a null.
    named = closed.filter(forecast).select(key, text.storm_token(F.col("what")).alias("token")).filter("token IS NOT NULL")
    matches = named.join(storm_matches(current, key=key), "token").select(key, "matched", "matched_from")
    theirs = files.select(F.col(key).alias("matched"), F.col("evidence").alias("_matched_files"))
    matches = matches.join(theirs, "matched", "left")
    rows = (
        closed.join(matches, key, "left")
        .join(severity_paths(events, key=key, night=night).drop("revisions"), key, "left")
        .join(files, key, "left")
    )
    start, end = clock.iso_seconds(F.col("window")["from"]), clock.iso_seconds(F.col("window")["to"])
    lead = clock.iso_seconds(F.col("matched_from")) - clock.iso_seconds(F.col("announced_at"))
    verdict = (
        F.when(~forecast, "EPISODE_ENDED")
        .when(F.col("matched").isNotNull(), "MATERIALIZED_AS_ALERT")
        .otherwise("NO_ALERT_MATCH")
    )
    own, theirs = F.coalesce("evidence", none), F.coalesce("_matched_files", none)
    return rows.select(
        key,
        verdict.alias("verdict"),
        F.col("last_event_at").alias("resolved_at"),
        "cold_start",
        "severity_path",
        "escalated",
        "revisions",
        F.when(~forecast, F.col("window")).alias("episode_window"),
        F.when(~forecast, rounded((end - start) / 86400, 1)).alias("episode_days"),
        "matched",
        rounded(lead / 3600, 1).alias("lead_time_hours"),
        F.array_sort(F.array_union(own, theirs)).alias("evidence"),
    )
