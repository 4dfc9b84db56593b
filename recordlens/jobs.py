"""The nightly jobs: scans, operators and sinks put together.

Each job takes tables of documents, never fetches anything, and either returns its tables
or appends them below ``base`` once per night.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlens import sinks
from recordlens import vocab as v
from recordlens.functions import text as tx
from recordlens.operators import captures as cp
from recordlens.operators import coverage as cov
from recordlens.operators import drift as dr
from recordlens.operators import register as reg
from recordlens.operators import verdicts as ver
from recordlens.operators import wording as wd
from recordlens.session import written
from recordlens.sources import catalogue, feeds


def register_night(
    spark: SparkSession, base: str, run_date: str, bodies: dict[str, DataFrame], fetches: DataFrame, previous: str | None = None
) -> None:
    """One night of warning feeds: fold, commit events and state, settle closed records.

    ``bodies``: documents per source; ``fetches``: source, run_date, http_status, body;
    ``previous``: the last committed night. A night on record is refused. The run record is
    written last and every other write replaces or skips its own earlier attempt, so a job
    that broke off can simply be run again.
    """
    runs = spark.range(1).select(F.lit(run_date).alias("date"), F.lit(True).alias("recorded"))
    sinks.refuse_recorded(runs, f"{base}/runs")
    recorded = sinks.existing(spark, f"{base}/runs")
    newest = recorded.agg(F.max("date")).first()[0] if recorded is not None else None
    if newest is not None and str(newest) > run_date:
        raise sinks.AlreadyRecorded(f"{run_date} comes before {newest}, which is on record")
    state = spark.read.parquet(f"{base}/state/run={previous}") if previous else None
    events = reg.register_fold(feeds.all_observations(bodies), feeds.answered_nights(fetches), state=state)
    events.write.mode("overwrite").parquet(f"{base}/events/run={run_date}")
    tonight = spark.read.parquet(f"{base}/events/run={run_date}")
    reg.advance_state(tonight, state).write.mode("overwrite").parquet(f"{base}/state/run={run_date}")
    # A verdict rests on the history of its record, and for a forecast on that of the alerts it
    # may have become: records let go since the last night on record, and alerts.
    written = spark.read.parquet(f"{base}/events")
    since = F.lit(True) if newest is None else F.col("run").cast("string") > str(newest)
    let_go = written.filter(since & F.col("event").isin(v.CLOSED_BY_SOURCE, v.DISSIPATED)).select("id", "kind").distinct()
    wanted = let_go.select("id")
    if not let_go.filter("kind = 'FORECAST'").isEmpty():
        wanted = wanted.unionByName(written.filter("kind = 'ALERT_EPISODE'").select("id")).distinct()
    history = written.drop("run").join(wanted, "id", "left_semi")
    done = sinks.held_rows(spark, f"{base}/verdicts", "id", before=run_date)
    sinks.append_new(ver.verdicts(reg.register_current(history), history, done=done), f"{base}/verdicts", "id", run=run_date)
    sinks.append_once(runs, f"{base}/runs", run=run_date)


def coverage_night(catalogue_bodies: DataFrame, position_bodies: DataFrame) -> dict[str, DataFrame]:
    """Footprints against declared positions of a night."""
    scenes = catalogue.scenes(catalogue_bodies)
    acquired = cov.footprint_cells(cov.acquisitions(scenes))
    positions = cov.point_cells(catalogue.positions(position_bodies))
    cells = cov.two_axes(cov.observed_passes(acquired), cov.declared_counts(positions))
    return {
        "acquisitions": acquired,
        "cells": cells,
        "declared": cov.declared_totals(positions),
        "figures": cov.coverage_figures(cells, scenes, acquired),
    }


def lookback_night(readings: DataFrame, baselines: DataFrame, answers: DataFrame, asked: DataFrame) -> dict[str, DataFrame]:
    """Held products against the source's answers of a night; nothing held is changed."""
    held = dr.with_baselines(dr.held_values(dr.first_seen(readings)), baselines)
    findings = dr.drift(held, dr.held_values(answers), asked)
    return {
        "catches": findings.filter("kind <> 'baseline'"),
        "baselines": findings.filter("kind = 'baseline'").select("id", "field", F.col("current").alias("value")),
        "states": dr.product_states(held, findings),
    }


def wording_night(
    pages: DataFrame, captures: DataFrame, bodies: DataFrame, live: DataFrame, day: str, cap: int | None = None
) -> dict[str, DataFrame]:
    """Histories, gate, diff, typed events and rates of one completed day.

    ``pages``: page, category; ``captures``: archive rows per page; ``bodies``: page,
    timestamp, html; ``live``: page, http_code.
    """
    classes = cp.history_class(captures, day, pages=pages)
    changed = classes.filter("kind = 'changed_candidate'").withColumn("night", F.lit(day))
    marked = cp.mark_over_cap(changed, night="night", order=["page"], cap=cap)

    def side(name):
        """Bodies of one side; read once it is known which of them a pair needs."""
        return bodies.select("page", F.col("timestamp").alias(f"_{name}_ts"), F.col("html").alias(f"_{name}_html"))

    pairs = marked.select(
        "page", "over_cap", F.col("before.timestamp").alias("_before_ts"), F.col("after.timestamp").alias("_after_ts"),
        F.col("before.statuscode").alias("before_status"), F.col("after.statuscode").alias("after_status"),
    )
    pairs = pairs.join(side("before"), ["page", "_before_ts"], "left").join(side("after"), ["page", "_after_ts"], "left")
    needed = lambda name: F.when(~F.col("over_cap") & F.col(f"_{name}_html").isNotNull(), wd.page_text(F.col(f"_{name}_html"))).alias(name)
    pairs = pairs.select("page", "over_cap", "before_status", "after_status", needed("before"), needed("after"))
    lost = ~F.col("over_cap") & (F.col("before").isNull() | F.col("after").isNull())
    read = written(wd.read_pages(pairs), "read-pages").withColumn(
        "reason", F.when(lost, "snapshot_unavailable").otherwise(F.col("reason"))
    ).withColumn("class", F.when(lost, "unverifiable").otherwise(F.col("class")))
    settled = cp.settle_candidates(classes, live)
    outcome = read.select("page", F.col("class").alias("_class"), F.col("reason").alias("_reason"))
    entries = settled.join(outcome, "page", "left").join(pages.select("page", "category"), "page")
    entries = entries.select(
        "page", "category", "kind", F.coalesce("_class", "class").alias("class"),
        F.coalesce("_reason", "reason").alias("reason"), "live_class",
    )
    diff = wd.sentence_diff(read.filter("class = 'changed'").select("page", "before", "after"))
    candidates = entries.filter("live_class IS NOT NULL")
    return {
        "entries": entries,
        "events": wd.type_events(diff),
        "abstentions": wd.abstentions(diff),
        "counts": wd.diff_counts(diff),
        "rates": cp.class_rates(entries),
        "reasons": cp.unverifiable_reasons(entries),
        "deletion": cp.gone_rate(candidates),
        "links": classes.select(
            "page", tx.capture_link(F.col("after.timestamp"), F.col("after.original"), "https://web.archive.org/web").alias("permalink")
        ),
    }
