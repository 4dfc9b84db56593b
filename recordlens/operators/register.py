"""The register: nightly observations folded into an append-only event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recordlens import vocab as v
from recordlens.functions import clock
from recordlens.operators.ordered import previous_row

TRACKED = ("severity", "window", "what", "where")
CARRIED = ("hazard", "iso3", "source_ref")
SEGMENT_ROWS = 100_000


def answered_calendar(observations: DataFrame, answered_nights: DataFrame | None, source: str, night: str) -> Column:
    """map: source to its answered nights, ascending, as a value that rows are searched in.

    A source that shows a record has answered. The map is as large as the number of sources
    times nights; as a scalar subquery it goes to the rows, so the rows themselves are not
    shuffled by source or night, however many of them one source has.
    """
    seen = observations.select(source, night)
    if answered_nights is not None:
        seen = seen.unionByName(answered_nights.select(source, night))
    nights = seen.filter(F.col(source).isNotNull() & F.col(night).isNotNull()).distinct()
    per = nights.groupBy(source).agg(F.array_sort(F.collect_list(night)).alias("_nights"))
    return per.agg(F.map_from_entries(F.collect_list(F.struct(source, "_nights")))).scalar()


def _change_struct(tracked, prev: Column) -> Column:
    """One nullable struct(from, to) per tracked field; null where the field held."""
    return F.struct(
        *[
            F.when(
                ~F.col(f).eqNullSafe(prev[f]),
                F.struct(prev[f].alias("from"), F.col(f).alias("to")),
            ).alias(f)
            for f in tracked
        ]
    )


def register_fold(
    observations: DataFrame,
    answered_nights: DataFrame | None = None,
    *,
    key: str = "id",
    source: str = "source",
    kind: str = "kind",
    night: str = "run_date",
    order: str = "pos",
    tracked: tuple[str, ...] = TRACKED,
    carried: tuple[str, ...] = CARRIED,
    snapshot: str = "snapshot",
    one_per_night: bool = False,
    segment_rows: int = SEGMENT_ROWS,
    state: DataFrame | None = None,
) -> DataFrame:
    """Fold observations into register events.

    A first sight is NOTARIZED; a sight after the source let go is REAPPEARED; a tracked
    field that differs from the last one held is REVISED; the first answered night
    without the record is DISSIPATED for forecasts and CLOSED_BY_SOURCE otherwise.
    Nights a source did not answer prove nothing.

    No row is made for nights on which a record is merely absent: the night a source lets
    go is the first answered night after the last sight, looked up in the source's calendar.
    An observation without source or night is no observation.
    ``order`` is a number, or a struct whose first field is one (document, feature, ...).
    ``one_per_night`` states that a key occurs at most once a night, which saves the
    segmented lookup; without it, duplicates of a night are folded in feed order.
    ``state`` (from :func:`advance_state`) continues an earlier fold: its rows stand in for
    everything before the first of these nights.

    Result: key, night, phase (0 feed, 1 closing), pos, step, event, source, kind,
    snapshot, changes, held (tracked values after the event), and the carried columns.
    """
    calendar = answered_calendar(observations, answered_nights, source, night)
    placed = observations.filter(F.col(source).isNotNull() & F.col(night).isNotNull()).withColumn("_nights", F.try_element_at(calendar, F.col(source)))
    rows = placed.select(
        key, night, F.col(order).alias("pos"), source, kind, snapshot, *tracked, *carried, F.lit(None).cast("string").alias("_was"),
        F.get("_nights", F.array_position("_nights", F.col(night)).cast("int")).alias("next_answered"),
    )
    if state is not None:
        rows = rows.unionByName(_held_rows(state, calendar, rows, source, night, tracked))
    held_before = F.col("_was").isNotNull()
    values = [night, "next_answered", *tracked]
    per_key = Window.partitionBy(key).orderBy(night)
    if one_per_night:
        # Feed order too, so that a night with several rows of a key is folded all the same.
        in_order = Window.partitionBy(key).orderBy(night, "pos")
        rows = rows.withColumn("prev", F.lag(F.struct(*values)).over(in_order))
        rows = rows.withColumn("_next_night", F.lead(night).over(in_order)).withColumn("_last", F.lit(True))
    else:
        nested = isinstance(observations.schema[order].dataType, StructType)
        lead = F.col("pos")[observations.schema[order].dataType[0].name] if nested else F.col("pos")
        rows = rows.withColumn("_seg", F.coalesce(F.floor(lead / segment_rows), F.lit(-1)))
        rows = previous_row(rows, [key], [night, "_seg"], ["pos"], values)
        nights = (
            rows.groupBy(key, night)
            .agg(F.max("pos").alias("_last_pos"))
            .withColumn("_next_night", F.lead(night).over(per_key))
        )
        rows = rows.join(nights, [key, night]).withColumn("_last", F.col("pos").eqNullSafe(F.col("_last_pos")))

    prev = F.col("prev")
    first = prev.isNull() & ~held_before
    changes = F.when(~first, _change_struct(tracked, prev))
    held = F.struct(*tracked)
    changed = prev.isNotNull() & ~F.struct(*[F.col(f) for f in tracked]).eqNullSafe(
        F.struct(*[prev[f].alias(f) for f in tracked])
    )
    reappeared = prev.isNotNull() & (prev["next_answered"] < F.col(night))
    lets_go = (
        F.col("_last")
        & (~held_before | (F.col("_was") == v.OPEN))
        & F.col("next_answered").isNotNull()
        & (F.col("_next_night").isNull() | (F.col("_next_night") > F.col("next_answered")))
    )
    closing = F.when(F.col(kind) == "FORECAST", v.DISSIPATED).otherwise(v.CLOSED_BY_SOURCE)

    def event(when, at, phase, step, name, with_changes=False):
        null_changes = F.when(F.lit(False), changes)
        return F.when(
            when,
            F.struct(
                at.alias(night),
                F.lit(phase).alias("phase"),
                F.when(F.lit(phase == 0), F.col("pos")).alias("pos"),
                F.lit(step).alias("step"),
                name.alias("event"),
                F.when(F.lit(phase == 0), F.col(snapshot)).alias(snapshot),
                (changes if with_changes else null_changes).alias("changes"),
                held.alias("held"),
            ),
        )

    found = F.array_compact(
        F.array(
            event(first, F.col(night), 0, 0, F.lit("NOTARIZED")),
            event(reappeared, F.col(night), 0, 1, F.lit("REAPPEARED")),
            event(changed, F.col(night), 0, 2, F.lit("REVISED"), with_changes=True),
            event(lets_go, F.col("next_answered"), 1, 0, closing),
        )
    )
    exploded = rows.select(key, source, kind, *carried, F.explode(found).alias("_e"))
    return exploded.select(key, source, kind, "_e.*", *carried)


def _held_rows(state: DataFrame, calendar: Column, like: DataFrame, source: str, night: str, tracked) -> DataFrame:
    """State rows shaped as observations from before these nights.

    An open record is let go on the first new night its source answers; a closed one has
    been let go already, so any later sight is a reappearance.
    """
    first_answer = F.get(F.try_element_at("_calendar", F.col(source)), F.lit(0))
    next_answered = F.when(F.col("status") == v.OPEN, first_answer).otherwise(F.col(night))
    shaped = state.withColumn("_calendar", calendar).withColumns({"next_answered": next_answered, "_was": F.col("status")})
    columns = [
        F.col(c) if c in shaped.columns else F.lit(None).cast(like.schema[c].dataType).alias(c) for c in like.columns
    ]
    return shaped.select(*columns)


def advance_state(
    events: DataFrame, state: DataFrame | None = None, *, key: str = "id", source: str = "source", kind: str = "kind",
    night: str = "run_date", tracked: tuple[str, ...] = TRACKED, carried: tuple[str, ...] = CARRIED,
) -> DataFrame:
    """(key, source, kind, night, status, tracked, carried): what the next fold needs.

    New events are reduced to one row per record, then merged with the earlier state.
    """
    at = F.struct(night, *EVENT_ORDER)
    fixed = (source, kind, *carried)
    new = events.groupBy(key).agg(
        F.coalesce(
            F.max_by(F.struct(*fixed), F.when(F.col("event") == "CORRECTED", at)), F.min_by(F.struct(*fixed), at)
        ).alias("_fixed"),
        F.max_by("event", at).isin("CORRECTED").alias("_corrected"),
        F.max_by("held", at).alias("_held"),
        status_of(F.max_by("event", at)).alias("_status"),
        F.max(night).alias("_night"),
    )
    if state is None:
        pick = lambda f, fresh: fresh.alias(f)
        rows = new
    else:
        corrected = F.coalesce("_corrected", F.lit(False))
        pick = lambda f, fresh: F.when(corrected, fresh).otherwise(F.coalesce(F.col(f), fresh)).alias(f) if f in fixed else F.coalesce(fresh, F.col(f)).alias(f)
        rows = state.join(new, key, "full")
    return rows.select(
        key,
        *[pick(f, F.col("_fixed")[f]) for f in fixed],
        pick(night, F.col("_night")),
        pick("status", F.col("_status")),
        *[pick(f, F.col("_held")[f]) for f in tracked],
    )


EVENT_ORDER = ("phase", "pos", "step")


def status_of(event: Column) -> Column:
    return F.when(event.isin(v.CLOSED_BY_SOURCE, v.DISSIPATED), event).otherwise(v.OPEN)


def register_current(
    events: DataFrame,
    *,
    key: str = "id",
    night: str = "run_date",
    tracked: tuple[str, ...] = TRACKED,
    carried: tuple[str, ...] = CARRIED,
    with_history: bool = False,
) -> DataFrame:
    """One row per record: fields last held, first sight, status and event counts.

    Carried fields are those of the first sight, or of the last correction.

    The event table is the history; ``with_history`` also nests it per record, for
    exports of registers whose records have few events each.
    """
    at = F.struct(night, *EVENT_ORDER)
    feed = F.col("phase") == 0
    aggs = [
        F.min(night).alias("announced_at"),
        F.min_by(F.struct("source", "kind", *carried), at).alias("_first"),
        F.max_by(F.struct("source", "kind", *carried), F.when(F.col("event") == "CORRECTED", at)).alias("_corrected"),
        F.max_by("held", F.when(feed, at)).alias("_held"),
        F.max_by("event", F.when(F.col("event") != "CORRECTED", at)).alias("_last"),
        F.max(night).alias("last_event_at"),
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(F.col("event") == "REVISED").alias("revisions"),
    ]
    if with_history:
        entry = F.struct(night, *EVENT_ORDER, "event", "snapshot", "changes")
        aggs.append(F.array_sort(F.collect_list(entry), _by_order(night)).alias("history"))
    out = events.groupBy(key).agg(*aggs)
    return out.select(
        key,
        F.inline(F.array(F.coalesce("_corrected", "_first"))),
        *[F.col("_held")[f].alias(f) for f in tracked],
        "announced_at",
        status_of(F.col("_last")).alias("status"),
        "last_event_at",
        "n_events",
        "revisions",
        *(["history"] if with_history else []),
    )


def _by_order(night: str):
    def compare(a, b):
        out = F.lit(0)
        for f in reversed((night, *EVENT_ORDER)):
            out = F.when(a[f] < b[f], -1).when(a[f] > b[f], 1).otherwise(out)
        return out

    return compare


def window_at_first_sight(events: DataFrame, *, key: str = "id", night: str = "run_date") -> DataFrame:
    """(key, first_to): the window end a record carried when it was first seen."""
    at = F.struct(night, *EVENT_ORDER)
    return events.groupBy(key).agg(
        F.min_by(F.col("held")["window"]["to"], F.when(F.col("phase") == 0, at)).alias("first_to")
    )


def is_overdue(status: Column, window_to: Column, now: Column, time_mode: str = "parsed") -> Column:
    """Open, and the window end lies before ``now``."""
    return F.coalesce((status == v.OPEN) & clock.before(window_to, now, time_mode), F.lit(False))


def overdue_kind(
    status: Column, window_to: Column, first_to: Column, announced_at: Column, now: Column,
    time_mode: str = "parsed",
) -> Column:
    """cold_start_overdue if the first window end precedes first sight, else drift_overdue."""
    cold = clock.before(first_to, announced_at, time_mode)
    return F.when(
        is_overdue(status, window_to, now, time_mode),
        F.when(cold, "cold_start_overdue").otherwise("drift_overdue"),
    )


def public_state(
    status: Column, window_to: Column, first_to: Column, announced_at: Column, run_date: Column
) -> Column:
    """window_open / cold_start / drift of an open record as of a run day (day compare)."""
    passed = F.coalesce(clock.day_of(window_to) < run_date, F.lit(False))
    cold = clock.before(first_to, announced_at, "text")
    return F.when(
        status == v.OPEN,
        F.when(~passed, "window_open").when(cold, "cold_start").otherwise("drift"),
    )


def cold_start_flags(current: DataFrame) -> DataFrame:
    """Add ``cold_start``: first seen on the register's earliest day."""
    first_day = current.agg(F.min(clock.day_of(F.col("announced_at")))).scalar()
    return current.withColumn("cold_start", clock.day_of(F.col("announced_at")) == first_day)


def window_series(events: DataFrame, *, key: str = "id", night: str = "run_date") -> DataFrame:
    """(key, day, to, seq): the window ends a record carried, first sight then each change."""
    to = F.col("held")["window"]["to"]
    keep = (F.col("event") == "NOTARIZED") | F.col("changes")["window"].isNotNull()
    return events.filter(keep).select(
        key, clock.day_of(F.col(night).cast("string")).alias("day"), to.alias("to"), *EVENT_ORDER, night
    )


def trajectory_class(
    events: DataFrame, as_of: str, *, key: str = "id", night: str = "run_date"
) -> DataFrame:
    """Classify each record's window-end path up to the night ``as_of``.

    frozen: one value over at least two nights; rolling: every step moves the end by as
    many days as passed; irregular: otherwise, with the first step that broke the rule.
    Records watched for fewer than two nights are left out. A night without a change
    carries the last value forward.
    """
    series = window_series(events, key=key, night=night)
    last = series.groupBy(key).agg(
        F.max("day").alias("_last_day"),
        F.max_by("to", F.struct(night, *EVENT_ORDER)).alias("to"),
    )
    carry = last.filter(F.col("_last_day") != as_of).select(
        key, F.lit(as_of).alias("day"), "to", F.lit(9).alias("phase"),
        F.lit(None).cast(events.schema["pos"].dataType).alias("pos"), F.lit(0).alias("step"), F.lit(as_of).alias("_at"),
    )
    rows = series.select(key, "day", "to", *EVENT_ORDER, F.col(night).cast("string").alias("_at"))
    rows = rows.unionByName(carry).withColumn("_seg", F.substring("day", 1, 7))
    rows = previous_row(rows, [key], ["_seg"], ["day", "_at", *EVENT_ORDER], ["day", "to"])
    day_delta = clock.day_diff(F.col("day"), F.col("prev.day"))
    to_delta = clock.day_diff(F.col("to"), F.col("prev.to"))
    unknown = F.col("to").isNull() | F.col("prev.to").isNull()
    broken = F.col("prev").isNotNull() & (unknown | (day_delta != to_delta))
    steps = rows.withColumn(
        "_break",
        F.when(
            broken,
            F.struct(
                F.struct("day", "_at", *EVENT_ORDER).alias("at"),
                F.when(~unknown, F.col("day")).alias("since"),
                F.when(~unknown, day_delta).alias("day_delta"),
                F.when(~unknown, to_delta).alias("todate_delta"),
            ),
        ),
    )
    out = steps.groupBy(key).agg(
        (clock.day_diff(F.lit(as_of), F.min("day")) + 1).alias("nights_observed"),
        F.min("_break").alias("_b"),
        F.count(F.lit(1)).alias("_n"),
        F.count("to").alias("_known"),
        F.min("to").alias("_lo"),
        F.max("to").alias("_hi"),
        F.max_by("to", F.struct("day", "_at", *EVENT_ORDER)).alias("_to"),
    )
    one_value = (F.col("_known") == 0) | (
        (F.col("_known") == F.col("_n")) & (F.col("_lo") == F.col("_hi"))
    )
    cls = F.when(one_value, "frozen").when(F.col("_b").isNull(), "rolling").otherwise("irregular")
    irregular = F.col("class") == "irregular"
    return (
        out.filter(F.col("nights_observed") >= 2)
        .withColumn("class", cls)
        .select(
            key,
            "class",
            "nights_observed",
            F.when(irregular, F.col("_b.since")).alias("since"),
            F.when(irregular, F.col("_b.day_delta")).alias("day_delta"),
            F.when(irregular, F.col("_b.todate_delta")).alias("todate_delta"),
            F.when(~irregular, F.col("_to")).alias("window_to"),
        )
    )


def class_crossings(
    events: DataFrame, as_of: str, previous: str, *, key: str = "id", night: str = "run_date"
) -> DataFrame:
    """Records whose trajectory class tonight differs from the one without tonight's events."""
    earlier = events.filter(clock.day_of(F.col(night).cast("string")) != as_of)
    today = trajectory_class(events, as_of, key=key, night=night)
    before = trajectory_class(earlier, previous, key=key, night=night)
    joined = today.select(key, F.col("class").alias("to_class")).join(
        before.select(key, F.col("class").alias("from_class")), key
    )
    return joined.filter("from_class <> to_class").withColumn("run_date", F.lit(as_of))


def field_guard(current: DataFrame, feed: DataFrame, *, key: str = "id") -> DataFrame:
    """Feed's primary country codes missing from the held ones: (key, dropped).

    ``feed`` has one row per record with ``primary_iso3``; blank codes say nothing.
    """
    primary = F.trim(F.coalesce(F.col("primary_iso3"), F.lit("")))
    named = feed.select(key, primary.alias("_code")).filter(F.col("_code") != "").distinct()
    held = current.select(key, "iso3").join(named, key)
    missing = ~F.array_contains(F.coalesce("iso3", F.array().cast("array<string>")), F.col("_code"))
    return held.filter(missing).select(key, F.col("_code").alias("dropped"))


def correct_register(
    current: DataFrame, feed: DataFrame, *, cause: str, at: str, snapshot: str, key: str = "id",
    night: str = "run_date", tracked: tuple[str, ...] = TRACKED, carried: tuple[str, ...] = CARRIED,
) -> tuple[DataFrame, DataFrame]:
    """Add missing primary codes to open records and state each addition as an event.

    Additions only; a second run finds nothing. Returns (corrected table, CORRECTED events).
    The events have the event table's columns (phase 2, after the night's others), the
    corrected codes among the carried ones, and what was added and why beside them; so the
    event table with them gives the corrected register again.
    """
    open_rows = current.filter(F.col("status") == v.OPEN)
    added = field_guard(open_rows, feed, key=key).groupBy(key).agg(
        F.array_sort(F.collect_set("dropped")).alias("added")
    )
    held = F.coalesce("iso3", F.array().cast("array<string>"))
    merged = F.array_sort(F.array_union(held, F.col("added")))
    joined = current.join(added, key, "left")
    values = F.struct(*[F.col(f) for f in tracked])
    events = joined.filter("added IS NOT NULL").select(
        key,
        "source",
        "kind",
        F.lit(at).alias(night),
        F.lit(2).alias("phase"),
        F.lit(None).cast("long").alias("pos"),
        F.lit(0).alias("step"),
        F.lit("CORRECTED").alias("event"),
        F.lit(snapshot).alias("snapshot"),
        F.when(F.lit(False), _change_struct(tracked, values)).alias("changes"),
        values.alias("held"),
        *[merged.alias(f) if f == "iso3" else F.col(f) for f in carried],
        held.alias("iso3_from"),
        "added",
        F.lit(cause).alias("cause"),
    )
    corrected = joined.withColumn(
        "iso3", F.when(F.col("added").isNotNull(), merged).otherwise(F.col("iso3"))
    ).drop("added")
    return corrected, events
