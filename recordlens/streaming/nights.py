"""Structured Streaming forms: nights as micro-batches, days closed by watermark."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recordlens.operators import drift as dr
from recordlens.operators import register as reg


def run_to_end(writer) -> list[dict]:
    """Process everything available now, then stop; failures are raised.

    Returns what each batch reports: batch, rows, watermark, and dropped, the groups that
    came later than the watermark allows (rows of a task that share a group count once, as
    Spark reduces before it drops).
    """
    query: StreamingQuery = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return [
        {
            "batch": p["batchId"],
            "rows": p["numInputRows"],
            "watermark": p.get("eventTime", {}).get("watermark"),
            "dropped": sum(o["numRowsDroppedByWatermark"] for o in p["stateOperators"]),
        }
        for p in (json.loads(q.json) for q in query.recentProgress)
    ]


# --- the register ---------------------------------------------------------------------


def fold_night_batches(
    announcements: DataFrame,
    observations: Callable[[list[str]], DataFrame],
    base: str,
    *,
    night: str = "run_date",
    answered: Callable[[list[str]], DataFrame] | None = None,
    buckets: int = 16,
    **fold,
):
    """A writer that folds each announced group of nights onto the register so far.

    The stream carries announcements, one small row per finished night, never the data:
    ``observations(nights)`` reads the night's partitions with the batch engine. Events are
    written under the batch number, so a repeated batch replaces its own output and nothing
    else: exactly once, whatever executors are lost.

    The state lies in buckets of keys, see ``BucketedState``: a batch writes those buckets
    only whose records had an event.

    A night that arrives late is folded again together with all nights after it, from the
    state before it; the events that earlier batches found from that night on are
    superseded (see ``folded_events``).
    """
    spark = announcements.sparkSession
    names = {k: fold[k] for k in ("key", "source", "kind", "tracked", "carried") if k in fold}
    held = BucketedState(spark, base, fold.get("key", "id"), buckets)

    def batch(rows: DataFrame, epoch: int) -> None:
        nights = sorted(r[0] for r in rows.select(night).distinct().collect())  # a few dates
        done = _folded_nights(spark, base, epoch).collect() if epoch > 0 else []  # a date for each night
        again = {r[night] for r in done if r[night] >= nights[0]}
        if again:
            nights = sorted(again.union(nights))
            before = folded_events(spark, base, night, epoch).filter(F.col(night) < nights[0])
            # Written once: the fold and the new state both read it.
            rebuilt = f"{base}/before/epoch={epoch}"
            reg.advance_state(before, night=night, **names).write.mode("overwrite").parquet(rebuilt)
            state = spark.read.parquet(rebuilt)
        else:
            state = held.read(epoch)
        events = reg.register_fold(
            observations(nights), answered(nights) if answered else None, night=night, state=state, **fold
        )
        at = f"{base}/events/epoch={epoch}"
        events.write.mode("overwrite").parquet(at)
        spark.createDataFrame([(n, nights[0]) for n in nights], f"{night} string, first string").write.mode("overwrite").parquet(f"{base}/nights/epoch={epoch}")
        held.advance(epoch, spark.read.parquet(at), state if again else None, lambda new, old: reg.advance_state(new, old, night=night, **names))

    return announcements.writeStream.foreachBatch(batch).option("checkpointLocation", f"{base}/checkpoint")


class BucketedState:
    """A keyed state on disk, in buckets of keys with two slots each.

    A batch writes a bucket into the slot that the batch before does not read, by dynamic
    partition overwrite, and then notes the slots now in force under its own number. So a
    batch that is repeated finds what it found the first time, buckets without a change are
    not written, and what a bucket held two changes ago is replaced, not kept. The notes are
    one row per bucket.
    """

    def __init__(self, spark: SparkSession, base: str, key: str, buckets: int):
        self.spark, self.base, self.key, self.buckets = spark, base, key, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def slots(self, epoch: int) -> dict[int, int]:
        """bucket: slot, as batch ``epoch`` finds them."""
        if epoch == 0:
            return {}
        return {r.bucket: r.slot for r in self.spark.read.parquet(f"{self.base}/slots/epoch={epoch - 1}").collect()}

    def read(self, epoch: int, buckets: set[int] | None = None) -> DataFrame | None:
        """The state before batch ``epoch``, of some buckets or of all; None if there is none."""
        found = [f"{self.base}/state/bucket={b}/slot={s}" for b, s in sorted(self.slots(epoch).items()) if buckets is None or b in buckets]
        return self.spark.read.parquet(*found) if found else None

    def advance(self, epoch: int, events: DataFrame, rebuilt: DataFrame | None, merge: Callable[[DataFrame, DataFrame | None], DataFrame]) -> None:
        """Write the buckets that ``events`` touch, or every bucket where the state was built anew."""
        slots = self.slots(epoch)
        if rebuilt is None:
            touched = {r[0] for r in events.select(self._bucket().alias("b")).distinct().collect()}  # one row per bucket
            after = merge(events, self.read(epoch, touched))
        else:
            touched, after = set(range(self.buckets)), merge(events, rebuilt)
            slots = {b: slots.get(b, 1) for b in touched}
        changed = {b: 1 - slots.get(b, 1) for b in touched}
        if changed:
            slot = F.get(F.array(*[F.lit(changed.get(b, 0)) for b in range(self.buckets)]), F.col("bucket"))
            rows = after.withColumn("bucket", self._bucket()).withColumn("slot", slot).repartition("bucket")
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "slot").parquet(f"{self.base}/state")
        if rebuilt is not None:
            keys = events.select(self.key).unionByName(rebuilt.select(self.key))  # merged, these are the rows
            written = {r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect()}  # one row per bucket
            slots, changed = {}, {b: s for b, s in changed.items() if b in written}
        now = sorted({**slots, **changed}.items())
        self.spark.createDataFrame(now, "bucket int, slot int").coalesce(1).write.mode("overwrite").parquet(f"{self.base}/slots/epoch={epoch}")


def _folded_nights(spark: SparkSession, base: str, before: int | None = None) -> DataFrame:
    """(night, first, epoch): the nights of each batch, and the first it folded."""
    rows = spark.read.parquet(f"{base}/nights")
    return rows if before is None else rows.filter(F.col("epoch") < before)


def folded_events(spark: SparkSession, base: str, night: str = "run_date", before: int | None = None) -> DataFrame:
    """The events in force: a batch's, up to the first night that a later batch has folded."""
    later = Window.orderBy("epoch").rowsBetween(1, Window.unboundedFollowing)  # one row per batch
    firsts = _folded_nights(spark, base, before).groupBy("epoch").agg(F.min("first").alias("first"))
    firsts = firsts.select("epoch", F.min("first").over(later).alias("_first"))
    events = spark.read.parquet(f"{base}/events")
    if before is not None:
        events = events.filter(F.col("epoch") < before)
    rows = events.join(firsts, "epoch", "left").filter(F.col("_first").isNull() | (F.col(night) < F.col("_first")))
    return rows.drop("epoch", "_first")


# --- feeds ------------------------------------------------------------------------------


def first_message_wins(messages: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """The first message of every key within the watermark; later ones are dropped."""
    return messages.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def least_message_stream(messages: DataFrame, keys: list[str], ts: str, order: list[str], payload: list[str], span: str = "1 day", delay: str = "1 day") -> DataFrame:
    """The first message in feed order of every key and span, with its payload.

    (starts, keys, order, payload) of the least ``order`` among all messages of a key whose
    ``ts`` lies in the span, however files and batches deal them out. A span is emitted once,
    after the watermark has passed its end; state is one row per key and open span.
    """
    least = F.min_by(F.struct(*order, *payload), F.struct(*order)).alias("_first")
    rows = messages.withWatermark(ts, delay).groupBy(F.window(ts, span).alias("_span"), *keys).agg(least)
    return rows.select(F.col("_span.start").alias("starts"), *keys, "_first.*")


def utc_instant(ts: Column) -> Column:
    """A zone-less time read as UTC, whatever the session's zone is."""
    return F.to_timestamp(F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")))


def utc_day(instant: Column) -> Column:
    return F.date_from_unix_date(F.floor(F.unix_seconds(instant) / 86400).cast("int")).cast("string")


def daily_volume_stream(rows: DataFrame, ts: str, country: str, delay: str = "1 day") -> DataFrame:
    """Volume per completed UTC day and country.

    In append mode a day is emitted once, after the watermark has passed its end: a day
    that is still running is not reported, and rows later than ``delay`` never change one.
    """
    return (
        rows.withWatermark(ts, delay)
        .groupBy(F.window(ts, "1 day"), F.coalesce(F.trim(country), F.lit("")).alias("country"))
        .agg(
            F.count(F.lit(1)).alias("events"), F.sum("articles").alias("articles"), F.sum("mentions").alias("mentions")
        )
        .select(utc_day(F.col("window.start")).alias("day"), "country", "events", "articles", "mentions")
    )


def append_stream(rows: DataFrame, base: str):
    """Append a stream to files exactly once."""
    return (
        rows.writeStream.outputMode("append").format("parquet")
        .option("path", f"{base}/data").option("checkpointLocation", f"{base}/checkpoint")
    )


# --- drift ------------------------------------------------------------------------------


def drift_stream(answers: DataFrame, held: DataFrame, fields, base: str, *, key: str = "id"):
    """A writer that checks each batch of look-back answers against the held values.

    ``answers``: key, asked (bool: its batch was answered), present, and the fields as
    text. The static side is the first-seen table; a batch writes under its number.
    """

    def batch(rows: DataFrame, epoch: int) -> None:
        asked = rows.select(key, F.col("asked").alias("answered"))
        current = rows.filter(F.col("asked") & F.col("present"))
        found = dr.drift(held, current, asked, fields, key=key)
        found.write.mode("overwrite").parquet(f"{base}/findings/epoch={epoch}")

    return answers.writeStream.foreachBatch(batch).option("checkpointLocation", f"{base}/checkpoint")
