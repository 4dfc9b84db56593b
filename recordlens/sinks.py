"""Append-only sinks: a day, a file or a verdict is written once."""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlens import vocab as v
from recordlens.sources.records import file_hashes, read_bytes


#: The column that names the run which wrote a row.
RUN = "_run"


class AlreadyRecorded(RuntimeError):
    """The day is on record; records are only ever added."""


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None before the first write."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def refuse_recorded(df: DataFrame, path: str, day: str = "date", run: str | None = None) -> None:
    """Raise if any day of ``df`` is on record at ``path``, unless ``run`` itself has written it."""
    held = existing(df.sparkSession, path)
    if held is not None:
        if run is not None and RUN in held.columns:
            held = held.filter(~F.col(RUN).eqNullSafe(F.lit(run)))
        clash = df.select(F.col(day).cast("string").alias(day)).join(
            held.select(F.col(day).cast("string").alias(day)).distinct(), day, "left_semi"
        )
        if not clash.isEmpty():
            raise AlreadyRecorded(f"{path} already holds a day of these rows")


def run_key() -> str:
    """A key of its own for every call; earlier ones sort first."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def append_once(df: DataFrame, path: str, day: str = "date", run: str | None = None, lease_hours: float = 6.0) -> None:
    """Write rows partitioned by ``day``, once per day; refuse days that another run has written or is writing.

    A run first claims its days, then reads all claims: the earliest live one holds a day, so
    of two writers that both found it free one goes on. Rows are staged by Spark and then put
    in place of their day's partition, so a day holds the rows of one run, whole, and a run
    that is repeated under its key replaces its own rows. A claim without rows ends after
    ``lease_hours``, as its run has broken off.
    """
    run = run or run_key()
    refuse_recorded(df, path, day, run)
    _claim(df.select(F.col(day).cast("string").alias("day")).distinct(), f"{path.rstrip('/')}/_claims", run, lease_hours)
    _replace(df.withColumn(RUN, F.lit(run)), path, day)


def _claim(days: DataFrame, folder: str, run: str, lease_hours: float) -> None:
    """Record the claim of ``run`` on days; take it back and raise if another run's is earlier."""
    attempt, now = uuid.uuid4().hex, time.time_ns()

    def note(released: bool) -> None:
        row = days.select("day", F.lit(run).alias("run"), F.lit(now).alias("at"), F.lit(released).alias("released"))
        row.coalesce(1).write.mode("append").parquet(f"{folder}/attempt={attempt}")  # no two jobs share a folder

    note(False)
    claims = days.sparkSession.read.parquet(folder)
    live = claims.groupBy("day", "run", "attempt").agg(F.min("at").alias("at"), F.max("released").alias("released"))
    live = live.filter(~F.col("released") & (F.col("at") > now - int(lease_hours * 3600e9)))
    holders = live.groupBy("day").agg(F.min_by("run", F.struct("at", "run")).alias("holder"))
    if not days.join(holders, "day").filter(F.col("holder") != run).isEmpty():
        note(True)
        raise AlreadyRecorded(f"another run is writing a day of these rows below {folder}")


def _replace(df: DataFrame, path: str, by: str) -> None:
    """Put partitions in place of what stood there; other partitions stay."""
    df.write.partitionBy(by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def one_per_key(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """The least row of every key by ``order``; by all other columns that can be ordered if none is given."""
    rest = [c for c in df.columns if c not in keys]
    order = order or [c for c, kind in df.dtypes if c in rest and "map<" not in kind and "variant" not in kind]
    if not order:
        return df.dropDuplicates(keys)
    least = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return least.select(*(F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns))


def append_new(df: DataFrame, path: str, key: str, order: list[str] | None = None, run: str | None = None) -> None:
    """Append only rows whose key is not on record yet; held rows are never rewritten.

    A key that the batch holds more than once is written once, see ``one_per_key``. Every run
    has a partition, which a repeated run replaces. Two runs that both found a key free leave
    a row each; :func:`held_rows` reads the one of the earlier run key.
    """
    run = run or run_key()
    df = one_per_key(df, [key], order)
    held = existing(df.sparkSession, path)
    fresh = df if held is None else df.join(held.filter(F.col(RUN) != run).select(key), key, "left_anti")
    _replace(fresh.withColumn(RUN, F.lit(run)), path, RUN)


def held_rows(spark: SparkSession, path: str, key: str, before: str | None = None) -> DataFrame | None:
    """The rows that :func:`append_new` keeps, one per key; ``before``: those of earlier runs only. None before the first write."""
    held = existing(spark, path)
    if held is None:
        return None
    held = held.withColumn(RUN, F.col(RUN).cast("string"))
    if before is not None:
        held = held.filter(F.col(RUN) < before)
    return one_per_key(held, [key], [RUN]).drop(RUN)


def preserve_once(entries: DataFrame, manifest: DataFrame) -> DataFrame:
    """Entries not yet in the manifest under the same name with the same bytes, each once."""
    return one_per_key(entries, ["file", "sha256"]).join(manifest.select("file", "sha256"), ["file", "sha256"], "left_anti")


def manifest_of(spark: SparkSession, path: str, fetches: DataFrame | None = None) -> DataFrame:
    """(path, bytes, sha256) of every file below ``path``, hashed where it is read.

    With ``fetches`` (file, url, retrieved_at, http_status) the entries a manifest holds:
    file (the name below ``path``), url, retrieved_at, http_status, sha256, bytes.
    """
    found = file_hashes(read_bytes(spark, path))
    if fetches is None:
        return found
    base = path.rstrip("/").split("://")[-1].split(":")[-1].lstrip("/")
    name = F.substring_index("path", base + "/", -1)
    return found.withColumn("file", name).join(fetches, "file", "left").select("file", "url", "retrieved_at", "http_status", "sha256", "bytes")


def moment_feed(moments: DataFrame, n: int = v.MOMENT_LIMIT) -> DataFrame:
    """The newest moments, ordered by time, record and mode, all descending."""
    return moments.orderBy(F.col("occurred_at").desc(), F.col("id").desc(), F.col("mode").desc()).limit(n)
