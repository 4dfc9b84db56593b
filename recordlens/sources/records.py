"""Capture histories, captured bytes, watchlists, manifests and the run log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WATCHLIST = """version string, excluded struct<urls: array<string>>,
 institutions array<struct<slug: string, category: string, name: string, host: string, strategy: string, query: string,
  urls: array<string>, probe: struct<at: string, http_status: int>>>,
 controls array<struct<id: string, institution: string, category: string, kind: string, url: string,
  probe: struct<at: string, http_status: int>>>"""

MANIFEST = """run_date string, entries array<struct<file: string, url: string, retrieved_at: string,
 http_status: int, sha256: string, bytes: bigint>>"""

LOG = "ts string, step string, actor string, tokens bigint, cost double, detail struct<date: string>"


def capture_rows(bodies: DataFrame, carry: tuple[str, ...] = ("doc",)) -> DataFrame:
    """Rows of archive answers: the header and short rows are dropped, unreadable bodies are empty."""
    raw = F.from_json(F.trim("body"), "array<array<string>>")
    rows = F.slice(raw, 2, F.greatest(F.size(raw) - 1, F.lit(0)))
    r = bodies.select(*carry, F.posexplode(rows).alias("pos", "r")).filter(F.size("r") >= 4)
    names = ("timestamp", "original", "statuscode", "digest")
    return r.select(*carry, "pos", *[F.col("r")[i].alias(n) for i, n in enumerate(names)])


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of captured files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def file_hashes(files: DataFrame) -> DataFrame:
    """(path, bytes, sha256)."""
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def watchlist_institutions(bodies: DataFrame) -> DataFrame:
    return bodies.select(F.inline(F.from_json("body", WATCHLIST)["institutions"]))


def watchlist_controls(bodies: DataFrame) -> DataFrame:
    return bodies.select(F.inline(F.from_json("body", WATCHLIST)["controls"]))


def watchlist_exclusions(bodies: DataFrame) -> DataFrame:
    return bodies.select(F.explode(F.from_json("body", WATCHLIST)["excluded"]["urls"]).alias("url")).distinct()


def manifest_entries(bodies: DataFrame) -> DataFrame:
    """Listed files of nightly manifests: run_date and the entry fields."""
    d = bodies.select(F.from_json("body", MANIFEST).alias("d"))
    return d.select(F.col("d.run_date").alias("run_date"), F.inline("d.entries"))


def manifest_files(spark: SparkSession, path: str) -> DataFrame:
    """(origin, run_date, entry fields) of the manifest files below ``path`` (a folder or a pattern), one document each."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("origin"), F.from_json("value", MANIFEST).alias("d"))
    return files.select("origin", F.col("d.run_date").alias("run_date"), F.inline("d.entries"))


def numbered_lines(lines: DataFrame) -> DataFrame:
    """Add ``file`` and ``line_no``, the line's number in its file, to a table read from text.

    A file may be read in several pieces: lines are counted inside each, and the lines of
    the file's earlier pieces are added.
    """
    rows = lines.select(
        "*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_piece"), F.monotonically_increasing_id().alias("_at")
    )
    first = rows.groupBy("file", "_piece").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # one row per piece
    first = first.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    out = rows.join(first, ["file", "_piece"])
    return out.withColumn("line_no", F.col("_offset") + F.col("_at") - F.col("_first") + 1).drop("_piece", "_at", "_first", "_n", "_offset")


def log_entries(lines: DataFrame) -> DataFrame:
    """Add the parsed fields and ``unparseable`` to log lines."""
    good = F.try_parse_json("value").isNotNull()
    return lines.withColumn("_e", F.from_json("value", LOG)).select(
        *[c for c in lines.columns if c != "value"], (~good).alias("unparseable"),
        F.when(good, F.col("_e.step")).alias("step"), F.when(good, F.col("_e.detail.date")).alias("run_date"),
    )


def read_committed(spark: SparkSession, path: str, day: str | None = None, day_col: str = "date") -> DataFrame:
    """Committed records of one register; a day narrows the scan to its partition."""
    df = spark.read.parquet(path).drop("_run")
    return df if day is None else df.filter(F.col(day_col).cast("string") == day)
