"""Session settings and the shared working folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "recordlens", cores: str = "8", memory: str = "12g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    The folder named in ``spark.checkpoint.dir`` is used as it is. Where the setting is
    absent a local session (tests, the bench) gets a folder of its own; on a cluster the
    call fails, as executors and driver would write to different disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _local_base()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@lru_cache(maxsize=1)
def _local_base() -> str:
    """One folder for this process, removed when it ends."""
    base = tempfile.mkdtemp(prefix="recordlens-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Cut lineage by writing the table once and reading it back.

    Survives the loss of executors, unlike a cached or locally checkpointed table.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
