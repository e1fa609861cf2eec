"""Session helpers: table access, checkpoints in the shared folder and checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows a side may have before it is no longer broadcast by the library.
BROADCAST_ROWS = 20_000


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session as the tests and the bench use it."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("weftline")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    A cluster names a folder all executors share in ``spark.checkpoint.dir``; only where that is unset (tests,
    a laptop) is a temporary folder made, and removed again at exit.
    """
    sc = spark.sparkContext
    set_already = sc.getCheckpointDir()
    if set_already:
        return set_already
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = tempfile.mkdtemp(prefix="weftline-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        named = f"file://{os.path.abspath(named)}"
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage; survives the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written as a table of the shared checkpoint folder and read back; the ``cut`` for the state of a loop.

    A checkpoint keeps the planner's estimate of its size, and an estimate that is multiplied by itself in every round
    soon has so many digits that planning takes longer than the work. A written table has the size it has.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows, else unchanged (the join then shuffles)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def parallelism(spark: SparkSession) -> int:
    """The number of shuffle partitions asked for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Repartition by ``cols`` (round robin without any) into at least as many tasks as there are cores.

    Used before CPU-heavy Python stages, whose cost isn't seen in the bytes by which small partitions are merged.
    """
    spark = df.sparkSession
    n = max(parallelism(spark), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *cols) if cols else df.repartition(n)


def as_frame(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    """Rows with optional keys as a frame of plain objects: what is missing is None, never NaN."""
    return pd.DataFrame([[r.get(c) for c in columns] for r in rows], columns=columns, dtype=object)
