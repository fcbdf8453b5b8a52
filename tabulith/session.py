"""Session helpers shared by every job: checkpoint folder and small reads."""

from __future__ import annotations

import tempfile
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for lineage cuts.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that one is
    used as it is.  Only a local session without the setting gets a scratch
    folder, because a machine-local folder is lost together with its executor.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError(
            "Set spark.checkpoint.dir to a folder every executor can reach."
        )
    scratch = tempfile.mkdtemp(prefix="tabulith-checkpoint-")
    context.setCheckpointDir(scratch)
    return scratch


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the files."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def collect_bounded(df: DataFrame, limit: int, what: str) -> list[Row]:
    """Bring a parameter table to the driver, refusing one that grew too large."""
    rows = df.take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows; it must stay small.")
    return rows


def single_row(df: DataFrame) -> dict[str, Any]:
    """The one row of a full aggregate as a dict."""
    return df.first().asDict()


def fan_out(df: DataFrame, *keys: str) -> DataFrame:
    """Spread groups that need real work over all cores.

    Such tables are small in bytes but heavy per group; with a fixed number of
    partitions they are not merged into one task by size, and a grouping on the
    same keys needs no further shuffle.
    """
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *keys)
