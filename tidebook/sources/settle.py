"""Materialise a shared intermediate once, in storage that outlives its executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_ROWS = 100_000


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    """See to a folder for reliable checkpoints.

    The cluster names its shared folder in ``spark.checkpoint.dir``; without it this is an error.
    A temporary folder is used only where that is unset and the session runs inside one machine,
    as in tests. ``spark.cleaner.referenceTracking.cleanCheckpoints`` lets Spark delete what is no
    longer referred to.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidebook-checkpoint-")
    context.setCheckpointDir(folder)


def settle(df: DataFrame) -> DataFrame:
    """Compute the frame now and continue from the stored result.

    For tables several later steps read: the small (category, day) and category-grain tables,
    and the inputs of iterative estimators.
    """
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """A join side expected to be small: broadcast if its counted rows allow it.

    Without the hint the planner would shuffle the large side on a skewed key before it learns
    the size of this aggregate. Beyond ``max_rows`` the ordinary shuffled join applies; only the
    plan depends on the size, never the result.
    """
    stored = settle(df)
    return F.broadcast(stored) if stored.limit(max_rows + 1).count() <= max_rows else stored
