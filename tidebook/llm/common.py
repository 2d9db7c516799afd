"""Shared helpers: tables, lineage cuts in shared storage, partition counts."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as in the word pattern [^\x20\x09-\x0D]+.
BLANKS = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one Parquet table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary folder; on a cluster its absence
    is an error.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder:
        return folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tidebook-llm-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut(frame: DataFrame) -> DataFrame:
    """Compute the frame once and keep it in shared storage; lost executors cost no lineage."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffles, and where so configured the checkpoints, that nothing refers to any more.

    Spark deletes them when the driver's collectors find their frames unreachable, by default asked for every
    half hour only; a loop that stores a table each round asks for it itself, so that its rounds
    don't lie on the executors' disks together. Whatever a frame still refers to stays.
    """
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-blank characters; 0 for null."""
    blank = F.regexp_count(F.concat(F.lit(" "), text), F.lit("[\\x20\\x09-\\x0D][^\\x20\\x09-\\x0D]"))
    return F.coalesce(blank.cast("long"), F.lit(0).cast("long"))


def unit(*columns: Column | str) -> Column:
    """A hash of the columns as a double strictly between 0 and 1 (52 bits)."""
    bits = F.shiftrightunsigned(F.xxhash64(*columns), 12)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def free_name(taken: Iterable[str], wanted: str) -> str:
    """A column name not taken yet, compared as Spark does, without regard to case."""
    lower = {name.lower() for name in taken}
    while wanted.lower() in lower:
        wanted += "_"
    return wanted
