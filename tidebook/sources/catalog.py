"""Readers: the nine-table catalogue from CSV or Parquet, and persisted results."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tidebook.sources.schema import FILES, SCHEMAS, STATE_REGIONS

# Free text may hold line breaks inside quotes; only this table gives up splittable scans.
MULTILINE_TABLES = frozenset({"reviews"})


class MissingTableError(FileNotFoundError):
    """A source table is absent."""


def _checked(load, path: str) -> DataFrame:
    try:
        return load()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in (error.getCondition() or ""):
            raise MissingTableError(f"Missing raw table: {path}") from error
        raise


def read_csv_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Scan one source table with its declared schema; zip prefixes keep leading zeros."""
    path = f"{directory.rstrip('/')}/{FILES[name]}"
    reader = (
        spark.read.schema(SCHEMAS[name])
        .option("header", True)
        .option("escape", '"')
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .option("multiLine", name in MULTILINE_TABLES)
        .option("enforceSchema", False)
    )
    return _checked(lambda: reader.csv(path), path)


def load_tables(spark: SparkSession, directory: str, names: Iterable[str] = tuple(SCHEMAS)) -> dict[str, DataFrame]:
    """The catalogue of lazily scanned tables, keyed by short name."""
    return {name: read_csv_table(spark, directory, name) for name in names}


def load_parquet_tables(spark: SparkSession, directory: str, names: Iterable[str] = tuple(SCHEMAS)) -> dict[str, DataFrame]:
    """The same catalogue from ``<directory>/<name>`` Parquet datasets."""
    base = directory.rstrip("/")
    return {n: _checked(lambda n=n: spark.read.parquet(f"{base}/{n}"), f"{base}/{n}") for n in names}


def read_result(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Re-read a persisted intermediate or result table."""
    reader = spark.read.option("header", True).option("inferSchema", True) if fmt == "csv" else spark.read
    return _checked(lambda: reader.format(fmt).load(path), path)


def register_views(tables: dict[str, DataFrame], **renamed: str) -> None:
    """Expose the tables to ``spark.sql``; ``renamed`` maps a table to another view name."""
    for name, df in tables.items():
        df.createOrReplaceTempView(renamed.get(name, name))


def state_regions(spark: SparkSession) -> DataFrame:
    """Dimension (state, region) with one row per state."""
    rows = [(state, region) for region, states in STATE_REGIONS.items() for state in states]
    return spark.createDataFrame(rows, "state string, region string")
