"""The complete run from CSV files, and the readers and writers it uses."""

import os

import pytest
from pyspark.sql import functions as F

from tidebook.operators import enrich, reviews
from tidebook.plans.analysis import run_analysis
from tidebook.sources import catalog
from tidebook.sources.schema import FILES, SCHEMAS
from tidebook.sources.sinks import write_csv, write_parquet
from tidebook.sources.star import StarTables, YEAR

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables absent")


@pytest.fixture(scope="module")
def raw_dir(spark, tmp_path_factory):
    """The star tables written as the nine CSV files, ids as text."""
    base = tmp_path_factory.mktemp("raw")
    star = StarTables(spark, DIR)
    for name, file in FILES.items():
        df = star[name]
        df.select(*[F.col(f.name).cast("string") for f in SCHEMAS[name].fields]).toPandas().to_csv(base / file.replace("*", "shop"), index=False)
    return str(base)


def test_csv_scan_keeps_types_zeros_and_nulls(spark, raw_dir):
    tables = catalog.load_tables(spark, raw_dir)
    star = StarTables(spark, DIR)
    assert {n: t.schema for n, t in tables.items()} == {n: SCHEMAS[n] for n in FILES}
    for name in FILES:
        assert tables[name].count() == star[name].count(), name
    assert tables["customers"].where("customer_zip_code_prefix LIKE '0%'").count() == star["customers"].where("customer_zip_code_prefix LIKE '0%'").count() > 0
    assert tables["orders"].where("order_approved_at IS NULL").count() == star["orders"].where("order_approved_at IS NULL").count() > 0


def test_missing_table_is_named(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="_orders_dataset.csv"):
        catalog.read_csv_table(spark, str(tmp_path), "orders")


def test_parquet_and_csv_sinks_overwrite(spark, tmp_path):
    df = spark.createDataFrame([(1, 2017, ["b", "a"]), (2, 2018, [])], "k int, year int, names array<string>")
    path = str(tmp_path / "p")
    write_parquet(df, path, ["year"])
    write_parquet(df.where("k = 1"), path, ["year"])
    assert catalog.read_result(spark, path).count() == 1
    write_csv(df, str(tmp_path / "c"), single_file=True)
    assert [r["names"] for r in catalog.read_result(spark, str(tmp_path / "c"), "csv").orderBy("k").collect()] == ["b; a", None]


def test_enriched_joins_only_what_is_asked(spark):
    star = StarTables(spark, DIR)
    narrow = enrich.build_enriched(star, ["order_id", "price"])
    plan = narrow._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and narrow.count() == star["items"].count()
    full = enrich.build_enriched(star)
    assert tuple(full.columns) == enrich.ENRICHED_COLUMNS and full.count() == star["items"].count()


def test_drop_matching_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "id int, votes_a int, votes_b int")
    assert reviews.drop_matching_columns(df, "votes_").columns == ["id"]


def test_complete_run(spark, raw_dir, tmp_path):
    summary = run_analysis(
        spark, catalog.load_tables(spark, raw_dir), str(tmp_path), YEAR, "2001-07-23", (f"{YEAR}-10-15", f"{YEAR}-12-15"), trees=10
    )
    assert summary["enriched_rows"] == StarTables(spark, DIR)["items"].count()
    written = sorted(os.listdir(tmp_path / "tables"))
    assert len(written) == summary["tables"] and "category_seasonality_ranking" in written
    ranking = catalog.read_result(spark, str(tmp_path / "tables" / "category_seasonality_ranking"), "csv")
    assert ranking.count() == summary["category_rankings"] > 0
