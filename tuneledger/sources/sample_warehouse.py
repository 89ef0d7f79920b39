"""A stored star schema built once per session from one data folder.

Reports read the stored tables: the fact lies by year and month, so a report on one
period reads one folder. The tables go to the shared folder named by the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tuneledger.operators.load import load
from tuneledger.plans import refresh
from tuneledger.session import fresh_dir, sparing_disk
from tuneledger.sources import sample_star
from tuneledger.sources.warehouse import Star, Warehouse, parts_per_period

# The supplied tables span seven years of shipping dates.
_MONTHS_COVERED = 84

_BUILT: dict[tuple[str, str], Warehouse] = {}
_REFRESHED: dict[str, Warehouse] = {}


def write_dimensions(warehouse: Warehouse, folder: str) -> None:
    spark = warehouse.spark
    warehouse.write("label", sample_star.labels(spark, folder))
    warehouse.write("artist", sample_star.artists(spark, folder))
    warehouse.write("song", sample_star.songs(spark, folder))
    warehouse.write("dim_geography", sample_star.countries(spark, folder))
    warehouse.write("platform_config", sample_star.platforms(spark))


def build(spark: SparkSession, folder: str) -> Warehouse:
    """Dimensions, staging, the loaded fact and the payment history, written once."""
    key = (spark.sparkContext.applicationId, folder.rstrip("/"))
    if key not in _BUILT:
        warehouse = Warehouse(spark, fresh_dir(spark, "warehouse"))
        with sparing_disk(spark):
            write_dimensions(warehouse, folder)
            warehouse.publish("sample", sample_star.staging(spark, folder))
            staged = warehouse.read("stg_revenue_import")
            warehouse.append_facts(load(staged, warehouse.star()), parts_per_period(staged.count(), _MONTHS_COVERED))
            paid = sample_star.payments(warehouse.read("fact_monthly_revenue"), warehouse.read("song"))
            paid.write.parquet(warehouse.path("payment_history"))
            refresh.write_month_sums(warehouse)
        _BUILT[key] = warehouse
    return _BUILT[key]


def refreshed(spark: SparkSession, folder: str) -> Warehouse:
    """The warehouse with its views stored by the refresh job."""
    warehouse = build(spark, folder)
    if warehouse.root not in _REFRESHED:
        failed = [row["message"] for row in refresh.refresh_periods(warehouse).where("NOT refreshed").collect()]
        if failed:
            raise RuntimeError(f"refresh failed: {failed}")
        _REFRESHED[warehouse.root] = warehouse
    return warehouse


def unloaded(warehouse: Warehouse) -> Star:
    """The star before any load."""
    star = warehouse.star()
    return star.with_facts(star.facts.limit(0))


def preloaded(warehouse: Warehouse) -> Star:
    """The star with only the facts of 2020 in place."""
    star = warehouse.star()
    return star.with_facts(star.facts.where(F.col("year") == 2020))


def payments(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(build(spark, folder).path("payment_history"))
