"""The supplied retail tables seen as a music-revenue star schema.

Each function returns a lazy DataFrame over the Parquet files of one data folder. The
platform configuration is a short fixed list, everything else grows with the tables.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tuneledger import schemas
from tuneledger.schemas import PENDING

_YEARS_AHEAD = 25
_MONEY = "decimal(15,6)"

PLATFORMS = [
    (1, "AUTOMOBILE", "70.00", (2020, 1, 1), None, True),
    (2, "BUILDING", "70.00", (2020, 1, 1), (2022, 12, 31), True),
    (3, "BUILDING", "65.00", (2023, 1, 1), None, True),
    (4, "FURNITURE", "55.00", (2020, 1, 1), None, True),
    (5, "HOUSEHOLD", "60.00", (2020, 1, 1), None, False),
    (6, "MACHINERY", "52.50", (2021, 1, 1), None, True),
    (7, "PODCAST", "50.00", (2020, 1, 1), None, True),
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _isrc(partkey: Column) -> Column:
    return F.concat(F.lit("INK78"), F.lpad(partkey.cast("string"), 7, "0"))


def _country_code(nationkey: Column) -> Column:
    return F.concat(
        F.char(F.lit(65) + F.floor(nationkey / 5).cast("int")),
        F.char(F.lit(65) + (nationkey % 5).cast("int")))


def labels(spark: SparkSession, folder: str) -> DataFrame:
    brands = table(spark, folder, "part").select("p_brand").distinct()
    return brands.select(
        F.substring("p_brand", 7, 10).cast("int").alias("label_id"), F.col("p_brand").alias("label_name"))


def artists(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("s_suppkey").cast("int")
    return table(spark, folder, "supplier").select(
        key.alias("artist_id"), F.col("s_name").alias("artist_name"),
        F.when(key % 2 == 0, 1_000_000).otherwise(1_500_000).cast(_MONEY).alias("payment_threshold"))


def songs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").cast("int").alias("song_id"), _isrc(F.col("p_partkey")).alias("isrc"),
        F.col("p_name").alias("title"), F.floor(F.col("p_partkey") / 20).cast("int").alias("artist_id"),
        F.substring("p_brand", 7, 10).cast("int").alias("label_id"),
        F.when(F.col("p_type") == "PROMO", "Draft").when(F.col("p_type") == "LARGE", "Archived")
        .otherwise("Released").alias("status"))


def countries(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation").where(F.col("n_nationkey") < 22)
    region = table(spark, folder, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        (F.col("n_nationkey") + 1).alias("geography_id"), _country_code(F.col("n_nationkey")).alias("country_code"),
        F.col("n_name").alias("country_name"), F.col("r_name").alias("region"))


def platforms(spark: SparkSession) -> DataFrame:
    rows = [
        (key, name, Decimal(share), dt.date(*start), dt.date(*end) if end else None, active)
        for key, name, share, start, end, active in PLATFORMS
    ]
    return spark.createDataFrame(rows, schemas.PLATFORM).coalesce(1)


def staging(spark: SparkSession, folder: str, *source_columns: str) -> DataFrame:
    """One pending staging row per line item, with any columns of the source kept alongside.

    Orders meet their customers first, so that the line items move once for both.
    """
    line = table(spark, folder, "lineitem")
    order = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    bought = order.join(customer, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey")
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand")
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_name")
    rows = (
        line.join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    )
    shipped = F.to_date("l_shipdate")
    broken_isrc = (F.col("l_linenumber") == 7) & (F.col("l_returnflag") == "R")
    broken_user = (F.col("l_linenumber") == 6) & (F.col("l_returnflag") == "A")
    half = F.when(F.col("l_linestatus") == "F", F.lit("0.5").cast("decimal(2,1)")).otherwise(0)
    kept_share = F.lit(1) - F.col("l_discount").cast("decimal(4,2)")
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.date_format("l_shipdate", "yyyyMMdd")).alias("id"),
        F.col("c_mktsegment").alias("service"),
        F.add_months(F.trunc(shipped, "MM"), 12 * _YEARS_AHEAD).alias("month"),
        F.concat(F.when(broken_isrc, "BAD").otherwise("INK"),
                 F.substring(_isrc(F.col("l_partkey")), 4, 20)).alias("isrc"),
        F.col("p_name").alias("product"), F.col("p_name").alias("song_name"), F.col("s_name").alias("artist"),
        F.lit(None).cast("string").alias("album"), F.col("p_brand").alias("label"),
        F.col("c_mktsegment").alias("file_name"), _country_code(F.col("c_nationkey")).alias("country"),
        (F.col("l_quantity").cast(_MONEY) + half).cast(_MONEY).alias("total"),
        (F.col("l_extendedprice").cast("decimal(15,2)") * kept_share).cast(_MONEY).alias("royalty"),
        (F.col("l_suppkey") + F.when(broken_user, 1_000_000).otherwise(0)).cast("int").alias("userid"),
        F.lit(PENDING).alias("status"), F.lit(None).cast("string").alias("error_message"),
        (F.col("l_shipdate") + F.expr(f"INTERVAL {_YEARS_AHEAD} YEAR")).alias("created_at"),
        *source_columns,
    )


def payments(facts: DataFrame, songs_df: DataFrame) -> DataFrame:
    """Paid periods: January to March of every loaded year, for song artists with an even number."""
    even = songs_df.where(F.col("artist_id") % 2 == 0).select("song_id", "artist_id")
    first_quarter = facts.where(F.col("month").isin("Jan", "Feb", "Mar")).select("song_id", "year", "month").distinct()
    return first_quarter.join(even, "song_id").select("artist_id", "year", "month").distinct()


def accounts(spark: SparkSession, folder: str) -> DataFrame:
    """User accounts from customers; accounts outside the known countries have a broken address."""
    known = F.col("c_nationkey") < 22
    name = F.concat(F.lit("User."), F.col("c_custkey").cast("string"))
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"), (F.col("c_nationkey") + 1).alias("tenant_id"),
        F.concat(name, F.when(known, "@").otherwise("#"), F.lower("c_mktsegment"), F.lit(".example")).alias("email"),
        F.when(F.col("c_acctbal") > 9000, "SuperAdmin").when(F.col("c_acctbal") < 0, "Guest")
        .otherwise("User").alias("role"))
