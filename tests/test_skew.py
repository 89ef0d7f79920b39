"""A key that holds a third of all rows: whole results, and a split join."""

import datetime as dt
from contextlib import contextmanager
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tuneledger import schemas
from tuneledger.operators import load
from tuneledger.plans import analytics, views

ROWS, SONGS = 60_000, 200


@contextmanager
def settings(spark, **values):
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@pytest.fixture(scope="module")
def skewed(tiny):
    songs = [(n, f"SONG{n:08d}", f"Title {n}", 1 + n % 2, 1 + n % 3, "Released") for n in range(1, SONGS + 1)]
    star = tiny.star(songs=songs)
    number = F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % SONGS + 1)
    month = F.when(F.col("id") % 3 == 0, 0).otherwise((F.col("id") % 12).cast("int"))
    staging = tiny.spark.range(ROWS, numPartitions=8).select(
        F.col("id").cast("string").alias("id"), F.lit("Spotify").alias("service"),
        F.add_months(F.lit(dt.date(2025, 1, 1)), month).alias("month"),
        F.concat(F.lit("SONG"), F.lpad(number.cast("string"), 8, "0")).alias("isrc"),
        F.sha2(F.col("id").cast("string"), 512).alias("product"), F.lit("t").alias("song_name"),
        F.lit("a").alias("artist"), F.lit(None).cast("string").alias("album"), F.lit("l").alias("label"),
        F.lit(None).cast("string").alias("file_name"), F.lit("CA").alias("country"),
        F.lit(D("2")).cast("decimal(15,6)").alias("total"), F.lit(D("0.7")).cast("decimal(15,6)").alias("royalty"),
        F.lit(1).alias("userid"), F.lit("PENDING").alias("status"), F.lit(None).cast("string").alias("error_message"),
        F.lit(dt.datetime(2025, 1, 1)).cast("timestamp_ntz").alias("created_at"))
    return star, staging.select(*schemas.STAGING.fieldNames())


def test_join_on_a_hot_code_is_split_and_whole(spark, skewed):
    star, staging = skewed
    with settings(spark, **{
            "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB", "spark.sql.shuffle.partitions": "16"}):
        classified = load.classify(staging, star)
        rows = classified.collect()
        final = classified._jdf.queryExecution().executedPlan().toString()
    assert len(rows) == ROWS and {r.status for r in rows} == {"PROCESSED"}
    assert "skew=true" in final


def test_sums_over_a_hot_song_are_whole(skewed):
    star, staging = skewed
    loaded = star.with_facts(load.load(staging, star))
    overview = {r.month: r for r in views.revenue_overview(loaded).collect()}
    assert sum(r.total_plays for r in overview.values()) == 2 * ROWS
    expected = {}
    for n in range(ROWS):
        song, month = (1, 0) if n % 3 == 0 else (n % SONGS + 1, n % 12)
        expected.setdefault(schemas.MONTHS[month], []).append(song)
    for month, songs in expected.items():
        row = overview[month]
        assert row.total_plays == 2 * len(songs) and row.active_songs == len(set(songs))
        assert row.total_revenue == D(len(songs)) and row.avg_royalty_rate == D("70.00")
    songs = analytics.isrc_performance(loaded).where("isrc = 'SONG00000001' AND month = 'Jan'").first()
    assert songs.total_plays == 2 * expected["Jan"].count(1)
