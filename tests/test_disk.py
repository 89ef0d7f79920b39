"""What the sample warehouse and the jobs leave on disk, and what lies there at once."""

import datetime as dt
import os
import threading
import time

import pytest
from helpers import rows_of
from test_intake import HEADER
from test_jobs import SONG, sheet_line, upserted

from tuneledger.operators import load
from tuneledger.plans import jobs, refresh, views
from tuneledger.session import shared_dir
from tuneledger.sources import sample_sheets, sample_star, sample_warehouse, sheets


def shuffled(spark) -> set[str]:
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {block for block in blocks.mkString(" ").split() if block.startswith("shuffle_")}


def assert_no_more_shuffled(spark, before: set[str]) -> None:
    """Files are removed behind the action's back, so some seconds are granted."""
    end = time.time() + 20
    while shuffled(spark) - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffled(spark) - before


def folders(spark, warehouse) -> set[str]:
    """Folders of the shared folder, and the batches that wait in the warehouse."""
    shared = shared_dir(spark).removeprefix("file:")
    waiting = [warehouse.path(name).removeprefix("file:") for name in ("pending", "classified")]
    return {*os.listdir(shared), *(f"{w}/{batch}" for w in waiting if os.path.isdir(w) for batch in os.listdir(w))}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory) -> str:
    """A few rows of each supplied table; the last line item's order is unknown."""
    folder = tmp_path_factory.mktemp("tables")
    shipped = dt.datetime(1998, 1, 20)
    made = {
        "customer": ("c_custkey long, c_mktsegment string, c_nationkey int, c_acctbal double",
                     [(1, "AUTOMOBILE", 2, 1.0), (2, "BUILDING", 3, 1.0)]),
        "orders": ("o_orderkey long, o_custkey long", [(10, 1), (11, 2), (12, 1)]),
        "part": ("p_partkey long, p_name string, p_brand string, p_type string",
                 [(21, "bolt", "Brand#11", "SMALL"), (22, "nut", "Brand#12", "PROMO")]),
        "supplier": ("s_suppkey long, s_name string", [(1, "Ann"), (2, "Bob")]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(2, "CHAD", 0), (3, "DENMARK", 0)]),
        "region": ("r_regionkey int, r_name string", [(0, "HERE")]),
        "lineitem": (
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
            "l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
            [(order, part, 1 + k % 2, k, 2.0, 100.0, 0.1, "N", "O", shipped)
             for k, (order, part) in enumerate([(10, 21), (11, 21), (12, 22), (10, 21), (11, 22), (99, 21)], 1)]),
    }
    for name, (schema, rows) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_building_leaves_no_shuffle_files(spark, tables, monkeypatch):
    monkeypatch.setattr(sample_warehouse, "_BUILT", {})
    before = shuffled(spark)
    built = sample_warehouse.build(spark, tables)
    assert_no_more_shuffled(spark, before)
    assert rows_of(built.read("stg_revenue_import"), "id", "service", "country") == [
        ("10-1-21-2-19980120", "AUTOMOBILE", "AC"), ("10-4-21-1-19980120", "AUTOMOBILE", "AC"),
        ("11-2-21-1-19980120", "BUILDING", "AD"), ("11-5-22-2-19980120", "BUILDING", "AD"), ("12-3-22-2-19980120", "AUTOMOBILE", "AC")]
    assert {r[0] for r in rows_of(built.read("fact_monthly_revenue"), "revenue_id")} == {
        "10-1-21-2-19980120", "10-4-21-1-19980120", "11-2-21-1-19980120"}


def test_line_items_move_once_for_orders_and_customers(spark, tables):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sample_star.staging(spark, tables)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Three joins of line items: with bought orders, parts and suppliers.
    assert plan.count("Exchange hashpartitioning(l_") == 3 and plan.count("Exchange hashpartitioning(o_custkey") == 1
    assert "l_orderkey" not in plan.split("Exchange hashpartitioning(o_custkey")[1].split("FileScan")[1]


def test_rows_that_do_not_load_move_no_further(tiny):
    staging = tiny.staging([("a", "Spotify", "2025-01-01", SONG, "CA", "10", "7", 1), ("b", "Spotify", "2025-01-01", "X", "CA", "10", "7", 1),
                            ("c", "Spotify", "2025-01-01", SONG, "CA", "10", "7", 9), ("d", "Spotify", "2025-01-01", SONG, "XX", "10", "7", 1)])
    facts = load.load(staging, tiny.star())
    assert rows_of(facts, "revenue_id") == [("a",), ("d",)]
    # Songs and artists are met by inner joins; only repeats and countries need an outer one.
    assert facts._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 2


def test_an_empty_fact_is_not_joined(tiny):
    star = tiny.warehouse().star()
    staging = tiny.staging([("a", "Spotify", "2025-01-01", SONG, "CA", "10", "7", 1)])
    facts = load.load(staging, star)
    assert rows_of(facts, "revenue_id") == [("a",)]
    assert facts._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 1


@pytest.fixture
def two_views(monkeypatch):
    for name in list(views.STORED)[2:]:
        monkeypatch.delitem(views.STORED, name)


def test_a_refresh_leaves_no_shuffles_and_no_folders(spark, tiny, two_views):
    warehouse = tiny.warehouse()
    warehouse.append_facts(tiny.sample().facts)
    files, before = shuffled(spark), folders(spark, warehouse)
    assert all(row["refreshed"] for row in jobs.refresh_views(warehouse).collect())
    gone = spark.createDataFrame([(2025, "Jan", 2)], "year int, month string, song_id int")
    assert all(row["refreshed"] for row in refresh.refresh_songs(warehouse, gone).collect())
    assert folders(spark, warehouse) == before
    assert_no_more_shuffled(spark, files)


def test_large_views_are_refreshed_one_by_one(tiny, monkeypatch):
    running, most, lock, build = [], [], threading.Lock(), refresh._build

    def counted(warehouse, name, *rest):
        with lock:
            running.append(name)
            most.append(len(running))
        try:
            time.sleep(0.3)
            build(warehouse, name, *rest)
        finally:
            running.remove(name)

    monkeypatch.setattr(refresh, "_build", counted)
    monkeypatch.setattr(refresh, "LARGE_SUMS", 0)
    for name in list(views.STORED)[3:]:
        monkeypatch.delitem(views.STORED, name)
    warehouse = tiny.warehouse()
    warehouse.append_facts(tiny.sample().facts)
    assert jobs.refresh_views(warehouse).where("refreshed").count() == 3
    assert max(most) == 1


def test_an_upsert_leaves_its_tables_only(spark, tiny, two_views):
    warehouse = tiny.warehouse()
    jobs.import_revenue(spark, warehouse, tiny.text([HEADER, sheet_line("a"), sheet_line("b", month="Feb/25")]))
    sheet = tiny.text([HEADER, sheet_line("c", royalty="30")])
    files, before = shuffled(spark), folders(spark, warehouse)
    kept, _ = sheets.intake_revenue(spark, sheet)
    jobs.upsert_batch(warehouse, jobs.stage_revenue(warehouse, sheets.to_staging(kept)))
    assert folders(spark, warehouse) == before
    assert_no_more_shuffled(spark, files)
    assert rows_of(warehouse.read("stg_revenue_import"), "id") == [("a",), ("b",), ("c",)]


def test_an_import_leaves_its_tables_only(spark, tiny, two_views):
    warehouse, sheet = tiny.warehouse(), tiny.text([HEADER, sheet_line("a"), sheet_line("b", isrc="X")])
    before = folders(spark, warehouse)
    assert jobs.import_revenue(spark, warehouse, sheet).success
    assert folders(spark, warehouse) == before


def test_published_batches_leave_no_pending_rows(tiny):
    warehouse = tiny.warehouse()
    for id_, country in (("a", "CA"), ("b", "DE")):
        batch = jobs.stage_revenue(warehouse, tiny.staging([(id_, "Spotify", "2025-01-01", SONG, country, "10", "7", 1)]))
        jobs.publish(warehouse, jobs.append_batch(warehouse, batch)[0], batch.name)
    batch = jobs.stage_revenue(warehouse, tiny.staging([("c", "Spotify", "2025-02-01", SONG, "CA", "10", "7", 1)]))
    rows, loaded = jobs.load_batch(warehouse, batch)
    assert (rows_of(rows, "id", "status"), loaded) == ([("c", "PROCESSED")], [(2025, "Feb")])
    assert os.listdir(warehouse.path("pending").removeprefix("file:")) == []
    assert rows_of(jobs.import_status_counts(warehouse)) == [("PROCESSED", 2), ("SKIPPED", 1)]


def test_the_sample_sheet_is_compressed(spark, tables, tmp_path):
    sample_sheets.write_revenue_sheet(spark, tables, f"{tmp_path}/sheet")
    parts = [name for name in os.listdir(f"{tmp_path}/sheet") if name.startswith("part")]
    assert parts and all(name.endswith(".csv.gz") for name in parts)
    kept, rejected = sheets.intake_revenue(spark, f"{tmp_path}/sheet")
    assert (kept.count(), rejected.count()) == (4, 1)
