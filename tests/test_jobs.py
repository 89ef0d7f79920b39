from decimal import Decimal as D

import pytest
from helpers import rows_of
from test_intake import HEADER

from tuneledger.operators import load
from tuneledger.plans import jobs, refresh, views
from tuneledger.sources import sheets
from tuneledger.sources.warehouse import Warehouse, clustered_by_period, parts_per_period

SONG = "USUM71307667"


def sheet_line(id_, isrc=SONG, month="2025-01-01", service="Spotify", country="CA", total="10", royalty="7", user="1"):
    return f"{service},{month},{isrc},p,Title,Artist,,Label,f,{country},{total},{royalty},{user},{id_}"


def counts(result):
    return dict(rows_of(result.counts))


def test_import_twice_adds_nothing(tiny, spark):
    warehouse = tiny.warehouse()
    first = jobs.import_revenue(spark, warehouse, tiny.text(
        [HEADER, sheet_line("a"), sheet_line("b", country="DE"), sheet_line("c", isrc="X"), sheet_line("d", total="?")]))
    assert (first.success, first.rows_processed, counts(first)) == (True, 3, {"PROCESSED": 2, "FAILED": 1})
    assert first.rejected.count() == 1
    assert first.refreshed.where("refreshed").count() == len(views.STORED)
    assert warehouse.read("fact_monthly_revenue").count() == 2

    same_keys = tiny.text([HEADER, sheet_line("e"), sheet_line("f", month="Feb/25")])
    second = jobs.import_revenue(spark, warehouse, same_keys)
    assert counts(second) == {"PROCESSED": 3, "FAILED": 1, "SKIPPED": 1}
    assert rows_of(warehouse.read("fact_monthly_revenue"), "revenue_id") == [("a",), ("b",), ("f",)]

    same_ids = jobs.import_revenue(spark, warehouse, same_keys)
    assert not same_ids.success and "staging_id_new" in same_ids.message


def test_views_follow_the_touched_periods(tiny, spark):
    warehouse = tiny.warehouse()
    jobs.import_revenue(spark, warehouse, tiny.text([HEADER, sheet_line("a"), sheet_line("b", month="Feb/25")]))
    jobs.import_revenue(spark, warehouse, tiny.text([HEADER, sheet_line("c", isrc="GBAYE0601498", month="Feb/25")]))
    for name, view in views.STORED.items():
        stored = spark.read.parquet(warehouse.path(f"views/{name}"))
        fresh = view(warehouse.star())
        columns = sorted(fresh.columns)
        assert rows_of(stored, *columns) == rows_of(fresh, *columns), name


def test_empty_sheet(tiny, spark):
    result = jobs.import_revenue(spark, tiny.warehouse(), tiny.text([HEADER, sheet_line("a", total="?")]))
    assert (result.success, result.rows_processed, result.message) == (False, 0, "No valid data found in CSV file")


def test_a_failing_view_does_not_stop_the_others(tiny, spark, monkeypatch):
    def broken(star):
        raise RuntimeError("no such column")

    monkeypatch.setitem(views.STORED, "mv_label_performance", broken)
    warehouse = tiny.warehouse()
    result = jobs.import_revenue(spark, warehouse, tiny.text([HEADER, sheet_line("a")]))
    assert result.success and result.message == "Data imported but some views failed to refresh"
    failed = result.refreshed.where("NOT refreshed").collect()
    assert [(r.view, r.message) for r in failed] == [("mv_label_performance", "no such column")]


def test_batch_with_violations_cannot_be_loaded(tiny, spark):
    warehouse = tiny.warehouse()
    kept, _ = sheets.intake_revenue(spark, tiny.text([HEADER, sheet_line("a"), sheet_line("a")]))
    batch = jobs.stage_revenue(warehouse, sheets.to_staging(kept))
    assert batch.violations == {"staging_id_unique": 1}
    with pytest.raises(ValueError):
        jobs.load_batch(warehouse, batch)


def test_upsert_batch_replaces_measures_in_place(tiny, spark):
    warehouse = tiny.warehouse()

    def put(*lines):
        kept, _ = sheets.intake_revenue(spark, tiny.text([HEADER, *lines]))
        return jobs.upsert_batch(warehouse, jobs.stage_revenue(warehouse, sheets.to_staging(kept)))

    put(sheet_line("a", royalty="10"), sheet_line("b", month="Feb/25", royalty="20"))
    touched = put(sheet_line("c", royalty="30", user="2"), sheet_line("d", isrc="GBAYE0601498", royalty="40"))
    assert touched == [(2025, "Jan")]
    assert rows_of(warehouse.read("fact_monthly_revenue"), "revenue_id", "month", "artist_id", "revenue_amount", "royalty_amount") == [
        ("a", "Jan", 1, D(30), D(21)), ("b", "Feb", 1, D(20), D(14)), ("d", "Jan", 1, D(40), D(28))]


def test_import_platforms_judges_each_row(tiny, spark):
    warehouse = tiny.warehouse()
    path = tiny.text(["platform_name,revenue_share_percentage,effective_from",
                      "Spotify,65.00,2026-01-01", "Tidal,70,2025-01-01", "Broken,170,2025-01-01",
                      "Undated,70,soon", "Bad,x,2025-01-01"])
    assert rows_of(jobs.import_platforms(spark, warehouse, path)) == [
        ("Broken", False), ("Spotify", True), ("Tidal", True), ("Undated", False)]
    stored = rows_of(warehouse.read("platform_config"), "platform_name", "revenue_share_percentage", "is_active")
    assert ("Spotify", D("65.00"), True) in stored and ("Spotify", D("70.00"), True) in stored and len(stored) == 5
    ids = [r[0] for r in rows_of(warehouse.read("platform_config"), "platform_id")]
    assert len(ids) == len(set(ids))


def test_only_the_periods_of_a_batch_are_read(warehouse):
    facts = jobs.in_periods(warehouse.star().facts, [(2023, "Apr"), (2023, "May"), (2024, "Jan")])
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(((year" in plan
    assert set(rows_of(facts.select("year", "month").distinct())) == {(2023, "Apr"), (2023, "May"), (2024, "Jan")}


def test_large_periods_are_written_in_song_parts(tiny, spark, star):
    assert [parts_per_period(rows, 2) for rows in (0, 8_000_000, 8_000_001, 80_000_000)] == [1, 1, 2, 10]
    target = tiny.warehouse()
    target.append_facts(star.facts, song_parts=5)
    columns = star.facts.columns
    assert rows_of(target.read("fact_monthly_revenue"), *columns) == rows_of(star.facts, *columns)
    text = clustered_by_period(star.facts, "song_id", song_parts=5)._jdf.queryExecution().executedPlan().toString()
    assert "REBALANCE_PARTITIONS_BY_COL" in text and "song_part" in text


def test_sync_makes_rows_loadable(tiny, spark):
    warehouse = tiny.warehouse()
    path = tiny.text([HEADER, "Spotify,2025-01-01,NEW000000001,p,Title,Ann,,Sony Music,f,US,10,7,50,a"])
    assert rows_of(jobs.sync_dimensions(spark, warehouse, path)) == [("Artists", 4), ("Songs", 5)]
    assert rows_of(jobs.sync_dimensions(spark, warehouse, path)) == [("Artists", 4), ("Songs", 5)]
    assert jobs.backfill_countries(warehouse).count() == 19
    assert jobs.backfill_countries(warehouse).count() == 0
    ids = [r[0] for r in rows_of(warehouse.read("dim_geography"), "geography_id")]
    assert ids == list(range(1, 22))
    assert counts(jobs.import_revenue(spark, warehouse, path)) == {"PROCESSED": 1}
    fact = warehouse.read("fact_monthly_revenue").first()
    assert (fact.song_id, fact.artist_id) == (5, 50) and fact.geography_id is not None


def upserted(spark, tiny, warehouse, *lines):
    kept, _ = sheets.intake_revenue(spark, tiny.text([HEADER, *lines]))
    return jobs.upsert_batch(warehouse, jobs.stage_revenue(warehouse, sheets.to_staging(kept)))


def test_upsert_leaves_other_keys_alone(tiny, spark, monkeypatch):
    for name in list(views.STORED)[2:]:
        monkeypatch.delitem(views.STORED, name)
    warehouse = tiny.warehouse()
    columns = ("revenue_id", "song_id", "geography_id", "revenue_amount")
    jobs.import_revenue(spark, warehouse, tiny.text([
        HEADER, sheet_line("a"), sheet_line("b", country="DE"), sheet_line("c", country="XX"), sheet_line("d")]))
    before = rows_of(warehouse.read("fact_monthly_revenue"), *columns)
    upserted(spark, tiny, warehouse, sheet_line("e", isrc="GBAYE0601498", royalty="40"))
    assert rows_of(warehouse.read("fact_monthly_revenue"), *columns) == sorted([*before, ("e", 2, 1, D(40))])
    # One key per country, the unknown one too; the rows of a key become one.
    upserted(spark, tiny, warehouse, sheet_line("f", country="XX", royalty="5"), sheet_line("g", royalty="6"),
             sheet_line("h", royalty="1"))
    assert {r[0]: r[3] for r in rows_of(warehouse.read("fact_monthly_revenue"), *columns)} == {
        "a": D(7), "b": D(10), "c": D(5), "e": D(40)}
    for name, view in views.STORED.items():
        columns = sorted(view(warehouse.star()).columns)
        assert rows_of(spark.read.parquet(warehouse.path(f"views/{name}")), *columns) == rows_of(
            view(warehouse.star()), *columns), name


def test_upsert_refuses_an_unclean_batch(tiny, spark):
    warehouse = tiny.warehouse()
    with pytest.raises(ValueError, match="staging_id_unique"):
        upserted(spark, tiny, warehouse, sheet_line("a"), sheet_line("a"))


def test_share_zero_pays_no_royalty_in_the_forward_forms(tiny, spark):
    star = tiny.star(platforms=[(1, "Spotify", "0.00", "2025-01-01", None, True)])
    warehouse = tiny.warehouse(star)
    upserted(spark, tiny, warehouse, sheet_line("a", royalty="7"))
    assert rows_of(warehouse.read("fact_monthly_revenue"), "revenue_amount", "royalty_amount") == [(D(7), D(0))]
    staging = tiny.staging([("b", "Spotify", "2025-01-01", SONG, "CA", "10", "7", 1)])
    assert rows_of(load.load_by_details(staging, star)[0], "revenue_amount", "royalty_amount") == [(D(7), D(0))]


@pytest.mark.parametrize("step", ["append", "half an append", "refresh", "publish"])
def test_a_broken_import_ends_as_an_unbroken_one(tiny, spark, monkeypatch, step):
    for name in list(views.STORED)[2:]:
        monkeypatch.delitem(views.STORED, name)
    sheet = tiny.text([HEADER, sheet_line("a"), sheet_line("b", country="DE"), sheet_line("c", month="Feb/25"),
                       sheet_line("d", isrc="X")])
    whole, broken = tiny.warehouse(), tiny.warehouse()
    jobs.import_revenue(spark, whole, sheet)

    def stop(*_, **__):
        raise RuntimeError("driver lost")

    append = Warehouse.append_facts
    with monkeypatch.context() as patch:
        if step == "append":
            patch.setattr(Warehouse, "append_facts", stop)
        elif step == "half an append":
            def half(self, facts, song_parts=1):
                append(self, facts.where("revenue_id = 'a'"), song_parts)
                stop()
            patch.setattr(Warehouse, "append_facts", half)
        else:
            patch.setattr(jobs, "refresh_songs" if step == "refresh" else "publish", stop)
        with pytest.raises(RuntimeError, match="driver lost"):
            jobs.import_revenue(spark, broken, sheet)
    again = jobs.import_revenue(spark, broken, sheet)
    assert again.success and again.refreshed.where("refreshed").count() == len(views.STORED)
    for table, columns in (("fact_monthly_revenue", ("revenue_id", "geography_id", "month", "revenue_amount")),
                           ("stg_revenue_import", ("id", "status", "error_message"))):
        assert rows_of(broken.read(table), *columns) == rows_of(whole.read(table), *columns)
    for name in views.STORED:
        stored = [spark.read.parquet(w.path(f"views/{name}")) for w in (broken, whole)]
        columns = sorted(c for c, kind in stored[0].dtypes if not kind.startswith("timestamp"))  # times of two imports
        assert rows_of(stored[0], *columns) == rows_of(stored[1], *columns), name


def test_sums_that_fail_are_reported_per_view(tiny, spark, monkeypatch):
    def broken(*_):
        raise RuntimeError("no space")

    monkeypatch.setattr(refresh, "rollup", broken)
    result = jobs.import_revenue(spark, tiny.warehouse(), tiny.text([HEADER, sheet_line("a")]))
    assert result.success and result.message == "Data imported but some views failed to refresh"
    assert result.refreshed.where("NOT refreshed").count() == len(views.STORED)


def test_one_wide_share_fails_alone(tiny, spark):
    warehouse = tiny.warehouse()
    path = tiny.text(["platform_name,revenue_share_percentage,effective_from", "Wide,1500,2025-01-01", "Tidal,70,2025-01-01"])
    assert rows_of(jobs.import_platforms(spark, warehouse, path)) == [("Tidal", True), ("Wide", False)]
