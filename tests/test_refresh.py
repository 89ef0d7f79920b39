"""A refresh after a batch against the same views made anew, and what it reads."""

import pytest
from helpers import rows_of
from test_intake import HEADER
from test_jobs import SONG, sheet_line, upserted

from tuneledger.plans import jobs, refresh, views

OTHER = "GBAYE0601498"


def stored(spark, warehouse, name, columns):
    return rows_of(spark.read.parquet(warehouse.path(f"views/{name}")), *columns)


def assert_as_new(spark, warehouse):
    """Every stored view, and the month sums, row by row as from the fact alone."""
    star = warehouse.star()
    for name, view in views.STORED.items():
        fresh = view(star)
        columns = sorted(fresh.columns)
        assert stored(spark, warehouse, name, columns) == rows_of(fresh, *columns), name
    anew = refresh.rollup(refresh.as_measures(star.facts), *refresh.SUM_KEYS)
    order = sorted(anew.columns)
    assert sorted(map(str, refresh.month_sums(warehouse).select(*order).collect())) == sorted(map(str, anew.select(*order).collect()))


@pytest.fixture(scope="module")
def loaded(tiny, spark):
    """Two imports, the second one of a song that the first one has in another country."""
    warehouse = tiny.warehouse()
    jobs.import_revenue(spark, warehouse, tiny.text([
        HEADER, sheet_line("a"), sheet_line("b", country="DE"), sheet_line("c", month="Feb/25"),
        sheet_line("d", isrc=OTHER, service="Apple Music"), sheet_line("e", isrc="USRC17607839", user="2")]))
    return warehouse


def test_one_song_changes_and_all_views_follow(tiny, spark, loaded, monkeypatch):
    asked = []
    monkeypatch.setattr(refresh, "_build", lambda *_: pytest.fail("a view was built from whole periods"))
    monkeypatch.setattr(refresh, "only_songs", lambda df, songs, real=refresh.only_songs: asked.append(rows_of(songs)) or real(df, songs))
    upserted(spark, tiny, loaded, sheet_line("f", royalty="90"), sheet_line("g", isrc=SONG, service="Apple Music", royalty="1"))
    assert asked and all(rows == [(2025, "Jan", 1)] for rows in asked)
    assert_as_new(spark, loaded)
    overview = spark.read.parquet(loaded.path("views/mv_revenue_overview")).where("month = 'Jan'").first()
    assert (overview.active_songs, overview.active_platforms) == (3, 2)


def test_a_member_that_nothing_stands_behind_goes(tiny, spark, loaded):
    """Of an artist's two platforms one disappears when the fact's only row there is taken away."""
    state = loaded.path("state/mv_artist_earnings")
    before = spark.read.parquet(state).where("kind = 'platform_count' AND song_artist = 1 AND month = 'Jan'").count()
    facts = loaded.read("fact_monthly_revenue")
    kept = facts.where("NOT (song_id = 2 AND platform_id = 2)")
    path = loaded.path("kept")
    kept.write.parquet(path)
    loaded.replace_periods(loaded.path("fact_monthly_revenue"), spark.read.parquet(path).select(*facts.columns))
    gone = spark.createDataFrame([(2025, "Jan", 2)], "year int, month string, song_id int")
    assert refresh.refresh_songs(loaded, gone).where("NOT refreshed").count() == 0
    assert_as_new(spark, loaded)
    assert before >= 1
    assert spark.read.parquet(state).where("kind = 'unique_songs' AND member = 2").count() == 0


def test_a_view_that_stayed_behind_is_built_again(tiny, spark, loaded, monkeypatch):
    def broken(star):
        raise RuntimeError("no such column")

    with monkeypatch.context() as patch:
        patch.setitem(views.STORED, "mv_label_performance", broken)
        jobs.import_revenue(spark, loaded, tiny.text([HEADER, sheet_line("h", isrc=OTHER, month="Feb/25")]))
    jobs.import_revenue(spark, loaded, tiny.text([HEADER, sheet_line("i", isrc="USRC17607839", month="Feb/25", user="2")]))
    assert_as_new(spark, loaded)


def test_sums_left_without_a_step_are_added_up_again(tiny, spark, loaded, monkeypatch):
    """A run that broke while it replaced the month sums."""
    with monkeypatch.context() as patch:
        patch.setattr(refresh, "_put", lambda *_, **__: (_ for _ in ()).throw(RuntimeError("no space")))
        result = jobs.import_revenue(spark, loaded, tiny.text([HEADER, sheet_line("j", month="Feb/25", country="DE", service="Apple Music")]))
    assert result.refreshed.where("refreshed").count() == 0
    assert (2025, "Feb") not in refresh.steps_of(loaded)["month_sums"]
    jobs.import_revenue(spark, loaded, tiny.text([HEADER, sheet_line("k", isrc=OTHER, month="Feb/25", service="YouTube Music")]))
    assert_as_new(spark, loaded)


def test_the_fact_is_read_for_the_songs_only(spark, warehouse):
    songs = spark.createDataFrame([(2023, "Apr", 7), (2023, "Apr", 9)], "year int, month string, song_id int")
    facts = refresh.only_songs(refresh.in_periods(warehouse.star().facts, [(2023, "Apr")]), songs)
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(song_id,7)" in plan and "LessThanOrEqual(song_id,9)" in plan
    assert "LeftSemi" in plan and "PartitionFilters: [isnotnull(year" in plan


def test_ids_of_earlier_batches_stay_where_they_are(tiny, spark, loaded):
    batch = loaded.spark.read.parquet(loaded.path("published_ids"))
    assert batch.count() >= 5
    again = jobs.used_again(loaded, spark.createDataFrame([("a",), ("new",)], "id string"), loaded.read("ledger"))
    assert rows_of(again) == [("a",)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        held = spark.table(loaded.published_ids()).join(spark.range(9).selectExpr("CAST(id AS STRING) AS id"), "id", "left_semi")
        plan = held._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    history = plan.split("FileScan parquet")[0].rsplit("Range", 1)[0]
    assert "Bucketed: true" in plan and plan.count("Exchange") == 1 and "Exchange hashpartitioning(id" not in history.split("SortMergeJoin")[1].split("Exchange")[0]


def test_nothing_is_left_open_after_a_batch(spark, loaded):
    begun = loaded.read_if_present("loading")
    assert begun is None or begun.count() == 0


def test_counts_come_from_the_ledger(tiny, spark, loaded):
    expected = {(r["status"], r["count"]) for r in loaded.read("stg_revenue_import").groupBy("status").count().collect()}
    counts = jobs.import_status_counts(loaded)
    assert set(map(tuple, counts.collect())) == expected
    assert "stg_revenue_import" not in counts._jdf.queryExecution().executedPlan().toString()
