"""What the plans must show: pruned folders and columns, pushed filters, no cross join, no Python."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
from tuneledger.operators import quality
from tuneledger.operators.star import newest, of_artist
from tuneledger.plans import analytics, refresh, reports, views
from tuneledger.session import shared_dir

LAZY = [name for name in spark_entry._registered()
        if name not in ("import_revenue", "import_platforms", "refresh_views", "upsert_job")]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_python(spark, folder, name):
    text = plan(spark_entry.queries()[name](spark, folder))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "InPandas"):
        assert word not in text


def test_period_reports_read_one_folder(star):
    for df in (reports.revenue_by_platform(star, 2023, "Apr"), reports.top_artists(star, 2023, "Apr"),
               reports.revenue_overview_lookup(views.revenue_overview(star), 2023, "Apr")):
        assert "(year#" in plan(df).split("PartitionFilters: [")[1].split("]")[0]


def test_only_needed_columns_are_read(star):
    text = plan(views.label_performance(star))
    fact = next(part for part in text.split("FileScan parquet ") if "total_plays" in part.split("]")[0])
    assert "created_at" not in fact.split("]")[0] and "revenue_id" not in fact.split("]")[0]


def test_song_status_is_pushed_to_the_scan(star):
    assert "EqualTo(status,Released)" in plan(views.revenue_overview(star))


def test_facts_are_combined_before_any_join(star):
    below_joins = plan(views.revenue_overview(star)).split("HashJoin")[-1]
    assert "partial_sum(plays" in below_joins and "FileScan" in below_joins


def test_latest_period_prunes_the_fact(star):
    text = plan(analytics.latest_platform_metrics(star))
    assert "PartitionFilters: [isnotnull(year" in text and "dynamicpruning" in plan(analytics.latest_platform_metrics(replace(star, periods=None)))


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_filters_on_names_come_before_the_sum(star):
    for df in (reports.revenue_by_platform(star, 2023, "Apr", platform_name="BUILDING"),
               reports.label_performance_period(star, 2023, "Apr", label_id=3),
               reports.geographic_analysis(star, 2023, country_code="AB"),
               reports.platform_label_matrix(star, platform_name="BUILDING", label_name="Brand#13"),
               analytics.artist_song_summary(star, artist_id=7), analytics.artist_latest_dashboard(star, artist_id=7),
               views.artist_earnings(of_artist(star, 7)), views.artist_performance(of_artist(star, 7))):
        below = plan(df).split("partial_sum(plays")[-1]  # the plan prints inputs below their users
        assert "LeftSemi" in below


def test_reports_start_from_the_stored_sums(warehouse):
    summed = refresh.summed_star(warehouse)
    for report in (views.revenue_overview, analytics.platform_activity, analytics.label_geography_share,
                   lambda star: reports.top_artists(star, 2023, "Apr"), quality.missing_revenue_check):
        files = report(summed).inputFiles()
        assert any("state/month_sums" in f for f in files) and not any("fact_monthly_revenue" in f for f in files)


def test_a_current_report_reads_the_newest_folders_only(star):
    last = star.periods[-1]
    rows = newest(star.facts, star.periods)
    assert {(r["year"], r["month"]) for r in rows.select("year", "month").distinct().collect()} == {last}
    older = star.facts.where((F.col("year") == 2021) & (F.col("month") == "Mar"))
    assert {(r["year"], r["month"]) for r in newest(older, star.periods).select("year", "month").distinct().collect()} == {(2021, "Mar")}
    assert newest(star.facts.where("false"), star.periods).count() == 0


def test_constraints_read_the_fact_twice(spark, folder, warehouse):
    text = plan(quality.constraint_report(warehouse.star(), warehouse.read("stg_revenue_import")))
    scans = [part.split("\n")[0] for part in text.split("FileScan parquet ")[1:]]
    assert sum("song_id" in scan.split("]")[0] and "platform_id" in scan.split("]")[0] for scan in scans) == 2


def test_only_missing_pairs_are_unfolded(star):
    """Rows behind the unfolding are those of the report: no song or platform is unknown here."""
    rows = quality.missing_revenue_check(star)
    text = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "array_except" in text.split("Generate explode")[1].split("\n")[0]
