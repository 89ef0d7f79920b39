import datetime as dt

import pytest
from helpers import rows_of
from pyspark.sql import functions as F

from tuneledger.functions.columns import check_period
from tuneledger.operators import quality
from tuneledger.plans import analytics, reports, views


def test_argument_checks(star):
    with pytest.raises(ValueError):
        reports.period_exists(star, 2023, "April")
    with pytest.raises(ValueError):
        reports.period_exists(star, 2019, "Apr")
    with pytest.raises(ValueError):
        reports.artist_exists(star, 0)
    check_period(2027, "Jan", today=dt.date(2026, 12, 1))
    with pytest.raises(ValueError):
        check_period(2028, "Jan", today=dt.date(2026, 12, 1))


def test_exists(star):
    assert rows_of(reports.period_exists(star, 2023, "Apr")) == [(True,)]
    assert rows_of(reports.period_exists(star, 2027, "Apr")) == [(False,)]
    assert rows_of(reports.artist_exists(star, 7)) == [(True,)]
    assert rows_of(reports.artist_exists(star, 700)) == [(False,)]


@pytest.mark.parametrize("arguments", [
    {"year": 2023}, {"month": "Apr"}, {"country_code": "AB"}, {"isrc": "INK780000007"},
    {"year": 2023, "month": "Apr", "country_code": "BA"}])
def test_geographic_filters_select_rows_of_the_whole_report(star, arguments):
    whole = reports.geographic_analysis(star)
    for name, value in arguments.items():
        whole = whole.where(F.col(name) == value)
    assert rows_of(reports.geographic_analysis(star, **arguments)) == rows_of(whole)


@pytest.mark.parametrize("arguments", [
    {"year": 2023}, {"month": "Apr"}, {"artist_id": 7}, {"platform_name": "BUILDING"}, {"label_name": "Brand#7"}])
def test_matrix_filters_select_rows_of_the_whole_report(star, arguments):
    whole = reports.platform_label_matrix(star)
    for name, value in arguments.items():
        whole = whole.where(F.col(name) == value)
    assert rows_of(reports.platform_label_matrix(star, **arguments)) == rows_of(whole)


def test_optional_filters_of_period_reports(star):
    labels = reports.label_performance_period(star, 2023, "Apr")
    one = labels.first()
    assert rows_of(reports.label_performance_period(star, 2023, "Apr", one.label_id)) == [tuple(one)]
    platforms = reports.revenue_by_platform(star, 2023, "Apr")
    assert rows_of(reports.revenue_by_platform(star, 2023, "Apr", "BUILDING")) == rows_of(
        platforms.where("platform_name = 'BUILDING'"))


def test_top_artists_are_ordered_and_cut(star):
    revenues = [r.total_revenue for r in reports.top_artists(star, 2023, "Apr", n=3).collect()]
    assert len(revenues) == 3 and revenues == sorted(revenues, reverse=True)


def test_totals_agree_between_views(star):
    def whole(df):
        return df.agg(F.sum("total_plays"), F.sum("total_revenue"), F.sum("total_royalties")).first()

    assert whole(views.artist_platform_label(star)) == whole(views.artist_performance(star)) == whole(
        views.label_performance(star)) == whole(views.artist_earnings(star))


def test_shares_add_up(star):
    regions = analytics.label_geography_share(star).groupBy("label_name", "year", "month")
    sums = regions.agg(F.sum("region_share").alias("s"), F.count("*").alias("n"))
    assert sums.where("abs(s - 100) > 0.005 * n").count() == 0
    platforms = analytics.isrc_geo_platform_share(star).groupBy("isrc", "year", "month")
    sums = platforms.agg(F.sum("platform_share").alias("s"), F.count("*").alias("n"))
    assert sums.where("abs(s - 100) > 0.005 * n").count() == 0


def test_shared_sums_give_the_same_views(star):
    from tuneledger.operators.star import as_measures, rollup

    summed = rollup(as_measures(star.facts), *views.SONG_PLATFORM, "geography_id")
    shared = star.with_facts(star.facts, summed)
    for name, view in views.STORED.items():
        assert rows_of(view(shared)) == rows_of(view(star)), name


def test_current_month_metrics(star):
    found = reports.platform_metrics_current(views.platform_analytics(star), dt.date(2023, 6, 15))
    assert {(r.year, r.month) for r in found.collect()} == {(2023, "Jun")}


def test_latest_dashboard_of_one_artist_is_among_all(star):
    one = rows_of(analytics.artist_latest_dashboard(star, 7))
    assert len(one) == 1
    assert one[0] in rows_of(analytics.artist_latest_dashboard(star))


def test_payment_threshold_and_paid_periods(tiny):
    star = tiny.sample()
    none = tiny.spark.createDataFrame([], "artist_id int, year int, month string")
    assert rows_of(analytics.payment_eligible_artists(star, none), "artist_id") == [(1,), (2,)]
    paid = tiny.spark.createDataFrame([(1, 2025, "Jan"), (2, 2024, "Jan")], "artist_id int, year int, month string")
    assert rows_of(analytics.payment_eligible_artists(star, paid), "artist_id") == [(2,)]


def test_rules_count_violations(tiny):
    facts = tiny.facts([
        ("a", 2025, "Jan", 1, 1, 9, 1, 1, "1", "2"), ("a", 2025, "Foo", 99, 9, None, 99, 1, "1", "0.7"),
        ("b", 2025, "Jan", 1, 1, 9, 1, 1, "1", "0.7")])
    star = tiny.star(
        songs=[(1, "A", "t", 1, 1, "Released"), (2, "A", "t", 77, 77, "Removed")],
        platforms=[(1, "P", "120.00", "2025-01-01", None, True), (2, "P", "10.00", "2025-02-01", None, True)],
        countries=[(1, "CA", "Canada", "x"), (2, "CA", "Canada", "x")]).with_facts(facts)
    staging = tiny.staging([
        ("a", "P", "2025-01-01", "A", "CA", "-1", "1", 1), ("a", "P", "2025-01-01", "A" * 13, "CAN", "1", "1", 1)])
    accounts = tiny.spark.createDataFrame(
        [("A.b@X.example", 1, "Admin"), ("A.b@X.example", 1, "Guest"), ("nobody", 2, "User"), ("a@b.c", None, "User")],
        "email string, tenant_id int, role string")
    found = dict(rows_of(quality.constraint_report(star, staging, accounts)))
    assert {rule for rule, n in found.items() if n} == {
        "staging_amounts_not_negative", "staging_isrc_length", "staging_country_length", "staging_id_unique",
        "fact_royalty_within_revenue", "fact_month_known", "fact_revenue_id_unique",
        "fact_month_song_platform_unique", "fact_month_song_platform_country_unique", "fact_song_exists",
        "fact_artist_exists", "fact_platform_exists", "fact_country_exists", "song_status_known", "song_isrc_unique",
        "song_artist_exists", "song_label_exists", "platform_share_in_range", "platform_windows_disjoint",
        "country_code_unique", "account_email_shape", "account_role_known", "account_email_tenant_unique"}
    assert found["fact_country_exists"] == 2 and found["account_email_shape"] == 2


def test_quality_monitor_counts_suspicious_rows(tiny):
    star = tiny.star(facts=[
        ("a", 2025, "Jan", 1, 1, None, 1, -1, "1", "2"), ("b", 2025, "Jan", 1, 1, None, 1, 1, "1", "0.7")])
    row = quality.revenue_quality_monitor(star).collect()[0]
    assert (row.record_count, row.invalid_royalties, row.negative_plays) == (2, 1, 1)
