"""Worked examples of the sample data: three songs, January 2025."""

from decimal import Decimal as D

from pyspark.sql import functions as F

from tuneledger.functions.columns import grossed_up, rate
from tuneledger.plans import analytics, reports, views


def test_overview(tiny):
    row = views.revenue_overview(tiny.sample()).collect()[0]
    assert (row.active_artists, row.active_labels, row.active_songs, row.active_platforms) == (2, 2, 3, 2)
    assert (row.total_plays, row.total_revenue, row.total_royalties) == (33000, D(1650), D(1155))
    assert (row.avg_royalty_rate, row.avg_revenue_per_play) == (D("70.00"), D("0.050000"))


def test_platforms(tiny):
    rows = {r.platform_name: r for r in analytics.platform_trends(tiny.sample()).collect()}
    assert set(rows) == {"Spotify", "Apple Music"}
    spotify, apple = rows["Spotify"], rows["Apple Music"]
    assert (spotify.total_plays, spotify.total_revenue, spotify.total_royalties) == (25000, D(1250), D(875))
    assert (apple.total_plays, apple.total_revenue, apple.total_royalties) == (8000, D(400), D(280))
    assert spotify.royalty_percentage == apple.royalty_percentage == D("70.00")
    assert (spotify.unique_songs, spotify.unique_isrcs, apple.unique_songs) == (2, 2, 1)


def test_artist(tiny):
    row = reports.artist_latest_performance(tiny.sample(), 1).collect()[0]
    assert (row.artist_name, row.label_name, row.songs, row.platforms) == ("John Smith", "Sony Music", 2, 2)
    assert (row.plays, row.revenue, row.royalty, row.royalty_percentage) == (18000, D(900), D(630), D("70.00"))


def test_gross_up_and_rate(spark):
    row = spark.range(1).select(
        grossed_up(F.lit(D("0.464605")), F.lit(D("70.00"))).alias("revenue"),
        rate(F.lit(D("0.464605")), F.lit(D("0.663721"))).alias("rate"),
        grossed_up(F.lit(D("1.000000")), F.lit(D("0.00"))).alias("free")).collect()[0]
    assert (row.revenue, row.rate, row.free) == (D("0.663721"), D("70.00"), None)


def test_zero_plays_and_revenue_give_no_ratio(tiny):
    star = tiny.star(facts=[("a", 2025, "Jan", 1, 1, None, 1, 0, "0", "0")])
    row = views.revenue_overview(star).collect()[0]
    assert (row.avg_royalty_rate, row.avg_revenue_per_play) == (None, None)
    assert views.artist_earnings(star).collect()[0].avg_royalty_percentage is None


def test_mean_of_percentages_is_not_the_ratio_of_sums(tiny):
    star = tiny.star(facts=[
        ("a", 2025, "Jan", 1, 1, None, 1, 1, "100", "70"), ("b", 2025, "Jan", 1, 3, None, 1, 1, "900", "495")])
    row = views.artist_earnings(star).collect()[0]
    assert row.avg_royalty_percentage == D("62.50")
    assert analytics.label_rates(star).collect()[0].royalty_percentage == D("56.50")


def test_months_sort_by_calendar(tiny):
    star = tiny.star(facts=[
        ("a", 2025, "Sep", 1, 1, None, 1, 5, "5", "3.5"), ("b", 2025, "Dec", 1, 1, None, 1, 9, "9", "6.3")])
    assert reports.artist_latest_performance(star, 1).collect()[0].month == "Dec"
    assert [r.total_plays for r in analytics.latest_platform_metrics(star).collect()] == [9]
    assert analytics.artist_latest_dashboard(star, 1).collect()[0].month == "Dec"


def test_growth_needs_the_month_before(tiny):
    star = tiny.star(facts=[
        ("a", 2024, "Dec", 1, 1, None, 1, 100, "10", "7"), ("b", 2025, "Jan", 1, 1, None, 1, 150, "5", "3.5"),
        ("c", 2025, "Mar", 1, 1, None, 1, 80, "8", "5.6")])
    rows = {(r.year, r.month): r for r in analytics.artist_growth_dashboard(star).collect()}
    assert rows[2024, "Dec"].plays_growth is None
    assert (rows[2025, "Jan"].plays_growth, rows[2025, "Jan"].revenue_growth) == (D("50.00"), D("-50.00"))
    assert rows[2025, "Jan"].songs_growth == D("0.00")
    assert rows[2025, "Mar"].plays_growth is None


def test_literal_growth_fans_out_over_labels(tiny):
    songs = [(1, "A00000000001", "x", 1, 1, "Released"), (2, "A00000000002", "y", 1, 2, "Released")]
    star = tiny.star(songs=songs, facts=[
        ("a", 2025, "Feb", 1, 1, None, 1, 10, "10", "7"), ("b", 2025, "Feb", 2, 1, None, 1, 20, "20", "14"),
        ("c", 2025, "Apr", 1, 1, None, 1, 30, "30", "21")])
    rows = analytics.artist_growth_dashboard_literal(star).collect()
    assert len(rows) == 6
    assert sorted(r.plays_growth for r in rows if r.month == "Apr") == [D("50.00"), D("200.00")]


def test_missing_revenue_lists_pairs_without_facts(tiny):
    from tuneledger.operators.quality import missing_revenue_check

    facts = [(f"f{i}", 2025, m, 1, 1, None, 1, 1, "1", "0.7") for i, m in enumerate(("Jan", "Sep", "Dec"))]
    facts += [("g", 2025, "Apr", 2, 1, None, 1, 1, "1", "0.7"), ("h", 2024, "Dec", 2, 1, None, 1, 1, "1", "0.7")]
    rows = {(r.isrc, r.platform_name): r for r in missing_revenue_check(tiny.star(facts=facts)).collect()}
    assert len(rows) == 8 and ("USUM71307667", "Spotify") not in rows
    few = rows["GBAYE0601498", "Spotify"]
    assert (few.months_with_data, few.first_month, few.last_month) == (2, "2024-Dec", "2025-Apr")
    none = rows["USUM71307667", "Apple Music"]
    assert (none.months_with_data, none.first_month, none.avg_royalty_rate) == (0, None, None)
