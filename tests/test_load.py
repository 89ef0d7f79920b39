from decimal import Decimal as D

import pytest
from helpers import rows_of
from pyspark.sql import functions as F

from tuneledger.operators import load
from tuneledger.sources import sample_warehouse

S1, S3, DRAFT = "USUM71307667", "USRC17607839", "USRC17600004"


def statuses(df):
    return {r.id: (r.status, r.error_message) for r in df.collect()}


def test_order_of_reasons(tiny):
    star = tiny.star(facts=[("old", 2025, "Jan", 1, 1, None, 1, 1, "1", "0.7")])
    staging = tiny.staging([
        ("ok", "Spotify", "2025-02-01", S1, "CA", "1", "1", 1),
        ("again", "Spotify", "2025-01-01", S1, "DE", "1", "1", 999),
        ("isrc", "Nowhere", "2025-02-01", "X", "CA", "1", "1", 999),
        ("platform", "Nowhere", "2025-02-01", DRAFT, "CA", "1", "1", 999),
        ("artist", "Spotify", "2025-02-01", DRAFT, "CA", "1", "1", 999),
        ("draft", "Spotify", "2025-02-01", DRAFT, "CA", "1", "1", 1),
        ("early", "Spotify", "2024-12-01", S1, "CA", "1", "1", 1),
        ("done", "Spotify", "2025-01-01", S1, "CA", "1", "1", 1, "PROCESSED")])
    found = statuses(load.classify(staging, star))
    assert found["ok"] == ("PROCESSED", None)
    assert found["again"] == ("SKIPPED", "Record already exists for this month/isrc/country/service")
    assert found["isrc"] == ("FAILED", "Invalid ISRC")
    assert found["platform"] == ("FAILED", "Invalid platform")
    assert found["artist"] == ("FAILED", "Invalid artist ID")
    assert found["draft"] == found["early"] == ("FAILED", "Song not released")
    assert found["done"] == ("PROCESSED", None)
    assert rows_of(load.load(staging, star), "revenue_id") == [("ok",)]


def test_upsert_form_ignores_dates_in_the_status(tiny):
    staging = tiny.staging([("early", "Spotify", "2024-12-01", S1, "CA", "1", "1", 1)])
    classified = load.classify(staging, tiny.star(), skip_existing=False, window_matters=False)
    assert statuses(classified)["early"] == ("PROCESSED", None)
    assert load.facts_of(classified, tiny.star(), forward=True).count() == 0


def test_overlapping_windows_multiply_facts_but_not_staging_rows(tiny):
    star = tiny.star(platforms=[
        (1, "Spotify", "70.00", "2025-01-01", None, True), (2, "Spotify", "50.00", "2025-01-01", "2025-03-31", True)])
    staging = tiny.staging([("a", "Spotify", "2025-02-01", S1, "CA", "1", "7", 1)])
    assert load.classify(staging, star).count() == 1
    assert rows_of(load.load(staging, star), "platform_id", "revenue_amount") == [(1, D("10.000000")), (2, D("14.000000"))]


def test_share_zero_fails_as_platform(tiny):
    star = tiny.star(platforms=[
        (1, "Free", "0.00", "2025-01-01", None, True), (2, "Mixed", "0.00", "2025-01-01", "2025-01-31", True),
        (3, "Mixed", "50.00", "2025-02-01", None, True)])
    staging = tiny.staging([
        ("a", "Free", "2025-02-01", S1, "CA", "1", "1", 1), ("b", "Mixed", "2025-01-01", S1, "CA", "1", "1", 1),
        ("c", "Mixed", "2025-02-01", S1, "CA", "1", "1", 1)])
    found = statuses(load.classify(staging, star))
    assert found["a"] == found["b"] == ("FAILED", "Invalid platform")
    assert found["c"] == ("PROCESSED", None)


def test_window_bounds_are_inclusive(tiny):
    star = tiny.star(platforms=[(1, "P", "50.00", "2025-02-01", "2025-03-01", True)])
    staging = tiny.staging([(m, "P", m, S1, "CA", "1", "1", 1) for m in
                            ("2025-01-01", "2025-02-01", "2025-03-01", "2025-04-01")])
    assert rows_of(load.load(staging, star), "revenue_id") == [("2025-02-01",), ("2025-03-01",)]


def test_fact_columns(tiny):
    staging = tiny.staging([
        ("a", "YouTube Music", "2025-02-01", S3, "XX", "2.5", "0.55", 1),
        ("b", "YouTube Music", "2025-02-01", S3, "DE", "2.49", "1", 3)])
    rows = {r.revenue_id: r for r in load.load(staging, tiny.star()).collect()}
    a, b = rows["a"], rows["b"]
    assert (a.year, a.month, a.song_id, a.platform_id, a.geography_id, a.artist_id) == (2025, "Feb", 3, 3, None, 1)
    assert (a.total_plays, a.revenue_amount, a.royalty_amount) == (3, D("1.000000"), D("0.550000"))
    assert (b.total_plays, b.geography_id, b.revenue_amount) == (2, 2, D("1.818182"))


def test_forward_load_takes_the_royalty_from_the_revenue(tiny):
    staging = tiny.staging([("a", "YouTube Music", "2025-02-01", S3, "DE", "1", "10", 1)])
    classified = load.classify(staging, tiny.star(), skip_existing=False)
    assert rows_of(load.facts_of(classified, tiny.star(), forward=True), "revenue_amount", "royalty_amount") == [
        (D("10.000000"), D("5.500000"))]


def test_repeats_inside_a_batch_all_load_and_a_second_load_adds_nothing(tiny):
    staging = tiny.staging([(i, "Spotify", "2025-02-01", S1, "CA", "1", "1", 1) for i in "abc"])
    first = load.load(staging, tiny.star())
    assert first.count() == 3
    assert load.load(staging, tiny.star().with_facts(first)).count() == 0


def test_counts_at_the_smallest_scale(warehouse):
    staging = warehouse.read("stg_revenue_import")
    empty = load.classify(staging, sample_warehouse.unloaded(warehouse)).groupBy("status", "error_message").count()
    assert {(r.status, r.error_message): r["count"] for r in empty.collect()} == {
        ("PROCESSED", None): 2879, ("FAILED", "Invalid ISRC"): 319, ("FAILED", "Invalid platform"): 857,
        ("FAILED", "Invalid artist ID"): 231, ("FAILED", "Song not released"): 1714}
    again = load.status_counts(load.classify(staging, sample_warehouse.preloaded(warehouse)))
    assert rows_of(again) == [("FAILED", 3121), ("PROCESSED", 2564), ("SKIPPED", 315)]
    star = warehouse.star()
    assert star.facts.count() == 2879
    assert star.facts.where("geography_id IS NOT NULL").count() == 2612
    shared = star.facts.groupBy(*load.UPSERT_KEY).count().where("count > 1")
    assert shared.count() == 105


def test_upsert_replaces_measures_and_keeps_the_artist(tiny):
    old = tiny.facts([("a", 2025, "Jan", 1, 1, None, 1, 1, "1", "0.7"), ("b", 2025, "Jan", 2, 1, None, 1, 2, "2", "1.4")])
    new = tiny.facts([
        ("c", 2025, "Jan", 1, 1, None, 2, 5, "5", "3.5"), ("d", 2025, "Jan", 1, 1, 1, 3, 6, "6", "4.2"),
        ("e", 2025, "Feb", 1, 1, None, 3, 7, "7", "4.9")])
    merged = load.upsert(load.upsert_source(old), load.upsert_source(new))
    assert rows_of(merged, "year", "month", "song_id", "artist_id", "total_plays", "revenue_amount") == [
        (2025, "Feb", 1, 3, 7, D(7)), (2025, "Jan", 1, 1, 11, D(11)), (2025, "Jan", 2, 1, 2, D(2))]


def test_upsert_by_country_adds_rows_without_country(tiny):
    key = (*load.UPSERT_KEY, "geography_id")
    old = tiny.facts([("a", 2025, "Jan", 1, 1, None, 1, 1, "1", "0.7"), ("b", 2025, "Jan", 1, 1, 1, 1, 2, "2", "1.4")])
    new = tiny.facts([("c", 2025, "Jan", 1, 1, None, 2, 5, "5", "3.5"), ("d", 2025, "Jan", 1, 1, 1, 2, 6, "6", "4.2")])
    merged = load.upsert(load.upsert_source(old, key), load.upsert_source(new, key), key)
    found = sorted((r.geography_id or 0, r.artist_id, r.total_plays) for r in merged.collect())
    assert found == [(0, 1, 1), (0, 2, 5), (1, 1, 6)]


def test_details_variant_marks_all_pending_rows(tiny):
    staging = tiny.staging([
        ("a", "Spotify", "2025-02-01", S3, "CA", "4", "10", 1), ("b", "Nowhere", "2025-02-01", "X", "CA", "4", "10", 1),
        ("c", "Spotify", "2025-02-01", S1, "CA", "4", "10", 1, "FAILED")])
    facts, marked = load.load_by_details(staging, tiny.star())
    assert rows_of(facts, "revenue_id", "artist_id", "royalty_amount") == [("a", 2, D("7.000000"))]
    assert rows_of(marked, "id", "status") == [("a", "PROCESSED"), ("b", "PROCESSED"), ("c", "FAILED")]


def test_song_details(tiny):
    star = tiny.star()
    assert rows_of(load.song_details(star, S3), "song_id", "artist_name", "label_name") == [(3, "Jane Doe", "Universal Music")]
    assert load.song_details(star, DRAFT).count() == 0
    assert load.song_details(star).count() == 3


@pytest.mark.parametrize("token, expected", [
    ("2023-04-01", "2023-04"), ("Apr/23", "2023-04"), ("2023-04", "2023-04"), ("Dec/99", "2099-12"), ("later", None)])
def test_month_tokens(spark, token, expected):
    df = spark.createDataFrame([(token,)], "token string")
    row = load.month_text_to_period(df, "token").collect()[0]
    assert row.period == expected
    assert (row.month is None) == (expected is None)


def test_staging_rows_split_into_statuses(warehouse):
    staging = warehouse.read("stg_revenue_import")
    counts = load.status_counts(load.classify(staging, sample_warehouse.preloaded(warehouse)))
    assert counts.agg(F.sum("count")).first()[0] == staging.count()
