"""Parameterised reports on the star. An argument left at ``None`` adds no filter.

Months are compared in calendar order. Every top-n or single-row report has a full
tie-break, so its result does not depend on the partitioning.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from tuneledger.functions.columns import check_artist, check_period, month_number, narrowed
from tuneledger.operators.star import (
    distinct, measures_of, newest, only, rollup, royalty_rate, sums, with_artist, with_country, with_label, with_platform,
    with_song,
)
from tuneledger.plans import views
from tuneledger.schemas import MONTHS
from tuneledger.sources.warehouse import Star


def _period_facts(star: Star, year: int | None, month: str | None) -> DataFrame:
    """Measures of one period; year and month are partition folders, so only those are read."""
    return narrowed(measures_of(star), year=year, month=month)


def _exists(rows: DataFrame) -> DataFrame:
    """One row telling whether there is any; one matching row per task is enough."""
    return rows.select(F.lit(1).alias("found")).limit(1).agg((F.count("found") > 0).alias("exists"))


def period_exists(star: Star, year: int, month: str) -> DataFrame:
    check_period(year, month)
    return _exists(narrowed(star.facts, year=year, month=month))


def artist_exists(star: Star, artist_id: int) -> DataFrame:
    check_artist(artist_id)
    return _exists(narrowed(star.artists, artist_id=artist_id))


def revenue_overview_lookup(overview: DataFrame, year: int, month: str) -> DataFrame:
    """One period of the overview view, stored or computed."""
    check_period(year, month)
    return narrowed(overview, year=year, month=month)


def artist_latest_performance(star: Star, artist_id: int) -> DataFrame:
    """The latest period of an artist named on sheets; with several labels the smallest label id."""
    check_artist(artist_id)
    facts = narrowed(measures_of(star), sheet_artist=artist_id)
    if star.periods is not None:
        facts = newest(facts, star.periods)
    rows = with_song(rollup(facts, "sheet_artist", *views.SONG_PLATFORM), star, "label_id", released=False)
    grouped = rows.groupBy("sheet_artist", "label_id", "year", "month").agg(
        *distinct(songs="song_id", platforms="platform_id"), *sums("plays", "revenue", "royalty"),
        royalty_rate("royalty_percentage"))
    latest = grouped.orderBy(F.desc("year"), month_number("month").desc(), "label_id").limit(1)
    return with_label(with_artist(latest, star, "sheet_artist"), star).select(
        "artist_id", "artist_name", "label_id", "label_name", "year", "month", "songs", "platforms",
        "plays", "revenue", "royalty", "royalty_percentage")


def artist_earnings(earnings: DataFrame, artist_id: int, year: int | None = None, month: str | None = None) -> DataFrame:
    """Rows of the earnings view for one artist."""
    check_artist(artist_id)
    check_period(year, month)
    return narrowed(earnings, artist_id=artist_id, year=year, month=month)


def platform_metrics_current(analytics: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """Rows of the platform view for the calendar month of ``as_of``, today by default."""
    day = as_of or dt.date.today()
    return narrowed(analytics, year=day.year, month=MONTHS[day.month - 1])


def _defaulted(year: int | None, month: str | None) -> tuple[int, str]:
    today = dt.date.today()
    check_period(year, month, today)
    return year or today.year, month or MONTHS[today.month - 1]


def revenue_by_platform(
        star: Star, year: int | None = None, month: str | None = None, platform_name: str | None = None) -> DataFrame:
    """Per platform in a period, the current one by default; songs of any status."""
    year, month = _defaulted(year, month)
    facts = _period_facts(star, year, month)
    if platform_name is not None:
        facts = only(facts, narrowed(star.platforms, platform_name=platform_name), "platform_id")
    rows = with_platform(rollup(facts, "song_id", "platform_id"), star, "platform_name")
    rows = with_song(rows, star, "isrc", released=False)
    return rows.groupBy("platform_name").agg(*sums(), *distinct(unique_tracks="isrc"))


def top_artists(star: Star, year: int, month: str, n: int = 10) -> DataFrame:
    """Artists of the played songs with the highest revenue in a period."""
    check_period(year, month)
    rows = with_song(rollup(_period_facts(star, year, month), "song_id"), star, "song_artist", released=False)
    grouped = rows.groupBy("song_artist").agg(*distinct(total_songs="song_id"), *sums())
    best = grouped.orderBy(F.desc("total_revenue"), "song_artist").limit(n)
    return with_artist(best, star).select(
        "artist_id", "artist_name", "total_songs", "total_plays", "total_revenue", "total_royalties"
    ).orderBy(F.desc("total_revenue"), "artist_id")


def label_performance_period(
        star: Star, year: int | None = None, month: str | None = None, label_id: int | None = None) -> DataFrame:
    year, month = _defaulted(year, month)
    facts = _period_facts(star, year, month)
    if label_id is not None:
        facts = only(facts, narrowed(star.songs, label_id=label_id), "song_id")
    rows = with_song(rollup(facts, "song_id"), star, "song_artist", "label_id", released=False)
    grouped = rows.groupBy("label_id").agg(
        *distinct(total_artists="song_artist", total_songs="song_id"), *sums())
    return with_label(grouped, star).select(
        "label_id", "label_name", "total_artists", "total_songs", "total_plays", "total_revenue", "total_royalties"
    ).orderBy(F.desc("total_revenue"), "label_id")


def geographic_analysis(
        star: Star, year: int | None = None, month: str | None = None,
        country_code: str | None = None, isrc: str | None = None) -> DataFrame:
    """Per song, sheet artist, country and platform; facts without a known country drop out."""
    check_period(year, month)
    facts = with_platform(_period_facts(star, year, month), star, "platform_name")
    facts = facts.where(F.col("geography_id").isNotNull())
    if isrc is not None:
        # A code is one song: the lookup of its id prunes the fact before the sum.
        facts = only(facts, narrowed(star.songs, isrc=isrc), "song_id")
    if country_code is not None:
        facts = only(facts, narrowed(star.countries, country_code=country_code), "geography_id")
    # Artist names need not be unique and are part of the report's group, hence the second sum.
    sums_by_id = rollup(facts, "year", "month", "song_id", "geography_id", "platform_name", "sheet_artist")
    rows = with_country(sums_by_id, star, "country_code", "region")
    rows = with_song(rows, star, "isrc", "title", released=False)
    grouped = with_artist(rows, star, "sheet_artist").groupBy(
        "year", "month", "isrc", F.col("title").alias("song_name"), "artist_name", "country_code", "region",
        "platform_name").agg(*sums())
    return grouped.orderBy(F.desc("total_revenue"), "year", "month", "isrc", "artist_name", "country_code", "platform_name")


def platform_label_matrix(
        star: Star, year: int | None = None, month: str | None = None, artist_id: int | None = None,
        platform_name: str | None = None, label_name: str | None = None) -> DataFrame:
    """Per platform, label, sheet artist and period."""
    check_period(year, month)
    facts = narrowed(_period_facts(star, year, month), sheet_artist=artist_id)
    if platform_name is not None:
        facts = only(facts, narrowed(star.platforms, platform_name=platform_name), "platform_id")
    if label_name is not None:
        facts = only(facts, only(star.songs, narrowed(star.labels, label_name=label_name), "label_id"), "song_id")
    rows = with_platform(rollup(facts, *views.SONG_PLATFORM, "sheet_artist"), star, "platform_name")
    rows = with_label(with_song(rows, star, "label_id", released=False), star)
    grouped = rows.groupBy("year", "month", "platform_name", "label_id", "label_name", "sheet_artist").agg(
        *distinct(unique_songs="song_id"), *sums())
    return with_artist(grouped, star, "sheet_artist").select(
        "year", "month", "platform_name", "label_id", "label_name", "artist_id", "artist_name",
        "unique_songs", "total_plays", "total_revenue", "total_royalties",
    ).orderBy(F.desc("total_revenue"), "year", "month", "platform_name", "label_id", "artist_id")


def artist_song_performance(
        performance: DataFrame, artist_id: int, year: int | None = None, month: str | None = None,
        isrc: str | None = None) -> DataFrame:
    """Song-level rows of the performance view for one artist."""
    check_artist(artist_id)
    check_period(year, month)
    return narrowed(performance, artist_id=artist_id, year=year, month=month, isrc=isrc)
