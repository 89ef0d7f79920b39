"""The stored report views. Each takes the star's tables and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tuneledger.functions.columns import per_play, rate
from tuneledger.operators.star import (
    distinct, measures_of, rollup, sums, with_artist, with_country, with_label, with_platform, with_song,
)
from tuneledger.sources.warehouse import Star

SONG_PLATFORM = ("year", "month", "song_id", "platform_id")


def base(star: Star) -> DataFrame:
    """The fact added up to month, song and platform."""
    return rollup(measures_of(star), *SONG_PLATFORM)


@dataclass(frozen=True)
class Grouped:
    """A view of sums and distinct counts per group, in parts that a refresh can also apply to changes alone.

    The month sums are added up on ``keys``, looked up by ``rows``, and grouped ``by``. ``members`` names the ids
    that are counted once per group, ``finish`` makes the view's columns of the additive ones and the counts.
    """

    by: tuple[str, ...]
    members: dict[str, str]
    rows: Callable[[DataFrame, Star], DataFrame]
    finish: Callable[[DataFrame, Star], DataFrame]
    keys: tuple[str, ...] = field(default=SONG_PLATFORM)
    dated: bool = False

    def placed(self, measures: DataFrame, star: Star) -> DataFrame:
        """Measures on the keys with the group's columns looked up."""
        return self.rows(rollup(measures, *self.keys), star)

    def __call__(self, star: Star) -> DataFrame:
        dates = [F.min("first_created").alias("first_created"), F.max("last_created").alias("last_created")]
        grouped = self.placed(measures_of(star), star).groupBy(*self.by).agg(
            *sums("plays", "revenue", "royalty"), F.sum("pct_total").alias("pct_total"), F.sum("pct_rows").alias("pct_rows"),
            *distinct(**self.members), *(dates if self.dated else ()))
        return self.finish(grouped, star)


def _totals() -> list[Column]:
    return [F.col("plays").alias("total_plays"), F.col("revenue").alias("total_revenue"), F.col("royalty").alias("total_royalties")]


def _dates() -> list[Column]:
    return [F.col("first_created").alias("earliest_record"), F.col("last_created").alias("latest_record")]


#: Per period: active artists, labels, songs, platforms, totals and ratios.
revenue_overview = Grouped(
    by=("year", "month"),
    members={"active_artists": "song_artist", "active_labels": "label_id", "active_songs": "song_id", "active_platforms": "platform_id"},
    rows=lambda m, star: with_song(with_platform(m, star, active=True), star, "song_artist", "label_id"),
    finish=lambda g, star: g.select(
        "year", "month", "active_artists", "active_labels", "active_songs", "active_platforms", *_totals(),
        rate("royalty", "revenue").alias("avg_royalty_rate"), per_play("revenue", "plays").alias("avg_revenue_per_play"), *_dates()),
    dated=True)


def revenue_overview_compact(star: Star) -> DataFrame:
    return revenue_overview(star).drop("avg_revenue_per_play", "earliest_record", "latest_record")


def artist_dashboard(star: Star) -> DataFrame:
    """Row level: one line per fact with the names of its artist, label and platform."""
    facts = star.facts.withColumnRenamed("artist_id", "sheet_artist")
    rows = with_platform(facts, star, "platform_name")
    rows = with_artist(with_label(with_song(rows, star, "isrc", "song_artist", "label_id"), star), star)
    return rows.select(
        "revenue_id", "artist_id", "artist_name", "label_id", "label_name", "year", "month", "isrc",
        F.col("platform_name").alias("service"), F.col("total_plays").alias("plays"),
        F.col("revenue_amount").alias("revenue"), F.col("royalty_amount").alias("royalty"),
        rate("royalty_amount", "revenue_amount").alias("royalty_percentage"))


def artist_dashboard_totals(star: Star) -> DataFrame:
    """Per artist named on the sheet and period."""
    rows = with_song(rollup(measures_of(star), *SONG_PLATFORM, "sheet_artist"), star)
    grouped = rows.groupBy("sheet_artist", "year", "month").agg(
        *distinct(songs="song_id", platforms="platform_id"), *sums("plays", "revenue", "royalty"))
    return with_artist(grouped, star, "sheet_artist").select(
        "artist_id", "artist_name", "year", "month", "songs", "platforms", "plays", "revenue", "royalty")


#: Per active platform, share and period. A code belongs to one song, so codes count as songs.
platform_analytics = Grouped(
    by=("platform_name", "revenue_share_percentage", "year", "month"),
    members={"unique_songs": "song_id", "unique_artists": "song_artist", "unique_labels": "label_id"},
    rows=lambda m, star: with_song(
        with_platform(m, star, "platform_name", "revenue_share_percentage", active=True), star, "song_artist", "label_id"),
    finish=lambda g, star: g.select(
        "platform_name", "revenue_share_percentage", "year", "month", "unique_songs", "unique_artists", "unique_labels",
        *_totals(), *_dates(), F.col("unique_songs").alias("unique_isrcs")),
    dated=True)

#: Per artist and period; the percentage is the mean over fact rows, not a ratio of sums.
artist_earnings = Grouped(
    by=("year", "month", "song_artist"),
    members={"unique_songs": "song_id", "platform_count": "platform_id"},
    rows=lambda m, star: with_song(m, star, "song_artist"),
    finish=lambda g, star: with_artist(g, star).select(
        "year", "month", "artist_id", "artist_name", *_totals(),
        F.round(F.col("pct_total") / F.nullif(F.col("pct_rows"), F.lit(0)), 2).alias("avg_royalty_percentage"),
        "unique_songs", "platform_count"))

#: Per platform, share and period, inactive platforms included.
platform_revenue = Grouped(
    by=("year", "month", "platform_name", "revenue_share_percentage"),
    members={"songs_played": "song_id", "unique_artists": "song_artist"},
    rows=lambda m, star: with_song(with_platform(m, star, "platform_name", "revenue_share_percentage"), star, "song_artist"),
    finish=lambda g, star: g.select(
        "year", "month", "platform_name", "revenue_share_percentage", "songs_played", "unique_artists", *_totals()))


def artist_performance(star: Star) -> DataFrame:
    """Per song and period: grouped on the song id, names looked up afterwards."""
    grouped = measures_of(star).groupBy("year", "month", "song_id").agg(
        *sums(), *distinct(platform_count="platform_id"))
    named = with_artist(with_song(grouped, star, "song_artist", "title", "isrc"), star)
    return named.select(
        "year", "month", "artist_id", "artist_name", "song_id", F.col("title").alias("song_name"), "isrc",
        "total_plays", "total_revenue", "total_royalties", "platform_count")


label_performance = Grouped(
    by=("year", "month", "label_id"),
    members={"unique_artists": "song_artist", "unique_songs": "song_id"},
    rows=lambda m, star: with_song(m, star, "song_artist", "label_id"),
    finish=lambda g, star: with_label(g, star).select(
        "year", "month", "label_id", "label_name", "unique_artists", "unique_songs", *_totals()),
    keys=("year", "month", "song_id"))

artist_platform_label = Grouped(
    by=("year", "month", "song_artist", "platform_name", "label_name"),
    members={"unique_songs": "song_id"},
    rows=lambda m, star: with_label(with_song(with_platform(m, star, "platform_name"), star, "song_artist", "label_id"), star),
    finish=lambda g, star: with_artist(g, star).select(
        "year", "month", "artist_id", "artist_name", "platform_name", "label_name", "unique_songs", *_totals()))


def isrc_geo_platform(star: Star) -> DataFrame:
    """Per song, country and platform name: one grouping on ids, names looked up afterwards."""
    named = with_platform(measures_of(star), star, "platform_name")
    grouped = named.where(F.col("geography_id").isNotNull()).groupBy(
        "year", "month", "song_id", "geography_id", "platform_name").agg(*sums())
    rows = with_country(grouped, star, "country_code", "region")
    rows = with_artist(with_song(rows, star, "isrc", "title", "song_artist"), star)
    return rows.select(
        "year", "month", "isrc", F.col("title").alias("song_name"), "artist_name", "country_code", "region",
        "platform_name", "total_plays", "total_revenue", "total_royalties")


# Views written by the refresh job.
STORED: dict[str, Callable[[Star], DataFrame]] = {
    "mv_revenue_overview": revenue_overview,
    "mv_artist_dashboard": artist_dashboard,
    "mv_platform_analytics": platform_analytics,
    "mv_artist_earnings": artist_earnings,
    "mv_platform_revenue": platform_revenue,
    "mv_artist_performance": artist_performance,
    "mv_label_performance": label_performance,
    "mv_artist_platform_label": artist_platform_label,
    "mv_isrc_geo_platform": isrc_geo_platform,
}

# Views whose rows belong to one song and carry its code.
BY_SONG = ("mv_artist_dashboard", "mv_artist_performance", "mv_isrc_geo_platform")

# Other forms of two views, computed on demand.
VARIANTS: dict[str, Callable[[Star], DataFrame]] = {
    "mv_revenue_overview_compact": revenue_overview_compact,
    "mv_artist_dashboard_agg": artist_dashboard_totals,
}
