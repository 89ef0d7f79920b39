"""Further analytical reports: rates, growth, shares, statements, eligibility, latest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tuneledger.functions.columns import (
    check_artist, check_period, growth, month_in, month_number, narrowed, per_play, period_index, rate, total,
    year_in,
)
from tuneledger.operators.star import (
    created_range, distinct, measures_of, newest, of_artist, only, revenue_per_play, rollup, royalty_rate, sums, with_artist,
    with_country, with_label, with_platform, with_song,
)
from tuneledger.plans.views import base, label_performance, platform_analytics
from tuneledger.sources.warehouse import Star


def artist_label_earnings(star: Star) -> DataFrame:
    rows = with_label(with_song(base(star), star, "song_artist", "label_id"), star)
    grouped = rows.groupBy("year", "month", "song_artist", "label_name").agg(
        *distinct(song_count="song_id", platform_count="platform_id"),
        *sums("play_count", "gross_revenue", "artist_royalty"), royalty_rate("royalty_percentage"), *created_range())
    return with_artist(grouped, star).drop("song_artist")


def platform_activity(star: Star) -> DataFrame:
    """Active platforms, songs of any status."""
    rows = with_platform(base(star), star, "platform_name", active=True)
    rows = with_song(rows, star, "song_artist", "label_id", released=False)
    return rows.groupBy("year", "month", "platform_name").agg(
        *sums(royalty=None), *distinct(unique_songs="song_id", unique_artists="song_artist", unique_labels="label_id"))


def artist_label_performance(star: Star) -> DataFrame:
    rows = with_song(base(star), star, "song_artist", "label_id")
    grouped = rows.groupBy("year", "month", "song_artist", "label_id").agg(
        *distinct(song_count="song_id", platform_count="platform_id"),
        *sums("total_plays", "gross_revenue", "royalty_earned"), royalty_rate("royalty_percentage"))
    return with_label(with_artist(grouped, star), star).drop("song_artist")


def royalty_statement(star: Star, artist_id: int, year: int, month: str) -> DataFrame:
    """Fact rows of one artist's released songs on active platforms in one period."""
    check_artist(artist_id)
    check_period(year, month)
    songs = with_song(narrowed(star.facts, year=year, month=month).drop("artist_id"), star,
                      "title", "isrc", "song_artist", "label_id")
    rows = with_label(narrowed(songs, song_artist=artist_id), star)
    rows = with_platform(rows, star, "platform_name", "revenue_share_percentage", active=True)
    return rows.select(
        F.col("title").alias("song_title"), "isrc", "label_name", F.col("platform_name").alias("platform"),
        F.col("total_plays").alias("play_count"), F.col("revenue_amount").alias("gross_revenue"),
        "royalty_amount", "revenue_share_percentage",
    ).orderBy(F.desc("gross_revenue"), "isrc", "platform")


def payment_eligible_artists(star: Star, payments: DataFrame) -> DataFrame:
    """Artist and label pairs whose royalties of unpaid periods reach the artist's threshold."""
    rows = with_song(base(star), star, "song_artist", "label_id")
    paid = payments.select(F.col("artist_id").alias("song_artist"), "year", "month")
    unpaid = with_label(rows.join(paid, ["song_artist", "year", "month"], "left_anti"), star)
    grouped = unpaid.groupBy("song_artist", "label_name").agg(
        total("royalty").alias("unpaid_royalties"),
        *distinct(song_count="song_id", platform_count="platform_id"))
    artists = star.artists.select("artist_id", "artist_name", "payment_threshold")
    reached = F.col("unpaid_royalties") >= F.col("payment_threshold")
    return grouped.join(artists, (F.col("song_artist") == F.col("artist_id")) & reached).select(
        "artist_id", "artist_name", "label_name", "unpaid_royalties", "song_count", "platform_count")


def _artist_label_totals(star: Star) -> DataFrame:
    rows = with_song(base(star), star, "song_artist", "label_id")
    return rows.groupBy("song_artist", "label_id", "year", "month").agg(
        *distinct(songs="song_id", platforms="platform_id"), *sums("plays", "revenue", "royalty"))


def _with_growth(rows: DataFrame, star: Star) -> DataFrame:
    now = rows.withColumns({
        "royalty_percentage": rate("royalty", "revenue"),
        "plays_growth": growth(F.col("plays"), F.col("prev_plays")),
        "revenue_growth": growth(F.col("revenue"), F.col("prev_revenue")),
        "songs_growth": growth(F.col("songs"), F.col("prev_songs")),
    })
    return with_label(with_artist(now, star), star).select(
        "artist_id", "artist_name", "label_id", "label_name", "year", "month", "songs", "platforms", "plays",
        "revenue", "royalty", "royalty_percentage", "plays_growth", "revenue_growth", "songs_growth")


def artist_growth_dashboard(star: Star) -> DataFrame:
    """Totals per artist, label and period with growth against the calendar month before.

    One window per artist and label over its few months replaces a join of the totals to themselves.
    """
    totals = _artist_label_totals(star).withColumn("period", period_index())
    by_month = Window.partitionBy("song_artist", "label_id").orderBy("period")
    follows = F.lag("period").over(by_month) == F.col("period") - 1
    rows = totals.withColumns(
        {f"prev_{c}": F.when(follows, F.lag(c).over(by_month)) for c in ("plays", "revenue", "songs")})
    return _with_growth(rows, star)


def artist_growth_dashboard_literal(star: Star) -> DataFrame:
    """Growth against one fixed period: that of the second row of all totals, newest first.

    Months are ordered as text here, and the earlier totals are matched on the artist only,
    so an artist with several labels in that period yields several rows.
    """
    totals = _artist_label_totals(star)
    second = totals.select("year", "month").orderBy(F.desc("year"), F.desc("month")).offset(1).limit(1)
    earlier = totals.join(second, ["year", "month"]).select(
        F.col("song_artist").alias("prev_artist"), F.col("plays").alias("prev_plays"),
        F.col("revenue").alias("prev_revenue"), F.col("songs").alias("prev_songs"))
    rows = totals.join(earlier, F.col("song_artist") == F.col("prev_artist"), "left")
    return _with_growth(rows, star)


def artist_latest_dashboard(star: Star, artist_id: int | None = None) -> DataFrame:
    """Latest growth row of one artist, or of every artist; ties go to the smallest label id."""
    growth_rows = artist_growth_dashboard(star if artist_id is None else of_artist(star, artist_id))
    newest = F.struct(F.col("year"), month_number("month"), -F.col("label_id"))
    kept = [c for c in growth_rows.columns if c != "artist_id"]
    latest = growth_rows.groupBy("artist_id").agg(F.max_by(F.struct(*kept), newest).alias("row"))
    return latest.select("artist_id", "row.*")


def label_rates(star: Star) -> DataFrame:
    return label_performance(star).select(
        "year", "month", "label_id", "label_name", F.col("unique_artists").alias("artist_count"),
        F.col("unique_songs").alias("song_count"), "total_plays", "total_revenue", "total_royalties",
        rate("total_royalties", "total_revenue").alias("royalty_percentage"),
        per_play("total_revenue", "total_plays").alias("revenue_per_play"))


def isrc_performance(star: Star) -> DataFrame:
    """Per song and period, with the mean over platforms of the revenue per play."""
    each = F.col("revenue").cast("decimal(25,6)") / F.nullif(F.col("plays").cast("decimal(20,0)"), F.lit(0))
    per_song = base(star).withColumn("each", each).groupBy("year", "month", "song_id").agg(
        *sums(), F.count("platform_id").alias("platform_count"),
        F.round(F.sum("each") / F.nullif(F.count("each"), F.lit(0)), 6).alias("avg_revenue_per_play"))
    rows = with_song(per_song, star, "isrc", "title", "song_artist", "label_id")
    return with_label(with_artist(rows, star), star).select(
        "isrc", "title", "artist_name", "label_name", "year", "month", "total_plays", "total_revenue",
        "total_royalties", "platform_count", "avg_revenue_per_play")


def _country_base(star: Star, *ids: str) -> DataFrame:
    located = measures_of(star).where(F.col("geography_id").isNotNull())
    return rollup(located, "year", "month", "song_id", "geography_id", *ids)


def geographic_performance(star: Star) -> DataFrame:
    rows = with_song(_country_base(star), star, "song_artist", "label_id")
    grouped = rows.groupBy("geography_id", "year", "month").agg(
        *distinct(artist_count="song_artist", song_count="song_id", label_count="label_id"), *sums(),
        revenue_per_play("revenue_per_play"), royalty_rate("royalty_percentage"))
    return with_country(grouped, star, "country_code", "country_name", "region").drop("geography_id")


def label_platform_performance(star: Star) -> DataFrame:
    rows = with_platform(base(star), star, "platform_name", active=True)
    rows = with_label(with_song(rows, star, "song_artist", "label_id"), star)
    return rows.groupBy("label_name", "platform_name", "year", "month").agg(
        *distinct(artists="song_artist", songs="song_id"), *sums("plays", "revenue", "royalty"),
        revenue_per_play("revenue_per_play"), royalty_rate("royalty_percentage"))


def label_geography_share(star: Star) -> DataFrame:
    """Per label and country, with the country's share of the label's revenue in the period."""
    rows = with_country(_country_base(star), star, "region", "country_name")
    rows = with_label(with_song(rows, star, "song_artist", "label_id"), star)
    grouped = rows.groupBy("label_name", "region", "country_name", "year", "month").agg(
        *distinct(artists="song_artist", songs="song_id"), *sums("plays", "revenue", "royalties"),
        royalty_rate("royalty_percentage"))
    whole = F.sum("revenue").over(Window.partitionBy("label_name", "year", "month"))
    return grouped.withColumn("region_share", rate(F.col("revenue"), whole))


def artist_platform_label_rates(star: Star) -> DataFrame:
    rows = with_platform(base(star), star, "platform_name", active=True)
    rows = with_artist(with_label(with_song(rows, star, "song_artist", "label_id"), star), star)
    return rows.groupBy("label_name", "artist_name", "platform_name", "year", "month").agg(
        *distinct(songs="song_id"), *sums("plays", "revenue", "royalty"),
        revenue_per_play("revenue_per_play"), royalty_rate("royalty_percentage"))


def isrc_geo_platform_share(star: Star) -> DataFrame:
    """Per song, region and platform, with its share of the song's revenue in the period."""
    located = measures_of(star).where(F.col("geography_id").isNotNull())
    placed = with_platform(with_country(located, star, "region"), star, "platform_name", active=True)
    grouped = placed.groupBy("song_id", "region", "platform_name", "year", "month").agg(
        *sums("plays", "revenue", "royalties"), revenue_per_play("revenue_per_play"),
        royalty_rate("royalty_percentage"))
    whole = F.sum("revenue").over(Window.partitionBy("song_id", "year", "month"))
    shared = grouped.withColumn("platform_share", rate(F.col("revenue"), whole))
    rows = with_song(shared, star, "isrc", "title", "song_artist", "label_id")
    return with_label(with_artist(rows, star), star).select(
        "isrc", "title", "artist_name", "label_name", "region", "platform_name", "year", "month", "plays",
        "revenue", "royalties", "revenue_per_play", "royalty_percentage", "platform_share")


def platform_trends(star: Star, ordered: bool = True) -> DataFrame:
    rows = platform_analytics(star).withColumns({
        "royalty_percentage": rate("total_royalties", "total_revenue"),
        "revenue_per_play": per_play("total_revenue", "total_plays")})
    if not ordered:
        return rows
    return rows.orderBy(F.desc("year"), month_number("month").desc(), F.desc("total_revenue"),
                        "platform_name", "revenue_share_percentage")


def latest_platform_metrics(star: Star) -> DataFrame:
    """Platform trends of the latest period that has active-platform, released-song facts.

    The latest period is looked for on the ids alone: from the newest folder down where the folders are known,
    else over all periods.
    """
    ids = measures_of(star).select("year", "month", "song_id", "platform_id")
    shown = with_song(with_platform(ids, star, active=True), star)
    if star.periods is not None:
        latest = newest(shown, star.periods).select("year", "month").limit(1)
        found = latest.first()
        measures = narrowed(measures_of(star), year=found["year"], month=found["month"]) if found else measures_of(star).limit(0)
    else:
        last = shown.agg(F.max(period_index()).alias("period"))  # one row
        latest = last.select(year_in(F.col("period")).alias("year"), month_in(F.col("period")).alias("month"))
        measures = measures_of(star).join(F.broadcast(latest), ["year", "month"], "left_semi")
    return platform_trends(star.with_facts(star.facts, measures), ordered=False).drop("year", "month").orderBy(
        F.desc("total_revenue"), "platform_name", "revenue_share_percentage")


def artist_platform_rate(star: Star) -> DataFrame:
    """Per artist name and platform over all time."""
    facts = rollup(measures_of(star), "song_id", "platform_id")
    rows = with_platform(facts, star, "platform_name", active=True)
    rows = with_artist(with_song(rows, star, "song_artist"), star)
    return rows.groupBy("artist_name", "platform_name").agg(
        *distinct(songs="song_id"), *sums("plays", "revenue", "royalty"), royalty_rate("effective_rate"),
    ).orderBy(F.desc("revenue"), "artist_name", "platform_name")


def artist_song_summary(star: Star, artist_id: int | None = None) -> DataFrame:
    """Per song title, artist and label over all time, for one artist or for all."""
    facts = measures_of(star)
    if artist_id is not None:
        facts = only(facts, narrowed(star.songs, artist_id=artist_id), "song_id")
    songs = with_song(rollup(facts, "song_id", "platform_id"), star, "title", "song_artist", "label_id")
    rows = with_label(with_artist(songs, star), star)
    return rows.groupBy("title", "artist_name", "label_name").agg(
        *sums(), *distinct(platform_count="platform_id"), royalty_rate("royalty_percentage"),
    ).orderBy(F.desc("total_revenue"), "title", "artist_name", "label_name")
