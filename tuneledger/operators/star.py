"""Star-join building blocks.

Every report follows one plan: add up the fact on ids first (map-side combine makes a
song or month with a third of all rows harmless), look up dimension columns on the much
smaller result, then form the report groups. Dimension sides carry no broadcast hint:
Spark broadcasts a side only when its size lies below ``autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tuneledger.functions.columns import month_number, per_play, rate, total
from tuneledger.sources.warehouse import Star

def as_measures(facts: DataFrame) -> DataFrame:
    """Fact rows with their measures in additive form; ``artist_id`` becomes ``sheet_artist``."""
    pct = F.col("royalty_amount") * 100 / F.nullif(F.col("revenue_amount"), F.lit(0))
    return facts.select(
        "year", "month", "song_id", "platform_id", "geography_id", F.col("artist_id").alias("sheet_artist"),
        F.col("total_plays").cast("bigint").alias("plays"), F.col("revenue_amount").alias("revenue"),
        F.col("royalty_amount").alias("royalty"), F.lit(1).cast("bigint").alias("fact_rows"),
        pct.alias("pct_total"), pct.isNotNull().cast("bigint").alias("pct_rows"),
        F.col("created_at").alias("first_created"), F.col("created_at").alias("last_created"))


def only(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Facts of the dimension's ids: a filter on a name, put before the sum and its shuffle."""
    return facts.join(dimension.select(key), key, "left_semi")


def of_artist(star: Star, artist_id: int) -> Star:
    """The star with only the facts of one artist's songs, left out before any sum."""
    songs = star.songs.where(F.col("artist_id") == artist_id)
    summed = None if star.summed is None else only(star.summed, songs, "song_id")
    return star.with_facts(only(star.facts, songs, "song_id"), summed)


def measures_of(star: Star) -> DataFrame:
    """Measures of the star's fact, from the shared sums where these are present."""
    return as_measures(star.facts) if star.summed is None else star.summed


def newest(rows: DataFrame, periods: tuple[tuple[int, str], ...]) -> DataFrame:
    """Rows of the latest period that has any, found from the newest folder down.

    ``periods`` are the folders in calendar order. Windows of 1, 2, 4, ... months are tried until one has rows, so
    the folders of a current report are few and an old one costs a handful of jobs, each on folders not read before.
    """
    end, width = len(periods), 1
    while end > 0:
        tried = periods[max(0, end - width):end]
        inside = rows.where(F.struct("year", "month").isin(*[F.struct(F.lit(y), F.lit(m)) for y, m in tried]) & _folders(tried))
        found = inside.agg(F.max(F.struct("year", month_number("month").alias("number"), "month")).alias("last")).first()["last"]
        if found is not None:
            return rows.where((F.col("year") == found["year"]) & (F.col("month") == found["month"]))
        end, width = end - len(tried), width * 2
    return rows.where("false")


def _folders(periods: tuple[tuple[int, str], ...]) -> Column:
    """A plain condition on the folder columns, which prunes the listing."""
    return F.col("year").isin(sorted({y for y, _ in periods})) & F.col("month").isin(sorted({m for _, m in periods}))


def rollup(measures: DataFrame, *keys: str) -> DataFrame:
    """Measures added up over ``keys``; can be applied again to its own result."""
    return measures.groupBy(*keys).agg(
        F.sum("plays").alias("plays"), total("revenue").alias("revenue"), total("royalty").alias("royalty"),
        F.sum("fact_rows").alias("fact_rows"), F.sum("pct_total").alias("pct_total"),
        F.sum("pct_rows").alias("pct_rows"), F.min("first_created").alias("first_created"),
        F.max("last_created").alias("last_created"))


def with_song(df: DataFrame, star: Star, *columns: str, released: bool = True) -> DataFrame:
    """Inner join to the song; its artist appears as ``song_artist``."""
    songs = star.songs.withColumnRenamed("artist_id", "song_artist")
    if released:
        songs = songs.where(F.col("status") == "Released")
    return df.join(songs.select("song_id", *columns), "song_id")


def with_platform(df: DataFrame, star: Star, *columns: str, active: bool = False) -> DataFrame:
    platforms = star.platforms.where("is_active") if active else star.platforms
    return df.join(platforms.select("platform_id", *columns), "platform_id")


def with_label(df: DataFrame, star: Star) -> DataFrame:
    return df.join(star.labels.select("label_id", "label_name"), "label_id")


def with_artist(df: DataFrame, star: Star, key: str = "song_artist") -> DataFrame:
    """Inner join to the artist by the song's or the sheet's artist; adds ``artist_id``, ``artist_name``."""
    artists = star.artists.select("artist_id", "artist_name")
    return df.join(artists, F.col(key) == artists["artist_id"])


def with_country(df: DataFrame, star: Star, *columns: str) -> DataFrame:
    """Inner join to the country: facts of an unknown country drop out."""
    return df.join(star.countries.select("geography_id", *columns), "geography_id")


def sums(plays: str = "total_plays", revenue: str = "total_revenue", royalty: str | None = "total_royalties") -> list[Column]:
    found = [F.sum("plays").alias(plays), total("revenue").alias(revenue)]
    return found + [total("royalty").alias(royalty)] if royalty else found


def created_range() -> list[Column]:
    return [F.min("first_created").alias("earliest_record"), F.max("last_created").alias("latest_record")]


def distinct(**columns: str) -> list[Column]:
    return [F.countDistinct(column).alias(name) for name, column in columns.items()]


def royalty_rate(name: str) -> Column:
    return rate(F.sum("royalty"), F.sum("revenue")).alias(name)


def revenue_per_play(name: str) -> Column:
    return per_play(F.sum("revenue"), F.sum("plays")).alias(name)

