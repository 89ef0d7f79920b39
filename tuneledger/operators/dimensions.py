"""Dimension upkeep from sheets: new artists and songs, countries, platform configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tuneledger.schemas import COUNTRY_NAMES, DEFAULT_THRESHOLD
from tuneledger.sources.warehouse import Star


def numbered_after(df: DataFrame, existing: DataFrame, column: str, *order: str) -> DataFrame:
    """Adds consecutive ids that follow the largest existing one, in the given order.

    Only suited to small sets of new rows such as configurations: the numbering of one
    sequence ends in a single task.
    """
    last = existing.agg(F.coalesce(F.max(column), F.lit(0)).alias("last"))
    return df.withColumn(
        column, (F.row_number().over(Window.orderBy(*order)) + last.scalar()).cast("int"))


def sheet_artists(sheet: DataFrame) -> DataFrame:
    """Distinct artists of a sheet with trimmed names; a malformed id is an error."""
    return sheet.select(
        F.col("userid").cast("int").alias("artist_id"), F.trim("artist").alias("artist_name"),
        F.lit(DEFAULT_THRESHOLD).cast("decimal(15,6)").alias("payment_threshold")).distinct()


def sheet_songs(sheet: DataFrame) -> DataFrame:
    return sheet.select(
        "isrc", F.trim("song_name").alias("title"), F.col("userid").cast("int").alias("artist_id"),
        F.trim("label").alias("label_name")).distinct()


def new_artists(sheet: DataFrame, star: Star) -> DataFrame:
    """Artists of the sheet that the dimension lacks; of several names the smallest is taken."""
    missing = sheet_artists(sheet).join(star.artists.select("artist_id"), "artist_id", "left_anti")
    return missing.groupBy("artist_id").agg(
        F.min("artist_name").alias("artist_name"), F.first("payment_threshold").alias("payment_threshold"))


def new_songs(sheet: DataFrame, star: Star) -> DataFrame:
    """Songs with an unknown code and a known label; one row per code, status Released.

    Of several spellings of one code the smallest (title, artist, label) is taken. A label
    name that two labels share resolves to the smaller id.
    """
    missing = sheet_songs(sheet).join(star.songs.select("isrc"), "isrc", "left_anti")
    labels = star.labels.groupBy("label_name").agg(F.min("label_id").alias("label_id"))
    known = missing.join(labels, "label_name")
    chosen = known.groupBy("isrc").agg(F.min(F.struct("title", "artist_id", "label_id")).alias("song"))
    return chosen.select("isrc", "song.title", "song.artist_id", "song.label_id", F.lit("Released").alias("status"))


def with_song_ids(songs: DataFrame, existing: DataFrame) -> DataFrame:
    """Ids for new songs, unique beyond the largest existing id, without one global sequence.

    The codes are spread over ranges; each range numbers its own rows and starts where the
    counts of the ranges before it end.
    """
    ranges = 4096
    bucket = F.pmod(F.xxhash64("isrc"), F.lit(ranges))
    spread = songs.withColumn("bucket", bucket)
    counts = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(
        "bucket", F.coalesce(F.sum("n").over(
            Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    last = existing.agg(F.coalesce(F.max("song_id"), F.lit(0)).alias("last"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("isrc"))
    return spread.withColumn("place", place).join(before, "bucket").withColumn(
        "song_id", (F.col("place") + F.col("offset") + last.scalar()).cast("int")).drop("bucket", "place", "offset")


def sync_counts(artists: DataFrame, songs: DataFrame) -> DataFrame:
    """Row counts of the two dimensions."""
    parts = [df.agg(F.count(F.lit(1)).alias("count")).select(F.lit(name).alias("type"), "count")
             for name, df in (("Artists", artists), ("Songs", songs))]
    return parts[0].unionByName(parts[1])


def missing_countries(countries: DataFrame) -> DataFrame:
    """Countries every dimension must know and this one lacks; their region is not known."""
    names = F.create_map(*[F.lit(text) for pair in COUNTRY_NAMES.items() for text in pair])
    one = countries.sparkSession.range(1)
    wanted = one.select(F.explode(names).alias("country_code", "country_name"))
    return wanted.join(countries.select("country_code"), "country_code", "left_anti").distinct().withColumn(
        "region", F.lit("Unknown"))


def platform_rows(sheet: DataFrame, existing: DataFrame) -> DataFrame:
    """Configurations of a platform sheet as active rows with new ids; names may repeat, a share out of range is null."""
    parsed = sheet.select(
        "platform_name", F.col("revenue_share_percentage").try_cast("decimal(5,2)").alias("revenue_share_percentage"),
        F.try_to_date("effective_from", "yyyy-MM-dd").alias("effective_from"),
        F.lit(None).cast("date").alias("effective_to"), F.lit(True).alias("is_active"))
    return numbered_after(parsed, existing, "platform_id", "platform_name", "effective_from", "revenue_share_percentage")
