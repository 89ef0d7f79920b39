"""Staging rows to facts: duplicate check, resolution, status and reason, append or upsert.

A staging row is resolved by look-ups that never multiply it (codes, names and ids are
unique keys, platform checks are existence joins), so its status is one value even when
it later yields several facts through overlapping platform configurations. A code that
holds a large part of all rows is split by adaptive skew-join handling: every join here
keeps the staging rows on its left side, the side Spark may split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tuneledger.functions.columns import (
    grossed_up, month_date, month_of, narrowed, period_token, royalty_of, year_of,
)
from tuneledger.schemas import (
    FAILED, MSG_ARTIST, MSG_DUPLICATE, MSG_ISRC, MSG_PLATFORM, MSG_SONG, PENDING, PROCESSED, SKIPPED,
)
from tuneledger.sources.warehouse import Star

UPSERT_KEY = ("year", "month", "song_id", "platform_id")
_MEASURES = ("total_plays", "revenue_amount", "royalty_amount")


def with_period(staging: DataFrame, date: str = "month") -> DataFrame:
    """Adds the fact's year and month text next to the staging date."""
    return staging.withColumns({"period_year": year_of(date), "period_month": month_of(date)})


def month_text_to_period(df: DataFrame, column: str) -> DataFrame:
    """Year and month text from a month given as text."""
    date = month_date(column)
    return df.withColumns({"year": year_of(date), "month": month_of(date), "period": period_token(column)})


def existing_keys(star: Star) -> DataFrame:
    """Distinct (code, platform name, period) already present in the fact."""
    named = star.facts.select("year", "month", "song_id", "platform_id").join(
        star.platforms.select("platform_id", "platform_name"), "platform_id")
    keys = named.select("year", "month", "song_id", "platform_name").distinct()
    return keys.join(star.songs.select("song_id", "isrc"), "song_id").select(
        F.col("isrc").alias("known_isrc"), F.col("platform_name").alias("known_service"),
        F.col("year").alias("known_year"), F.col("month").alias("known_month"))


def _flagged(df: DataFrame, keys: DataFrame, on: dict[str, str], flag: str) -> DataFrame:
    """Left join to unique keys that adds one boolean and no rows."""
    marked = keys.withColumn(flag, F.lit(True))
    condition = reduce(lambda a, b: a & b, [F.col(left) == F.col(right) for left, right in on.items()])
    return df.join(marked, condition, "left").drop(*on.values()).withColumn(flag, F.coalesce(flag, F.lit(False)))


def with_duplicates(staging: DataFrame, star: Star) -> DataFrame:
    """Adds ``is_duplicate``: the fact already holds this code, platform and period.

    Country is not compared, and rows of one batch never count as duplicates of each other.
    The import job hands in a star that holds only the facts of the batch's periods.
    """
    on = {"isrc": "known_isrc", "service": "known_service",
          "period_year": "known_year", "period_month": "known_month"}
    return _flagged(with_period(staging), existing_keys(star), on, "is_duplicate")


def mark_skipped(staging: DataFrame, star: Star) -> DataFrame:
    """Pending rows that repeat a loaded fact become SKIPPED."""
    skip = (F.col("status") == PENDING) & F.col("is_duplicate")
    return with_duplicates(staging, star).withColumns({
        "status": F.when(skip, SKIPPED).otherwise(F.col("status")),
        "error_message": F.when(skip, MSG_DUPLICATE).otherwise(F.col("error_message")),
    }).drop("is_duplicate", "period_year", "period_month")


def known_artists(staging: DataFrame, star: Star) -> DataFrame:
    """Only rows whose artist exists."""
    return staging.join(star.artists.select(F.col("artist_id").alias("userid")), "userid", "left_semi")


def usable_platforms(star: Star) -> DataFrame:
    """Active configurations; one with share zero cannot be grossed up and is not usable."""
    return star.platforms.where("is_active AND revenue_share_percentage > 0")


def in_window(date: str = "month"):
    day = F.col(date)
    return (day >= F.col("effective_from")) & (F.col("effective_to").isNull() | (day <= F.col("effective_to")))


def effective_platforms(staging: DataFrame, star: Star, zero_share: bool = False) -> DataFrame:
    """Interval join: platform name, and the date inside the configuration's window.

    The equi key is the name; the window is a residual condition. Overlapping windows
    give one row each. With ``zero_share`` active configurations of share zero match, too:
    no revenue can be told from a royalty there, but the royalty of a revenue is zero.
    """
    platforms = star.platforms.where("is_active AND revenue_share_percentage >= 0") if zero_share else usable_platforms(star)
    return staging.join(platforms, (F.col("service") == F.col("platform_name")) & in_window())


def with_geography(df: DataFrame, star: Star) -> DataFrame:
    """Left join on the country code: unknown countries keep a null id."""
    codes = star.countries.select("geography_id", F.col("country_code").alias("country"))
    return df.join(codes, "country", "left")


def _any_config(platforms: DataFrame, *more: Column) -> Column:
    """Existence join on the platform name; platform configurations are few and get broadcast."""
    named = F.col("platform_name") == F.col("service").outer()
    return platforms.where(reduce(lambda a, b: a & b, more, named)).exists()


def resolve(staging: DataFrame, star: Star) -> DataFrame:
    """Adds song id and status plus existence flags; one row per staging row."""
    day = F.col("month").outer()
    covers = (F.col("effective_from") <= day) & (F.col("effective_to").isNull() | (F.col("effective_to") >= day))
    active = star.platforms.where("is_active")
    songs = star.songs.select("isrc", "song_id", F.col("status").alias("song_status"))
    artists = star.artists.select(F.col("artist_id").alias("known_artist"))
    found = _flagged(staging.join(songs, "isrc", "left"), artists, {"userid": "known_artist"}, "artist_known")
    return found.withColumns({
        "platform_known": _any_config(active),
        "platform_open": _any_config(active.where("revenue_share_percentage > 0"), covers),
        "zero_share_open": _any_config(active.where("revenue_share_percentage = 0"), covers),
    })


def _reason() -> Column:
    """First fault of a row that did not load. A date outside every window counts as the last one."""
    return (
        F.when(F.col("song_id").isNull(), MSG_ISRC)
        .when(~F.col("platform_known") | (F.col("zero_share_open") & ~F.col("platform_open")), MSG_PLATFORM)
        .when(~F.col("artist_known"), MSG_ARTIST)
        .otherwise(MSG_SONG)
    )


def classify(staging: DataFrame, star: Star, skip_existing: bool = True, window_matters: bool = True) -> DataFrame:
    """Status and reason of every pending row in one pass; other rows keep theirs.

    Order: repeats of loaded facts are SKIPPED, loadable rows PROCESSED, the rest FAILED.
    With ``window_matters=False`` (the upsert form) a row outside its platform's dates
    still counts as PROCESSED although it yields no fact.
    """
    rows = with_duplicates(staging, star) if skip_existing else with_period(staging).withColumn("is_duplicate", F.lit(False))
    rows = resolve(rows, star)
    open_platform = F.col("platform_open") if window_matters else F.col("platform_known")
    loadable = F.coalesce(F.col("song_status") == "Released", F.lit(False)) & open_platform & F.col("artist_known")
    pending = F.col("status") == PENDING
    status = (
        F.when(~pending, F.col("status")).when(F.col("is_duplicate"), SKIPPED)
        .when(loadable, PROCESSED).otherwise(FAILED)
    )
    message = (
        F.when(~pending, F.col("error_message")).when(F.col("is_duplicate"), MSG_DUPLICATE)
        .when(~loadable, _reason())
    )
    # Said in its parts, so that a filter on it reaches below the joins and rows that do not load move no further.
    fresh = pending & ~F.col("is_duplicate") & loadable
    return rows.withColumns({"status": status, "error_message": message, "newly_loaded": fresh}) \
        .drop("is_duplicate", "artist_known", "platform_known", "platform_open", "zero_share_open", "song_status")


def facts_of(classified: DataFrame, star: Star, forward: bool = False) -> DataFrame:
    """Fact rows of the newly loaded staging rows.

    The amount on the sheet is a royalty that is grossed up by the platform share, or,
    with ``forward=True``, a revenue from which the royalty is taken. The artist is the
    one named on the sheet.
    """
    loaded = classified.where("newly_loaded")
    matched = with_geography(effective_platforms(loaded, star, zero_share=forward), star)
    share, amount = F.col("revenue_share_percentage"), F.col("royalty")
    return matched.select(
        F.col("id").alias("revenue_id"), "song_id", "platform_id", "geography_id",
        F.col("userid").alias("artist_id"), F.round("total").cast("int").alias("total_plays"),
        (amount if forward else grossed_up(amount, share)).alias("revenue_amount"),
        (royalty_of(amount, share) if forward else amount).alias("royalty_amount"),
        "created_at", F.col("period_year").alias("year"), F.col("period_month").alias("month"))


def load(staging: DataFrame, star: Star) -> DataFrame:
    """Facts a load on top of ``star`` would append."""
    return facts_of(classify(staging, star), star)


def status_counts(staging: DataFrame) -> DataFrame:
    return staging.groupBy("status").agg(F.count(F.lit(1)).alias("count"))


def song_details(star: Star, isrc: str | None = None) -> DataFrame:
    """Released songs with artist and label; one code, or all of them."""
    songs = narrowed(star.songs.where(F.col("status") == "Released"), isrc=isrc)
    return songs.join(star.artists, "artist_id").join(star.labels, "label_id").select(
        "isrc", "song_id", "artist_id", "label_id", "title", "artist_name", "label_name")


def load_by_details(staging: DataFrame, star: Star) -> tuple[DataFrame, DataFrame]:
    """The variant that takes the artist from the song and marks every pending row PROCESSED.

    Returns the fact rows (royalty taken from the sheet's amount) and the marked staging rows.
    """
    details = song_details(star).select("isrc", "song_id", F.col("artist_id").alias("song_artist"))
    pending = with_period(staging.where(F.col("status") == PENDING))
    matched = effective_platforms(pending.join(details, "isrc"), star, zero_share=True)
    facts = matched.select(
        F.col("id").alias("revenue_id"), F.col("period_year").alias("year"), F.col("period_month").alias("month"),
        "song_id", "platform_id", F.col("song_artist").alias("artist_id"),
        F.round("total").cast("int").alias("total_plays"), F.col("royalty").alias("revenue_amount"),
        royalty_of(F.col("royalty"), F.col("revenue_share_percentage")).alias("royalty_amount"))
    marked = staging.withColumn("status", F.when(F.col("status") == PENDING, PROCESSED).otherwise(F.col("status")))
    return facts, marked


def one_row_per_key(
        facts: DataFrame, key: tuple[str, ...] = UPSERT_KEY, kept: tuple[str, ...] = ("artist_id",)) -> DataFrame:
    """Facts added up to one row per key; of every kept column the smallest value stands for the key."""
    return facts.groupBy(*key).agg(
        *[F.min(name).alias(name) for name in kept], F.sum("total_plays").cast("int").alias("total_plays"),
        *[F.sum(name).cast("decimal(15,6)").alias(name) for name in _MEASURES[1:]])


def upsert(
        existing: DataFrame, incoming: DataFrame, key: tuple[str, ...] = UPSERT_KEY,
        kept: tuple[str, ...] = ("artist_id",)) -> DataFrame:
    """Existing rows with the incoming measures put over them, plus the new keys.

    Both sides hold one row per complete key, so the join multiplies nothing and no key is
    hot in it. A matched row retains its kept columns. A null inside a key equals nothing:
    such rows bypass the join and are added as they are.
    """
    columns = [*key, *kept, *_MEASURES]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.where(_complete(key)).select(*key, F.struct(*kept, *_MEASURES).alias(name))

    merged = side(existing, "old").join(side(incoming, "new"), list(key), "full_outer")
    first = [F.when(F.col("old").isNotNull(), F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")).alias(c) for c in kept]
    last = [F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in _MEASURES]
    loose = existing.where(~_complete(key)).select(*columns).unionByName(
        incoming.where(~_complete(key)).select(*columns))
    return merged.select(*key, *first, *last).unionByName(loose)


def replaced(existing: DataFrame, incoming: DataFrame, key: tuple[str, ...] = (*UPSERT_KEY, "geography_id")) -> DataFrame:
    """Existing facts with the incoming ones in the place of those that share their key; nulls in a key are equal.

    Facts whose key does not come in stay as they are, row by row. Incoming facts of a key are added up; the row
    takes id, artist and date of the key's existing fact with the least id, or of the incoming one if the key is new.
    """
    identity = ("revenue_id", "artist_id", "created_at")

    def least(df: DataFrame, name: str, *sums: Column) -> DataFrame:
        return df.groupBy(*key).agg(F.min(F.struct(*identity)).alias(name), *sums)

    def same(right: dict[str, str]) -> Column:
        return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(other)) for c, other in right.items()])

    new = least(incoming, "new", F.sum("total_plays").cast("int").alias("total_plays"),
                *[F.sum(name).cast("decimal(15,6)").alias(name) for name in _MEASURES[1:]])
    others = {c: f"_{c}" for c in key}
    keys = new.select(*[F.col(c).alias(other) for c, other in others.items()])
    untouched = existing.join(keys, same(others), "left_anti")
    old = least(existing.join(keys, same(others), "left_semi"), "old").withColumnsRenamed(others)
    put = new.join(old, same(others), "left").withColumn("kept", F.coalesce("old", "new"))
    columns = (*key, *identity, *_MEASURES)
    return untouched.select(*columns).unionByName(
        put.select(*key, *[F.col(f"kept.{c}").alias(c) for c in identity], *_MEASURES))


def _complete(key: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])


def upsert_source(facts: DataFrame, key: tuple[str, ...] = UPSERT_KEY) -> DataFrame:
    """Incoming facts reduced for an upsert; rows with a null in the key stay as they are."""
    loose = facts.where(~_complete(key)).select(*key, "artist_id", *_MEASURES)
    return one_row_per_key(facts.where(_complete(key)), key).unionByName(loose)
