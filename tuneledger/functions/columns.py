"""Column expressions: periods, ratios, optional filters, argument checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from tuneledger.schemas import FIRST_YEAR, MONTHS

# Sums of decimal(15,6) money are held as decimal(25,6): wide enough for any total,
# narrow enough that a later ratio keeps nine or more exact decimals.
TOTAL = "decimal(25,6)"


def total(column: str | Column) -> Column:
    return F.sum(column).cast(TOTAL)


def rate(part: Column | str, whole: Column | str) -> Column:
    """Percentage with two decimals; null when the whole is zero."""
    part, whole = (F.col(c) if isinstance(c, str) else c for c in (part, whole))
    return F.round(part.cast(TOTAL) * F.lit(100) / F.nullif(whole.cast(TOTAL), F.lit(0)), 2)


def per_play(revenue: Column | str, plays: Column | str) -> Column:
    """Revenue per play with six decimals; null when there are no plays."""
    revenue, plays = (F.col(c) if isinstance(c, str) else c for c in (revenue, plays))
    return F.round(revenue.cast(TOTAL) / F.nullif(plays.cast("decimal(20,0)"), F.lit(0)), 6)


def growth(now: Column, before: Column) -> Column:
    """Percentage change with two decimals; null without a non-zero earlier value."""
    now, before = now.cast(TOTAL), before.cast(TOTAL)
    change = (now - before).cast(TOTAL)
    return F.round(change * F.lit(100) / F.nullif(before, F.lit(0)), 2)


def month_number(month: Column | str) -> Column:
    lookup = F.create_map(*[F.lit(v) for i, name in enumerate(MONTHS, 1) for v in (name, i)])
    return F.element_at(lookup, month if isinstance(month, Column) else F.col(month))


def period_index(year: str = "year", month: str = "month") -> Column:
    """Consecutive number of a calendar month, so that the previous month is one less."""
    return F.col(year) * 12 + month_number(month)


def year_in(period: Column) -> Column:
    """Year of a period number made by :func:`period_index`."""
    return F.floor((period - 1) / 12).cast("int")


def month_in(period: Column) -> Column:
    """Month text of a period number made by :func:`period_index`."""
    return F.element_at(F.array(*[F.lit(name) for name in MONTHS]), ((period - 1) % 12 + 1).cast("int"))


def year_of(date: Column | str) -> Column:
    return F.year(date)


def month_of(date: Column | str) -> Column:
    return F.date_format(date, "MMM")


def month_date(token: Column | str) -> Column:
    """Sheet month text to a date: ``2023-04-01``, ``2023-04`` or ``Apr/23``; null if neither."""
    text = F.trim(F.col(token) if isinstance(token, str) else token)
    # The notations differ in length, so each value meets one parser.
    return (F.when(F.length(text) == 10, F.try_to_date(text, "yyyy-MM-dd"))
            .when(F.length(text) == 7, F.try_to_date(text, "yyyy-MM")).otherwise(F.try_to_date(text, "MMM/yy")))


def period_token(token: Column | str) -> Column:
    """``Apr/23`` to ``2023-04``."""
    return F.date_format(month_date(token), "yyyy-MM")


def grossed_up(royalty: Column, share: Column) -> Column:
    """Revenue behind a royalty at a share in percent; null at share zero."""
    return F.try_divide(royalty * F.lit(100), F.nullif(share, F.lit(0))).cast("decimal(15,6)")


def royalty_of(revenue: Column, share: Column) -> Column:
    """Royalty due on a revenue at a share in percent."""
    return (revenue * share / F.lit(100)).cast("decimal(15,6)")


def narrowed(df: DataFrame, **equals) -> DataFrame:
    """Equality filters for the arguments that were given; ``None`` adds no predicate at all."""
    for name, value in equals.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def check_period(year: int | None = None, month: str | None = None, today: dt.date | None = None) -> None:
    if month is not None and month not in MONTHS:
        raise ValueError(f"month must be one of {', '.join(MONTHS)}: {month!r}")
    if year is not None:
        last = (today or dt.date.today()).year + 1
        if not FIRST_YEAR <= year <= last:
            raise ValueError(f"year must lie in {FIRST_YEAR}..{last}: {year}")


def check_artist(artist_id: int) -> None:
    if artist_id <= 0:
        raise ValueError(f"artist_id must be positive: {artist_id}")
