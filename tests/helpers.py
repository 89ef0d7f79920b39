"""Hand-made tables and comparisons shared by the test modules; fixtures stay in conftest."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from tuneledger import schemas
from tuneledger.session import fresh_dir
from tuneledger.sources.warehouse import Star, Warehouse


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


class Tiny:
    """Small hand-made tables in the declared schemas."""

    def __init__(self, spark):
        self.spark = spark

    def frame(self, schema, rows):
        return self.spark.createDataFrame(rows, schema)

    def facts(self, rows):
        """(id, year, month, song, platform, country, artist, plays, revenue, royalty)"""
        return self.frame(schemas.FACT, [
            (i, s, p, g, a, n, Decimal(rev), Decimal(roy), dt.datetime(2025, 1, 31), y, m)
            for i, y, m, s, p, g, a, n, rev, roy in rows])

    def staging(self, rows):
        """(id, service, month, isrc, country, total, royalty, userid) and optionally a status"""
        return self.frame(schemas.STAGING, [
            (r[0], r[1], day(r[2]), r[3], None, "title", "artist", None, "label", None, r[4],
             Decimal(r[5]), Decimal(r[6]), r[7], r[8] if len(r) > 8 else "PENDING", None, dt.datetime(2025, 2, 1))
            for r in rows])

    def platforms(self, rows):
        return self.frame(schemas.PLATFORM, [
            (i, name, Decimal(share), day(start), day(end) if end else None, active)
            for i, name, share, start, end, active in rows])

    def star(self, facts=(), platforms=None, songs=None, artists=None, labels=None, countries=None) -> Star:
        """The three-song sample: two artists, two labels, three platforms, two countries."""
        return Star(
            facts=self.facts(facts),
            songs=self.frame(schemas.SONG, songs or [
                (1, "USUM71307667", "Summer Hits", 1, 1, "Released"),
                (2, "GBAYE0601498", "Winter Blues", 1, 1, "Released"),
                (3, "USRC17607839", "Rock Anthem", 2, 2, "Released"),
                (4, "USRC17600004", "Hidden Demo", 2, 2, "Draft")]),
            artists=self.frame(schemas.ARTIST, artists or [
                (1, "John Smith", Decimal(100)), (2, "Jane Doe", Decimal(100)), (3, "Rock Band", Decimal(100))]),
            labels=self.frame(schemas.LABEL, labels or [
                (1, "Sony Music"), (2, "Universal Music"), (3, "Warner Music")]),
            platforms=self.platforms(platforms or [
                (1, "Spotify", "70.00", "2025-01-01", None, True),
                (2, "Apple Music", "70.00", "2025-01-01", None, True),
                (3, "YouTube Music", "55.00", "2025-01-01", None, True)]),
            countries=self.frame(schemas.GEOGRAPHY, countries or [
                (1, "CA", "Canada", "North America"), (2, "DE", "Germany", "Europe")]))

    def sample(self) -> Star:
        return self.star(facts=[
            ("a", 2025, "Jan", 1, 1, None, 1, 10000, "500.00", "350.00"),
            ("b", 2025, "Jan", 2, 2, None, 1, 8000, "400.00", "280.00"),
            ("c", 2025, "Jan", 3, 1, None, 2, 15000, "750.00", "525.00")])

    def warehouse(self, star: Star | None = None) -> Warehouse:
        star = star or self.star()
        warehouse = Warehouse(self.spark, fresh_dir(self.spark, "tiny"))
        for name, df in (("label", star.labels), ("artist", star.artists), ("song", star.songs),
                         ("dim_geography", star.countries), ("platform_config", star.platforms)):
            warehouse.write(name, df)
        return warehouse

    def text(self, lines: list[str]) -> str:
        """Path of a folder with one text file of these lines."""
        path = fresh_dir(self.spark, "text")
        self.spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)
        return path


def rows_of(df, *columns) -> list[tuple]:
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())
