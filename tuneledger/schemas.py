"""Table schemas and the fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(15, 6)
SHARE = T.DecimalType(5, 2)

# Month abbreviations as stored in the fact, in calendar order.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

# Song life cycle and row status of the staging table.
SONG_STATUSES = ("Released", "Draft", "Archived")
PENDING, PROCESSED, SKIPPED, FAILED = "PENDING", "PROCESSED", "SKIPPED", "FAILED"

# Messages written next to a row status.
MSG_DUPLICATE = "Record already exists for this month/isrc/country/service"
MSG_ISRC = "Invalid ISRC"
MSG_PLATFORM = "Invalid platform"
MSG_ARTIST = "Invalid artist ID"
MSG_SONG = "Song not released"

# Outcome messages of an import.
MSG_NO_DATA = "No valid data found in CSV file"
MSG_NOT_STAGED = "Failed to stage revenue data"
MSG_IMPORTED = "Revenue data imported successfully"
MSG_NOT_REFRESHED = "Data imported but some views failed to refresh"

# Fixed value: first year the reports accept.
FIRST_YEAR = 2020

# Fixed value: payment threshold given to artists created from a sheet.
DEFAULT_THRESHOLD = "100.00"

# Fixed value: e-mail shape, matched without regard to case.
EMAIL_PATTERN = r"(?i)^[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}$"

# Roles a user account may have.
USER_ROLES = ("SuperAdmin", "Admin", "User")

# Columns of the two sheets, by position.
REVENUE_SHEET = (
    "service", "month", "isrc", "product", "song_name", "artist", "album",
    "label", "file_name", "country", "total", "royality", "userid", "id",
)
PLATFORM_SHEET = ("platform_name", "revenue_share_percentage", "effective_from")

# Countries every geography dimension must know.
COUNTRY_NAMES = {
    "US": "United States", "CA": "Canada", "GB": "United Kingdom", "AU": "Australia",
    "IN": "India", "DE": "Germany", "FR": "France", "JP": "Japan", "NZ": "New Zealand",
    "SG": "Singapore", "ES": "Spain", "CH": "Switzerland", "FI": "Finland", "IE": "Ireland",
    "PT": "Portugal", "MX": "Mexico", "UA": "Ukraine", "MU": "Mauritius", "HU": "Hungary",
    "ZA": "South Africa", "AE": "United Arab Emirates",
}


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, nullable) for name, dtype, nullable in fields])


_INT, _STR, _DATE, _NTZ = T.IntegerType(), T.StringType(), T.DateType(), T.TimestampNTZType()

LABEL = _struct(("label_id", _INT, False), ("label_name", _STR, False))

ARTIST = _struct(
    ("artist_id", _INT, False), ("artist_name", _STR, False), ("payment_threshold", MONEY, True))

SONG = _struct(
    ("song_id", _INT, False), ("isrc", _STR, False), ("title", _STR, False),
    ("artist_id", _INT, False), ("label_id", _INT, False), ("status", _STR, True))

GEOGRAPHY = _struct(
    ("geography_id", _INT, False), ("country_code", _STR, False),
    ("country_name", _STR, False), ("region", _STR, False))

PLATFORM = _struct(
    ("platform_id", _INT, False), ("platform_name", _STR, False),
    ("revenue_share_percentage", SHARE, False), ("effective_from", _DATE, False),
    ("effective_to", _DATE, True), ("is_active", T.BooleanType(), True))

STAGING = _struct(
    ("id", _STR, False), ("service", _STR, False), ("month", _DATE, False), ("isrc", _STR, False),
    ("product", _STR, True), ("song_name", _STR, False), ("artist", _STR, False),
    ("album", _STR, True), ("label", _STR, False), ("file_name", _STR, True),
    ("country", _STR, False), ("total", MONEY, False), ("royalty", MONEY, False),
    ("userid", _INT, False), ("status", _STR, True), ("error_message", _STR, True),
    ("created_at", _NTZ, True))

# `revenue_id` carries the staging id: a natural key, so no global sequence is needed.
FACT = _struct(
    ("revenue_id", _STR, False), ("song_id", _INT, False), ("platform_id", _INT, False),
    ("geography_id", _INT, True), ("artist_id", _INT, False), ("total_plays", _INT, False),
    ("revenue_amount", MONEY, False), ("royalty_amount", MONEY, False), ("created_at", _NTZ, True),
    ("year", _INT, False), ("month", _STR, False))

# Declared text lengths, by table and column.
TEXT_LENGTHS = {
    "staging": {"service": 100, "isrc": 12, "product": 255, "song_name": 255, "artist": 255, "album": 255, "label": 255,
                "file_name": 255, "country": 2},
    "label": {"label_name": 100},
    "artist": {"artist_name": 255},
    "song": {"isrc": 12, "title": 255},
    "country": {"country_code": 2, "country_name": 100, "region": 50},
    "platform": {"platform_name": 100},
}

# Keys that are unique in the stored views.
VIEW_KEYS = {
    "mv_revenue_overview": ("year", "month"),
    "mv_artist_dashboard": ("revenue_id",),
    "mv_platform_analytics": ("platform_name", "year", "month"),
    "mv_artist_earnings": ("year", "month", "artist_id"),
    "mv_platform_revenue": ("year", "month", "platform_name"),
    "mv_artist_performance": ("year", "month", "song_id"),
    "mv_label_performance": ("year", "month", "label_id"),
    "mv_artist_platform_label": ("year", "month", "artist_id", "platform_name", "label_name"),
    "mv_isrc_geo_platform": ("year", "month", "isrc", "country_code", "platform_name"),
}
