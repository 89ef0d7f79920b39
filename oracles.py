"""SQL counterparts of the registered queries, for DuckDB on the supplied tables.

Money is carried as whole millionths, so that sums are exact and ratios are rounded half
up by integer division. Every statement starts from the same derivation of the star schema.
"""

from __future__ import annotations

import datetime as dt

MONTHS = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"

# The platform configuration; shares in hundredths of a percent.
PLATFORM_VALUES = """
    (1, 'AUTOMOBILE', 7000, DATE '2020-01-01', NULL, true),
    (2, 'BUILDING', 7000, DATE '2020-01-01', DATE '2022-12-31', true),
    (3, 'BUILDING', 6500, DATE '2023-01-01', NULL, true),
    (4, 'FURNITURE', 5500, DATE '2020-01-01', NULL, true),
    (5, 'HOUSEHOLD', 6000, DATE '2020-01-01', NULL, false),
    (6, 'MACHINERY', 5250, DATE '2021-01-01', NULL, true),
    (7, 'PODCAST', 5000, DATE '2020-01-01', NULL, true)"""

# Countries every geography dimension must know.
COUNTRY_VALUES = """
    ('US', 'United States'), ('CA', 'Canada'), ('GB', 'United Kingdom'), ('AU', 'Australia'),
    ('IN', 'India'), ('DE', 'Germany'), ('FR', 'France'), ('JP', 'Japan'), ('NZ', 'New Zealand'),
    ('SG', 'Singapore'), ('ES', 'Spain'), ('CH', 'Switzerland'), ('FI', 'Finland'), ('IE', 'Ireland'),
    ('PT', 'Portugal'), ('MX', 'Mexico'), ('UA', 'Ukraine'), ('MU', 'Mauritius'), ('HU', 'Hungary'),
    ('ZA', 'South Africa'), ('AE', 'United Arab Emirates')"""

STAR = f"""
label AS (
  SELECT DISTINCT CAST(substr(p_brand, 7) AS INTEGER) AS label_id, p_brand AS label_name FROM part),
artist AS (
  SELECT CAST(s_suppkey AS INTEGER) AS artist_id, s_name AS artist_name,
         CASE WHEN s_suppkey % 2 = 0 THEN 1000000 ELSE 1500000 END AS threshold FROM supplier),
song AS (
  SELECT CAST(p_partkey AS INTEGER) AS song_id, 'INK78' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS isrc,
         p_name AS title, CAST(p_partkey // 20 AS INTEGER) AS song_artist,
         CAST(substr(p_brand, 7) AS INTEGER) AS song_label,
         CASE p_type WHEN 'PROMO' THEN 'Draft' WHEN 'LARGE' THEN 'Archived' ELSE 'Released' END AS song_status
  FROM part),
geo AS (
  SELECT n_nationkey + 1 AS geography_id, chr(65 + n_nationkey // 5) || chr(65 + n_nationkey % 5) AS country_code,
         n_name AS country_name, r_name AS region
  FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 22),
platform(platform_id, platform_name, share_c, first_day, last_day, active) AS (VALUES {PLATFORM_VALUES}),
stg AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS id,
         c_mktsegment AS service,
         CAST(date_trunc('month', l_shipdate) + INTERVAL 25 YEAR AS DATE) AS day,
         CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN 'BAD' ELSE 'INK' END || '78'
           || lpad(CAST(l_partkey AS VARCHAR), 7, '0') AS isrc,
         p_name, s_name, p_brand, l_linenumber, l_returnflag,
         chr(65 + c_nationkey // 5) || chr(65 + c_nationkey % 5) AS country,
         CAST(round(l_quantity * 1000000) AS BIGINT) + CASE WHEN l_linestatus = 'F' THEN 500000 ELSE 0 END AS total_u,
         CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) * 100 AS royalty_u,
         CAST(l_suppkey + CASE WHEN l_linenumber = 6 AND l_returnflag = 'A' THEN 1000000 ELSE 0 END AS INTEGER) AS userid,
         l_shipdate + INTERVAL 25 YEAR AS created_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
effective AS (
  SELECT stg.*, platform_id, share_c,
         CAST((2 * royalty_u * 10000 + share_c) // (2 * share_c) AS BIGINT) AS gross_u,
         CAST((2 * royalty_u * share_c + 10000) // 20000 AS BIGINT) AS net_u
  FROM stg JOIN platform ON service = platform_name AND active AND day >= first_day
       AND (last_day IS NULL OR day <= last_day)),
fact AS (
  SELECT id, CAST(year(day) AS INTEGER) AS year, strftime(day, '%b') AS month, song_id, platform_id, geography_id,
         userid AS sheet_artist, CAST((total_u + 500000) // 1000000 AS INTEGER) AS plays,
         gross_u AS revenue, royalty_u AS royalty, net_u, created_at, service, isrc AS fact_isrc
  FROM effective JOIN song USING (isrc) LEFT JOIN geo ON country = country_code
  WHERE song_status = 'Released' AND userid IN (SELECT artist_id FROM artist)),
wide AS (
  SELECT fact.*, isrc, title, song_artist, song_label, song_status, label_name, a.artist_name,
         b.artist_name AS sheet_artist_name, platform_name, share_c, active,
         country_code, country_name, region
  FROM fact JOIN song USING (song_id) JOIN label ON song_label = label_id
  JOIN artist a ON song_artist = a.artist_id JOIN artist b ON sheet_artist = b.artist_id
  JOIN platform USING (platform_id) LEFT JOIN geo USING (geography_id)),
released AS (SELECT * FROM wide WHERE song_status = 'Released')"""

SHEET = """,
sheet AS (
  SELECT *, l_linenumber = 5 AND l_returnflag = 'N' AS bad_total, l_linenumber = 4 AND l_returnflag = 'R' AS short,
         CASE WHEN l_linenumber = 2 AND l_returnflag = 'R' THEN p_name || ', deluxe' ELSE p_name END AS product,
         CASE WHEN l_linenumber = 1 AND l_returnflag = 'A' THEN strftime(day, '%b/%y')
              ELSE strftime(day, '%Y-%m-%d') END AS token
  FROM stg),
kept AS (SELECT * FROM sheet WHERE NOT bad_total AND NOT short),
platform_sheet AS (
  SELECT c_mktsegment || '-' || c_nationkey AS platform_name, CAST(c_nationkey + 50.25 AS DOUBLE) AS share,
         CAST(DATE '2020-01-01' + to_months(c_nationkey) AS DATE) AS start, c_nationkey = 3 AS bad
  FROM (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer))"""

STATUS = """
CASE WHEN {skip} THEN 'SKIPPED' WHEN {loads} THEN 'PROCESSED' ELSE 'FAILED' END AS status,
CASE WHEN {skip} THEN 'Record already exists for this month/isrc/country/service' WHEN {loads} THEN NULL
     WHEN s.song_id IS NULL THEN 'Invalid ISRC'
     WHEN NOT EXISTS (SELECT 1 FROM platform p WHERE p.active AND p.platform_name = g.service) THEN 'Invalid platform'
     WHEN g.userid NOT IN (SELECT artist_id FROM artist) THEN 'Invalid artist ID'
     ELSE 'Song not released' END AS error_message"""


def _with(body: str, extra: str = "") -> str:
    return f"WITH {STAR.strip()}{extra}\n{body.strip()}"


def _money(column: str, name: str) -> str:
    return f"CAST(sum({column}) AS DOUBLE) / 1000000 AS {name}"


def _rate_of(part: str, whole: str) -> str:
    return f"CAST((2 * {part} * 10000 + {whole}) // (2 * nullif({whole}, 0)) AS DOUBLE) / 100"


def _rate(name: str) -> str:
    return f"{_rate_of('sum(royalty)', 'sum(revenue)')} AS {name}"


def _each_of(revenue: str, plays: str) -> str:
    return f"CAST((2 * {revenue} + {plays}) // (2 * nullif({plays}, 0)) AS DOUBLE) / 1000000"


def _per_play(name: str) -> str:
    return f"{_each_of('sum(revenue)', 'sum(plays)')} AS {name}"


def _sums(plays: str = "total_plays", revenue: str = "total_revenue", royalty: str | None = "total_royalties") -> str:
    parts = [f"CAST(sum(plays) AS BIGINT) AS {plays}", _money("revenue", revenue)]
    return ", ".join(parts + ([_money("royalty", royalty)] if royalty else []))


def _count(column: str, name: str) -> str:
    return f"count(DISTINCT {column}) AS {name}"


SHARE = "CAST(share_c AS DOUBLE) / 100 AS revenue_share_percentage"
AGES = "min(created_at) AS earliest_record, max(created_at) AS latest_record"


def _grouped(keys: str, *columns: str, source: str = "released", where: str = "true", tail: str = "") -> str:
    """One aggregate over the star: the keys, then the given columns."""
    plain = ", ".join(k.split(" AS ")[0] for k in keys.split(", "))
    return f"SELECT {keys}, {', '.join(columns)} FROM {source} WHERE {where} GROUP BY {plain} {tail}"


def _views() -> dict[str, str]:
    overview = [
        _count("song_artist", "active_artists"), _count("song_label", "active_labels"),
        _count("song_id", "active_songs"), _count("platform_id", "active_platforms"), _sums(), _rate("avg_royalty_rate")]
    return {
        "mv_revenue_overview": _grouped("year, month", *overview, _per_play("avg_revenue_per_play"), AGES, where="active"),
        "mv_revenue_overview_compact": _grouped("year, month", *overview, where="active"),
        "mv_artist_dashboard": f"""
            SELECT id AS revenue_id, song_artist AS artist_id, artist_name, song_label AS label_id, label_name, year, month,
                   isrc, platform_name AS service, plays, CAST(revenue AS DOUBLE) / 1000000 AS revenue,
                   CAST(royalty AS DOUBLE) / 1000000 AS royalty, {_rate_of('royalty', 'revenue')} AS royalty_percentage
            FROM released""",
        "mv_artist_dashboard_agg": _grouped(
            "sheet_artist AS artist_id, sheet_artist_name AS artist_name, year, month", _count("song_id", "songs"),
            _count("platform_id", "platforms"), _sums("plays", "revenue", "royalty")),
        "mv_platform_analytics": f"""
            SELECT platform_name, {SHARE}, year, month, {_count('song_id', 'unique_songs')},
                   {_count('song_artist', 'unique_artists')}, {_count('song_label', 'unique_labels')},
                   {_count('isrc', 'unique_isrcs')}, {_sums()}, {AGES}
            FROM released WHERE active GROUP BY platform_name, share_c, year, month""",
        "mv_artist_earnings": _grouped(
            "year, month, song_artist AS artist_id, artist_name", _sums(),
            "round(avg(royalty * 100.0 / nullif(revenue, 0)), 2) AS avg_royalty_percentage",
            _count("song_id", "unique_songs"), _count("platform_id", "platform_count")),
        "mv_platform_revenue": f"""
            SELECT year, month, platform_name, {SHARE}, {_count('song_id', 'songs_played')},
                   {_count('song_artist', 'unique_artists')}, {_sums()}
            FROM released GROUP BY year, month, platform_name, share_c""",
        "mv_artist_performance": _grouped(
            "year, month, song_artist AS artist_id, artist_name, song_id, title AS song_name, isrc", _sums(),
            _count("platform_id", "platform_count")),
        "mv_label_performance": _grouped(
            "year, month, song_label AS label_id, label_name", _count("song_artist", "unique_artists"),
            _count("song_id", "unique_songs"), _sums()),
        "mv_artist_platform_label": _grouped(
            "year, month, song_artist AS artist_id, artist_name, platform_name, label_name",
            _count("song_id", "unique_songs"), _sums()),
        "mv_isrc_geo_platform": _grouped(
            "year, month, isrc, title AS song_name, artist_name, country_code, region, platform_name", _sums(),
            where="geography_id IS NOT NULL"),
    }


def _reports(artist: int, year: int, month: str, as_of: dt.date) -> dict[str, str]:
    views = _views()
    at = f"year = {year} AND month = '{month}'"
    month_no = f"list_position({MONTHS}, month)"
    geography = _grouped(
        "year, month, isrc, title AS song_name, sheet_artist_name AS artist_name, country_code, region, platform_name",
        _sums(), source="wide", where="geography_id IS NOT NULL AND {0}")
    matrix = _grouped(
        "year, month, platform_name, song_label AS label_id, label_name, sheet_artist AS artist_id, "
        "sheet_artist_name AS artist_name", _count("song_id", "unique_songs"), _sums(), source="wide", where="{0}")
    return {
        "period_exists": f"SELECT count(*) > 0 AS exists FROM fact WHERE {at}",
        "artist_exists": f"SELECT count(*) > 0 AS exists FROM artist WHERE artist_id = {artist}",
        "revenue_overview_lookup": f"SELECT * FROM ({views['mv_revenue_overview']}) WHERE {at}",
        "artist_latest_performance": _grouped(
            "sheet_artist AS artist_id, sheet_artist_name AS artist_name, song_label AS label_id, label_name, year, month",
            _count("song_id", "songs"), _count("platform_id", "platforms"), _sums("plays", "revenue", "royalty"),
            _rate("royalty_percentage"), source="wide", where=f"sheet_artist = {artist}",
            tail=f"ORDER BY year DESC, {month_no} DESC, song_label LIMIT 1"),
        "artist_earnings": f"SELECT * FROM ({views['mv_artist_earnings']}) WHERE artist_id = {artist}",
        "platform_metrics_current":
            f"SELECT * FROM ({views['mv_platform_analytics']}) "
            f"WHERE year = {as_of.year} AND month = strftime(DATE '{as_of}', '%b')",
        "revenue_by_platform": _grouped(
            "platform_name", _sums(), _count("isrc", "unique_tracks"), source="wide", where=at),
        "top_artists": _grouped(
            "song_artist AS artist_id, artist_name", _count("song_id", "total_songs"), _sums(), source="wide", where=at,
            tail="ORDER BY sum(revenue) DESC, song_artist LIMIT 10"),
        "label_performance_period": _grouped(
            "song_label AS label_id, label_name", _count("song_artist", "total_artists"),
            _count("song_id", "total_songs"), _sums(), source="wide", where=at),
        "geographic_analysis": geography.format("true"),
        "geographic_analysis_filtered": geography.format(f"year = {year} AND country_code = 'AB'"),
        "platform_label_matrix": matrix.format("true"),
        "platform_label_matrix_filtered": matrix.format(f"platform_name = 'BUILDING' AND month = '{month}'"),
        "artist_song_performance": f"SELECT * FROM ({views['mv_artist_performance']}) WHERE artist_id = {artist}",
    }


def _growth(now: str, before: str, name: str) -> str:
    """Percentage change, rounded half up on its absolute value."""
    change = f"(CAST({now} AS HUGEINT) - {before})"
    size = f"CAST((2 * abs({change}) * 10000 + {before}) // (2 * nullif({before}, 0)) AS DOUBLE) / 100"
    return f"CASE WHEN {change} < 0 THEN -({size}) ELSE {size} END AS {name}"


_TOTALS = """
    totals AS (
      SELECT song_artist, artist_name, song_label, label_name, year, month,
             year * 12 + list_position({months}, month) AS period, count(DISTINCT song_id) AS songs,
             count(DISTINCT platform_id) AS platforms, sum(plays) AS plays, sum(revenue) AS revenue, sum(royalty) AS royalty
      FROM released GROUP BY ALL)"""


def _growth_rows(join: str) -> str:
    return f"""
        SELECT t.song_artist AS artist_id, t.artist_name, t.song_label AS label_id, t.label_name, t.year, t.month,
               t.songs, t.platforms, CAST(t.plays AS BIGINT) AS plays, CAST(t.revenue AS DOUBLE) / 1000000 AS revenue,
               CAST(t.royalty AS DOUBLE) / 1000000 AS royalty, {_rate_of('t.royalty', 't.revenue')} AS royalty_percentage,
               {_growth('t.plays', 'b.plays', 'plays_growth')}, {_growth('t.revenue', 'b.revenue', 'revenue_growth')},
               {_growth('t.songs', 'b.songs', 'songs_growth')}
        FROM totals t LEFT JOIN {join}"""


def _analytics(artist: int, year: int, month: str) -> dict[str, str]:
    totals = "," + _TOTALS.format(months=MONTHS)
    growth = _growth_rows(
        "totals b ON b.song_artist = t.song_artist AND b.song_label = t.song_label AND b.period = t.period - 1")
    literal = _growth_rows(
        "(SELECT * FROM totals WHERE (year, month) IN (SELECT (year, month) FROM "
        "(SELECT year, month FROM totals ORDER BY year DESC, month DESC LIMIT 1 OFFSET 1))) b "
        "ON b.song_artist = t.song_artist")
    month_no = f"list_position({MONTHS}, month)"
    trends = f"""
        SELECT platform_name, {SHARE}, year, month, {_count('song_id', 'unique_songs')},
               {_count('song_artist', 'unique_artists')}, {_count('song_label', 'unique_labels')},
               {_count('isrc', 'unique_isrcs')}, {_sums()}, {_rate('royalty_percentage')},
               {_per_play('revenue_per_play')}, {AGES}
        FROM released WHERE active GROUP BY platform_name, share_c, year, month"""
    share = _rate_of("sum(revenue)", "sum(sum(revenue)) OVER (PARTITION BY {0}, year, month)")
    return {
        "artist_label_earnings": _with(_grouped(
            "year, month, song_artist AS artist_id, artist_name, label_name", _count("song_id", "song_count"),
            _count("platform_id", "platform_count"), _sums("play_count", "gross_revenue", "artist_royalty"),
            _rate("royalty_percentage"), AGES)),
        "platform_activity": _with(_grouped(
            "year, month, platform_name", _sums(royalty=None), _count("song_id", "unique_songs"),
            _count("song_artist", "unique_artists"), _count("song_label", "unique_labels"), source="wide", where="active")),
        "artist_label_performance": _with(_grouped(
            "year, month, song_artist AS artist_id, artist_name, song_label AS label_id, label_name",
            _count("song_id", "song_count"), _count("platform_id", "platform_count"),
            _sums("total_plays", "gross_revenue", "royalty_earned"), _rate("royalty_percentage"))),
        "royalty_statement": _with(f"""
            SELECT title AS song_title, isrc, label_name, platform_name AS platform, plays AS play_count,
                   CAST(revenue AS DOUBLE) / 1000000 AS gross_revenue, CAST(royalty AS DOUBLE) / 1000000 AS royalty_amount,
                   {SHARE}
            FROM released WHERE active AND song_artist = {artist} AND year = {year} AND month = '{month}'"""),
        "payment_eligible_artists": _with(f"""
            SELECT song_artist AS artist_id, artist_name, label_name, {_money('royalty', 'unpaid_royalties')},
                   {_count('song_id', 'song_count')}, {_count('platform_id', 'platform_count')}
            FROM released JOIN (SELECT artist_id, threshold FROM artist) a ON song_artist = a.artist_id
            WHERE NOT (song_artist % 2 = 0 AND month IN ('Jan', 'Feb', 'Mar'))
            GROUP BY song_artist, artist_name, label_name, threshold
            HAVING sum(royalty) >= CAST(threshold AS HUGEINT) * 1000000"""),
        "artist_growth_dashboard": _with(growth, totals),
        "artist_growth_dashboard_literal": _with(literal, totals),
        "artist_latest_dashboard": _with(f"""
            SELECT * FROM ({growth}) QUALIFY row_number() OVER (
              PARTITION BY artist_id ORDER BY year DESC, {month_no} DESC, label_id) = 1""", totals),
        "label_rates": _with(_grouped(
            "year, month, song_label AS label_id, label_name", _count("song_artist", "artist_count"),
            _count("song_id", "song_count"), _sums(), _rate("royalty_percentage"), _per_play("revenue_per_play"))),
        "isrc_performance": _with("""
            SELECT isrc, title, artist_name, label_name, year, month, CAST(sum(p) AS BIGINT) AS total_plays,
                   CAST(sum(u) AS DOUBLE) / 1000000 AS total_revenue, CAST(sum(r) AS DOUBLE) / 1000000 AS total_royalties,
                   count(*) AS platform_count,
                   CAST((2 * sum(v) + count(v) * 1000000000000) // (2 * nullif(count(v), 0) * 1000000000000) AS DOUBLE) / 1000000
                     AS avg_revenue_per_play
            FROM (SELECT isrc, title, artist_name, label_name, year, month, platform_id, sum(plays) AS p,
                         sum(revenue) AS u, sum(royalty) AS r,
                         (2 * sum(revenue) * 1000000000000 + sum(plays)) // (2 * nullif(sum(plays), 0)) AS v
                  FROM released GROUP BY ALL)
            GROUP BY isrc, title, artist_name, label_name, year, month"""),
        "geographic_performance": _with(_grouped(
            "country_code, country_name, region, year, month", _count("song_artist", "artist_count"),
            _count("song_id", "song_count"), _count("song_label", "label_count"), _sums(),
            _per_play("revenue_per_play"), _rate("royalty_percentage"), where="geography_id IS NOT NULL")),
        "label_platform_performance": _with(_grouped(
            "label_name, platform_name, year, month", _count("song_artist", "artists"), _count("song_id", "songs"),
            _sums("plays", "revenue", "royalty"), _per_play("revenue_per_play"), _rate("royalty_percentage"),
            where="active")),
        "label_geography_share": _with(_grouped(
            "label_name, region, country_name, year, month", _count("song_artist", "artists"),
            _count("song_id", "songs"), _sums("plays", "revenue", "royalties"),
            f"{share.format('label_name')} AS region_share", _rate("royalty_percentage"),
            where="geography_id IS NOT NULL")),
        "artist_platform_label_rates": _with(_grouped(
            "label_name, artist_name, platform_name, year, month", _count("song_id", "songs"),
            _sums("plays", "revenue", "royalty"), _per_play("revenue_per_play"), _rate("royalty_percentage"),
            where="active")),
        "isrc_geo_platform_share": _with(_grouped(
            "isrc, title, artist_name, label_name, region, platform_name, year, month",
            _sums("plays", "revenue", "royalties"), _per_play("revenue_per_play"), _rate("royalty_percentage"),
            f"{share.format('isrc')} AS platform_share", where="geography_id IS NOT NULL AND active")),
        "platform_trends": _with(trends),
        "artist_platform_rate": _with(_grouped(
            "artist_name, platform_name", _count("song_id", "songs"), _sums("plays", "revenue", "royalty"),
            _rate("effective_rate"), where="active")),
        "artist_song_summary": _with(_grouped(
            "title, artist_name, label_name", _sums(), _count("platform_id", "platform_count"),
            _rate("royalty_percentage"))),
        "latest_platform_metrics": _with(f"""
            SELECT * EXCLUDE (year, month) FROM ({trends})
            QUALIFY rank() OVER (ORDER BY year DESC, {month_no} DESC) = 1"""),
        "revenue_quality_monitor": _with(_grouped(
            "year, month", "count(*) AS record_count", _count("song_artist", "artist_count"),
            _count("song_label", "label_count"), _count("platform_id", "platform_count"),
            "CAST(sum(CASE WHEN royalty > revenue THEN 1 ELSE 0 END) AS BIGINT) AS invalid_royalties",
            "CAST(sum(CASE WHEN plays < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative_plays",
            _rate("avg_royalty_rate"), AGES)),
        "missing_revenue_check": _with(f"""
            SELECT s.isrc, s.title, a.artist_name, l.label_name, p.platform_name, count(f.id) AS months_with_data,
                   strftime(min(CAST(f.d AS DATE)), '%Y-%b') AS first_month,
                   strftime(max(CAST(f.d AS DATE)), '%Y-%b') AS last_month,
                   {_rate_of('sum(f.royalty)', 'sum(f.revenue)')} AS avg_royalty_rate
            FROM song s CROSS JOIN platform p JOIN artist a ON s.song_artist = a.artist_id
            JOIN label l ON s.song_label = l.label_id
            LEFT JOIN (SELECT *, date_trunc('month', created_at) AS d FROM fact) f
              ON f.song_id = s.song_id AND f.platform_id = p.platform_id
            WHERE s.song_status = 'Released' AND p.active
            GROUP BY s.isrc, s.title, a.artist_name, l.label_name, p.platform_name HAVING count(f.id) < 3"""),
        "platform_consistency": _with(_grouped(
            "platform_name, year, month", _count("song_id", "songs"), _count("song_artist", "artists"),
            _count("song_label", "labels"), _sums("plays", "revenue", None), _rate("royalty_rate"), AGES, where="active")),
    }


def _intake() -> dict[str, str]:
    amounts = "CAST(total_u AS DOUBLE) / 1000000 AS total, CAST(royalty_u AS DOUBLE) / 1000000 AS royalty"
    return {
        "intake_revenue_sheet": f"""
            SELECT service, token AS month, isrc, product, p_name AS song_name, s_name AS artist, '' AS album,
                   p_brand AS label, service AS file_name, country, id, {amounts}, userid FROM kept""",
        "intake_rejects": """
            SELECT CASE WHEN short THEN 'missing field' ELSE 'bad number' END AS fault, count(*) AS rows
            FROM sheet WHERE bad_total OR short GROUP BY 1""",
        "intake_platform_sheet": """
            SELECT platform_name, share AS revenue_share_percentage, strftime(start, '%Y-%m-%d') AS effective_from
            FROM platform_sheet WHERE NOT bad""",
        "parse_period_token": "SELECT id, token, strftime(day, '%Y-%m') AS period FROM kept",
        "intake_raw_lines": """
            SELECT f[13] AS userid, f[6] AS artist_name, f[3] AS isrc, f[5] AS song_name, f[8] AS label_name
            FROM (SELECT string_split(concat(service, ',', token, ',', isrc, ',',
                    CASE WHEN product <> p_name THEN '"' || product || '"' ELSE product END, ',', p_name, ',', s_name,
                    ',,', p_brand, ',', service, ',', country, ',', CASE WHEN bad_total THEN 'abc' ELSE
                    format('{}.{:06}', total_u // 1000000, total_u % 1000000) END, ',',
                    format('{}.{:06}', royalty_u // 1000000, royalty_u % 1000000), ',', userid), ',') AS f FROM sheet)""",
        "intake_dimension_sheet": """
            SELECT DISTINCT 'artist' AS kind, CAST(NULL AS VARCHAR) AS isrc, trim(s_name) AS name, userid AS artist_id,
                   CAST(NULL AS VARCHAR) AS label_name FROM sheet
            UNION ALL SELECT DISTINCT 'song', isrc, trim(p_name), userid, trim(p_brand) FROM sheet""",
        "stage_revenue": f"""
            SELECT id, service, day AS month, isrc, product, country, {amounts}, userid, 'PENDING' AS status FROM kept""",
        "load_platform_config": """
            SELECT CAST(7 + row_number() OVER (ORDER BY platform_name, start, share) AS INTEGER) AS platform_id,
                   platform_name, share AS revenue_share_percentage, start AS effective_from, true AS is_active
            FROM platform_sheet WHERE NOT bad""",
        "import_platforms": "SELECT platform_name AS platform, true AS success FROM platform_sheet WHERE NOT bad",
        "validate_sheet": """
            SELECT 'revenue' AS kind, count(*) FILTER (WHERE NOT bad_total AND NOT short) AS rows_found,
                   count(*) FILTER (WHERE bad_total OR short) AS rows_rejected, true AS valid,
                   min(id) FILTER (WHERE NOT bad_total AND NOT short) AS sample_id,
                   arg_min(isrc, id) FILTER (WHERE NOT bad_total AND NOT short) AS sample_isrc,
                   arg_min(product, id) FILTER (WHERE NOT bad_total AND NOT short) AS sample_name FROM sheet
            UNION ALL SELECT 'platform', count(*) FILTER (WHERE NOT bad), count(*) FILTER (WHERE bad), true, NULL, NULL,
                   min(platform_name) FILTER (WHERE NOT bad)
            FROM platform_sheet""",
        "intake_broken_lines": f"""
            SELECT service, token AS month, isrc,
                   CASE WHEN l_linenumber = 2 AND l_returnflag = 'R' THEN p_name || chr(10) || 'deluxe, "live"' ELSE p_name END AS product,
                   p_name AS song_name, s_name AS artist, '' AS album, p_brand AS label, service AS file_name, country, id, {amounts}, userid FROM kept""",
        "write_fact": """
            SELECT year, month, count(*) AS facts, CAST(sum(plays) AS BIGINT) AS plays,
                   CAST(sum(revenue) AS DOUBLE) / 1000000 AS revenue, CAST(sum(royalty) AS DOUBLE) / 1000000 AS royalty
            FROM fact GROUP BY year, month""",
        "sync_artists": """
            SELECT userid AS artist_id, min(trim(s_name)) AS artist_name, CAST(100 AS DOUBLE) AS payment_threshold
            FROM sheet WHERE userid NOT IN (SELECT artist_id FROM artist) GROUP BY userid""",
        "sync_songs": """
            SELECT isrc, trim(p_name) AS title, userid AS artist_id, label_id, 'Released' AS status
            FROM sheet JOIN label ON label_name = trim(p_brand) WHERE isrc NOT IN (SELECT isrc FROM song)
            QUALIFY row_number() OVER (PARTITION BY isrc ORDER BY trim(p_name), userid, label_id) = 1""",
        "sync_counts": """
            SELECT 'Artists' AS type, count(*) AS count FROM (
              SELECT artist_id FROM artist UNION SELECT userid FROM sheet)
            UNION ALL SELECT 'Songs', count(*) FROM (
              SELECT isrc FROM song UNION SELECT isrc FROM sheet JOIN label ON label_name = trim(p_brand))""",
    }


def _status(source: str, skip: bool, window: bool = True) -> str:
    """Status and reason of every row of ``source``, against the facts of 2020 or against none."""
    loaded_before = """EXISTS (SELECT 1 FROM fact f JOIN platform p USING (platform_id) WHERE f.year = 2020
        AND f.fact_isrc = g.isrc AND p.platform_name = g.service AND f.year = year(g.day)
        AND f.month = strftime(g.day, '%b'))"""
    days = "AND g.day >= p.first_day AND (p.last_day IS NULL OR g.day <= p.last_day)" if window else ""
    loads = f"""(s.song_status = 'Released' AND g.userid IN (SELECT artist_id FROM artist) AND EXISTS (
        SELECT 1 FROM platform p WHERE p.active AND p.platform_name = g.service {days}))"""
    columns = STATUS.format(skip=loaded_before if skip else "false", loads=loads)
    return f"SELECT g.id, {columns} FROM {source} g LEFT JOIN song s ON s.isrc = g.isrc"


def _upsert(key: str) -> str:
    """Forward load of all rows over the grossed-up facts of 2020, one row per complete key."""
    same = " AND ".join(f"o.{k} = n.{k}" for k in key.split(", "))
    known = "true" if "geography_id" not in key else "geography_id IS NOT NULL"

    def side(revenue: str, royalty: str, where: str) -> str:
        reduced = (f"SELECT {key}, min(sheet_artist) AS artist_id, CAST(sum(plays) AS INTEGER) AS total_plays, "
                   f"sum({revenue}) AS u, sum({royalty}) AS r FROM fact WHERE {known} AND {where} GROUP BY {key}")
        loose = (f"SELECT {key}, sheet_artist, plays, CAST({revenue} AS HUGEINT), CAST({royalty} AS HUGEINT) "
                 f"FROM fact WHERE NOT ({known}) AND {where}")
        return f"({reduced} UNION ALL {loose})"

    columns = ", ".join(f"coalesce(o.{k}, n.{k}) AS {k}" for k in key.split(", "))
    return f"""
        SELECT {columns}, coalesce(o.artist_id, n.artist_id) AS artist_id,
               coalesce(n.total_plays, o.total_plays) AS total_plays,
               CAST(coalesce(n.u, o.u) AS DOUBLE) / 1000000 AS revenue_amount,
               CAST(coalesce(n.r, o.r) AS DOUBLE) / 1000000 AS royalty_amount
        FROM {side('revenue', 'royalty', 'year = 2020')} o
        FULL OUTER JOIN {side('royalty', 'net_u', 'true')} n ON {same}"""


def _upsert_job(platform: str) -> str:
    """All facts, those of one platform put together per key with the sheet's amounts as revenues."""
    return f"""
        SELECT id AS revenue_id, song_id, platform_id, geography_id, sheet_artist AS artist_id, plays AS total_plays,
               CAST(revenue AS DOUBLE) / 1000000 AS revenue_amount, CAST(royalty AS DOUBLE) / 1000000 AS royalty_amount,
               created_at, year, month
        FROM fact WHERE service <> '{platform}'
        UNION ALL
        SELECT min(id), song_id, platform_id, geography_id, arg_min(sheet_artist, id), CAST(sum(plays) AS INTEGER),
               CAST(sum(royalty) AS DOUBLE) / 1000000, CAST(sum(net_u) AS DOUBLE) / 1000000,
               arg_min(created_at, id), year, month
        FROM fact WHERE service = '{platform}' GROUP BY year, month, song_id, platform_id, geography_id"""


def _load(corrected: str) -> dict[str, str]:
    counts = "SELECT status, count(*) AS count FROM ({0}) GROUP BY status"
    return {
        "load_mark_skipped": f"""
            SELECT id, CASE status WHEN 'SKIPPED' THEN status ELSE 'PENDING' END AS status,
                   CASE status WHEN 'SKIPPED' THEN error_message END AS error_message FROM ({_status('stg', True)})""",
        "load_transform": """
            SELECT id AS revenue_id, song_id, platform_id, geography_id, sheet_artist AS artist_id, plays AS total_plays,
                   CAST(revenue AS DOUBLE) / 1000000 AS revenue_amount, CAST(royalty AS DOUBLE) / 1000000 AS royalty_amount,
                   created_at, year, month FROM fact""",
        "platform_effective_join":
            "SELECT id, platform_id, CAST(share_c AS DOUBLE) / 100 AS revenue_share_percentage FROM effective",
        "geo_left_join": "SELECT id, country, geography_id FROM stg LEFT JOIN geo ON country = country_code",
        "period_columns": """
            SELECT id, CAST(year(day) AS INTEGER) AS year, strftime(day, '%b') AS month,
                   CAST(year(day) AS INTEGER) AS token_year, strftime(day, '%b') AS token_month FROM stg""",
        "gross_up": "SELECT id, CAST(gross_u AS DOUBLE) / 1000000 AS revenue_amount FROM effective",
        "royalty_forward": "SELECT id, CAST(net_u AS DOUBLE) / 1000000 AS royalty_amount FROM effective",
        "load_classify": _status("stg", True),
        "load_artist_guard": "SELECT id, userid FROM stg WHERE userid IN (SELECT artist_id FROM artist)",
        "load_upsert": _upsert("year, month, song_id, platform_id"),
        "load_upsert_by_country": _upsert("year, month, song_id, platform_id, geography_id"),
        "upsert_job": _upsert_job(corrected),
        "load_upsert_classify": _status("stg", False, window=False),
        "import_status_counts": counts.format(_status("stg", True)),
        "import_revenue": counts.format(_status("kept", True)),
        "song_details": """
            SELECT isrc, song_id, song_artist AS artist_id, song_label AS label_id, title, artist_name, label_name
            FROM song JOIN artist ON song_artist = artist_id JOIN label ON song_label = label_id
            WHERE song_status = 'Released'""",
        "load_lateral": """
            SELECT id AS revenue_id, CAST(year(day) AS INTEGER) AS year, strftime(day, '%b') AS month, song_id, platform_id,
                   song_artist AS artist_id, CAST((total_u + 500000) // 1000000 AS INTEGER) AS total_plays,
                   CAST(royalty_u AS DOUBLE) / 1000000 AS revenue_amount, CAST(net_u AS DOUBLE) / 1000000 AS royalty_amount
            FROM effective JOIN song USING (isrc) WHERE song_status = 'Released'""",
        "geography_backfill": f"""
            SELECT country_code, country_name, region, (SELECT count(*) FROM stg WHERE country = country_code) AS staged
            FROM (SELECT country_code, country_name, region FROM geo
                  UNION ALL SELECT c, n, 'Unknown' FROM (VALUES {COUNTRY_VALUES}) w(c, n)
                  WHERE c NOT IN (SELECT country_code FROM geo))""",
        "constraint_report": _constraints(),
        "refresh_views": " UNION ALL ".join(
            f"SELECT '{name}' AS view, true AS refreshed, count(*) AS rows FROM ({sql})"
            for name, sql in _views().items() if name not in ("mv_revenue_overview_compact", "mv_artist_dashboard_agg")),
    }


# Keys that are unique in the stored views.
VIEW_KEYS = {
    "mv_revenue_overview": "year, month",
    "mv_artist_dashboard": "revenue_id",
    "mv_platform_analytics": "platform_name, year, month",
    "mv_artist_earnings": "year, month, artist_id",
    "mv_platform_revenue": "year, month, platform_name",
    "mv_artist_performance": "year, month, song_id",
    "mv_label_performance": "year, month, label_id",
    "mv_artist_platform_label": "year, month, artist_id, platform_name, label_name",
    "mv_isrc_geo_platform": "year, month, isrc, country_code, platform_name",
}


def _constraints() -> str:
    def rule(name: str, sql: str) -> str:
        return f"SELECT '{name}' AS rule, CAST(({sql}) AS BIGINT) AS violations"

    def rows(name: str, table: str, broken: str) -> str:
        return rule(name, f"SELECT count(*) FROM {table} WHERE {broken}")

    def unique(name: str, table: str, key: str) -> str:
        known = " AND ".join(f"{k} IS NOT NULL" for k in key.split(", "))
        return rule(name, f"SELECT count(*) FROM (SELECT 1 FROM {table} WHERE {known} GROUP BY {key} HAVING count(*) > 1)")

    def parent(name: str, table: str, column: str, parents: str, key: str) -> str:
        return rows(name, table, f"{column} IS NOT NULL AND {column} NOT IN (SELECT {key} FROM {parents})")

    month_key = "year, month, song_id, platform_id"
    lengths = {"service": ("service", 100), "isrc": ("isrc", 12), "product": ("p_name", 255), "song_name": ("p_name", 255),
               "artist": ("s_name", 255), "label": ("p_brand", 255), "file_name": ("service", 255), "country": ("country", 2)}
    account = """(SELECT 'User.' || c_custkey || CASE WHEN c_nationkey < 22 THEN '@' ELSE '#' END || lower(c_mktsegment)
        || '.example' AS email, c_nationkey + 1 AS tenant_id,
        CASE WHEN c_acctbal > 9000 THEN 'SuperAdmin' WHEN c_acctbal < 0 THEN 'Guest' ELSE 'User' END AS role FROM customer)"""
    return " UNION ALL ".join([
        rows("staging_amounts_not_negative", "stg", "total_u < 0 OR royalty_u < 0"),
        rule("staging_status_known", "SELECT 0"),
        rows("staging_required_present", "stg",
             "id IS NULL OR service IS NULL OR day IS NULL OR isrc IS NULL OR p_name IS NULL OR s_name IS NULL "
             "OR p_brand IS NULL OR country IS NULL OR total_u IS NULL OR royalty_u IS NULL OR userid IS NULL"),
        rule("staging_album_length", "SELECT 0"),
        *[rows(f"staging_{name}_length", "stg", f"length({column}) > {limit}")
          for name, (column, limit) in lengths.items()],
        unique("staging_id_unique", "stg", "id"),
        rows("fact_royalty_within_revenue", "fact", "royalty > revenue"),
        rows("fact_month_known", "fact", f"NOT list_contains({MONTHS}, month)"),
        unique("fact_revenue_id_unique", "fact", "id"),
        unique("fact_month_song_platform_unique", "fact", month_key),
        unique("fact_month_song_platform_country_unique", "fact", f"{month_key}, geography_id"),
        parent("fact_song_exists", "fact", "song_id", "song", "song_id"),
        parent("fact_artist_exists", "fact", "sheet_artist", "artist", "artist_id"),
        parent("fact_platform_exists", "fact", "platform_id", "platform", "platform_id"),
        parent("fact_country_exists", "fact", "geography_id", "geo", "geography_id"),
        rows("song_status_known", "song", "song_status NOT IN ('Released', 'Draft', 'Archived')"),
        unique("song_isrc_unique", "song", "isrc"),
        parent("song_artist_exists", "song", "song_artist", "artist", "artist_id"),
        parent("song_label_exists", "song", "song_label", "label", "label_id"),
        rows("platform_share_in_range", "platform", "share_c NOT BETWEEN 0 AND 10000"),
        rule("platform_windows_disjoint",
             "SELECT count(*) FROM platform b WHERE b.active AND EXISTS (SELECT 1 FROM platform a WHERE a.active "
             "AND a.platform_name = b.platform_name AND (a.first_day, a.platform_id) < (b.first_day, b.platform_id) "
             "AND (a.last_day IS NULL OR a.last_day >= b.first_day))"),
        unique("country_code_unique", "geo", "country_code"),
        rows("fact_required_present", "fact", "year IS NULL OR month IS NULL OR song_id IS NULL OR platform_id IS NULL "
             "OR sheet_artist IS NULL OR plays IS NULL OR revenue IS NULL OR royalty IS NULL"),
        rows("song_required_present", "song", "isrc IS NULL OR title IS NULL OR song_artist IS NULL OR song_label IS NULL"),
        rows("artist_required_present", "artist", "artist_name IS NULL"),
        rows("label_required_present", "label", "label_name IS NULL"),
        rows("country_required_present", "geo", "country_code IS NULL OR country_name IS NULL OR region IS NULL"),
        rows("platform_required_present", "platform", "platform_name IS NULL OR share_c IS NULL OR first_day IS NULL"),
        *[rows(f"{table}_{column}_length", held, f"length({column}) > {limit}") for table, held, column, limit in (
            ("song", "song", "isrc", 12), ("song", "song", "title", 255), ("artist", "artist", "artist_name", 255),
            ("label", "label", "label_name", 100), ("country", "geo", "country_code", 2), ("country", "geo", "country_name", 100),
            ("country", "geo", "region", 50), ("platform", "platform", "platform_name", 100))],
        unique("song_id_unique", "song", "song_id"),
        unique("label_id_unique", "label", "label_id"),
        unique("country_id_unique", "geo", "geography_id"),
        unique("platform_id_unique", "platform", "platform_id"),
        *[unique(f"{name}_unique", f"({sql})", key) for name, sql in _views().items() if (key := VIEW_KEYS.get(name))],
        unique("artist_id_unique", "artist", "artist_id"),
        # Fixed value: the e-mail shape, matched without regard to case.
        rows("account_email_shape", account,
             r"NOT regexp_matches(email, '^[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}$', 'i')"),
        rows("account_role_known", account, "role NOT IN ('SuperAdmin', 'Admin', 'User')"),
        unique("account_email_tenant_unique", account, "email, tenant_id"),
    ])


def all_sql(artist: int, year: int, month: str, as_of: dt.date, corrected: str) -> dict[str, str]:
    loads = _load(corrected)
    plain = {**_views(), **_reports(artist, year, month, as_of), **{k: v for k, v in loads.items() if k != "import_revenue"}}
    on_sheet = {**_intake(), "import_revenue": loads["import_revenue"]}
    return {
        **{name: _with(sql) for name, sql in plain.items()},
        **{name: _with(sql, SHEET) for name, sql in on_sheet.items()},
        **_analytics(artist, year, month),
    }
