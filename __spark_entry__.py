"""Entry points: flagship query, all registered queries, their SQL counterparts."""

from __future__ import annotations

import datetime as dt
import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T  # noqa: E402

import oracles  # noqa: E402
from tuneledger.functions.columns import month_date, month_of, period_token, year_of  # noqa: E402
from tuneledger.operators import dimensions, load, quality  # noqa: E402
from tuneledger.plans import analytics, jobs, refresh, reports, views  # noqa: E402
from tuneledger.session import fresh_dir  # noqa: E402
from tuneledger.sources import sample_sheets, sample_star, sample_warehouse, sheets  # noqa: E402
from tuneledger.sources.warehouse import Star, Warehouse  # noqa: E402

Query = Callable[[SparkSession, str], DataFrame]

# Arguments of the parameterised reports; the SQL counterparts use the same values.
ARTIST, YEAR, MONTH, AS_OF = 7, 2023, "Apr", dt.date(2023, 6, 15)
#: The platform whose sheets come a second time in the upsert job.
CORRECTED = "BUILDING"

_SHEETS: dict[tuple[str, str, str], str] = {}


def _plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, the common ground with the SQL counterparts."""
    return df.select(*[
        F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else f"`{f.name}`"
        for f in df.schema.fields])


def _on_star(report: Callable[..., DataFrame], **arguments) -> Query:
    """A report on the month sums of the last refresh, as users run it."""
    return lambda spark, folder: report(refresh.summed_star(sample_warehouse.build(spark, folder)), **arguments)


def _on_staging(step: Callable[[DataFrame, Star], DataFrame], start=sample_warehouse.unloaded) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        warehouse = sample_warehouse.build(spark, folder)
        return step(warehouse.read("stg_revenue_import"), start(warehouse))
    return run


def _on_view(view: str, report: Callable[..., DataFrame], **arguments) -> Query:
    """A report on a view as the refresh job has stored it."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        warehouse = sample_warehouse.refreshed(spark, folder)
        return report(spark.read.parquet(warehouse.path(f"views/{view}")), **arguments)
    return run


def _sheet(spark: SparkSession, folder: str, kind: str) -> str:
    """Path of the sheet text of a data folder, written once per session."""
    key = (spark.sparkContext.applicationId, folder.rstrip("/"), kind)
    if key not in _SHEETS:
        path = fresh_dir(spark, f"{kind}-sheet")
        if kind == "platform":
            sample_sheets.write_platform_sheet(spark, folder, path)
        else:
            sample_sheets.write_revenue_sheet(spark, folder, path, ordered=kind == "ordered", broken=kind == "broken")
        _SHEETS[key] = path
    return _SHEETS[key]


def _fresh_warehouse(spark: SparkSession, folder: str, preload: bool = False) -> Warehouse:
    """A warehouse of its own for a job that writes: dimensions, and the facts of 2020 if wanted."""
    warehouse = Warehouse(spark, fresh_dir(spark, "job"))
    sample_warehouse.write_dimensions(warehouse, folder)
    if preload:
        warehouse.append_facts(sample_warehouse.preloaded(sample_warehouse.build(spark, folder)).facts)
    return warehouse


# --- intake -----------------------------------------------------------------------------

def intake_revenue_sheet(spark: SparkSession, folder: str) -> DataFrame:
    return sheets.intake_revenue(spark, _sheet(spark, folder, "revenue"))[0]


def intake_rejects(spark: SparkSession, folder: str) -> DataFrame:
    rejected = sheets.intake_revenue(spark, _sheet(spark, folder, "revenue"))[1]
    return rejected.groupBy("fault").agg(F.count("service").alias("rows"))


def intake_platform_sheet(spark: SparkSession, folder: str) -> DataFrame:
    return sheets.intake_platforms(spark, _sheet(spark, folder, "platform"))[0]


def parse_period_token(spark: SparkSession, folder: str) -> DataFrame:
    rows = intake_revenue_sheet(spark, folder)
    return rows.select("id", F.col("month").alias("token"), period_token("month").alias("period"))


def intake_raw_lines(spark: SparkSession, folder: str) -> DataFrame:
    return sheets.raw_line_fields(spark, _sheet(spark, folder, "revenue"))


def intake_dimension_sheet(spark: SparkSession, folder: str) -> DataFrame:
    sheet = sheets.dimension_sheet(spark, _sheet(spark, folder, "revenue"))
    artists = dimensions.sheet_artists(sheet).select(
        F.lit("artist").alias("kind"), F.lit(None).cast("string").alias("isrc"), F.col("artist_name").alias("name"),
        "artist_id", F.lit(None).cast("string").alias("label_name"))
    songs = dimensions.sheet_songs(sheet).select(
        F.lit("song").alias("kind"), "isrc", F.col("title").alias("name"), "artist_id", "label_name")
    return artists.unionByName(songs)


def stage_revenue(spark: SparkSession, folder: str) -> DataFrame:
    batch = jobs.stage_revenue(
        Warehouse(spark, fresh_dir(spark, "job")), sheets.to_staging(intake_revenue_sheet(spark, folder)))
    if not batch.clean:
        raise ValueError(f"unexpected violations: {batch.violations}")
    return batch.rows.select("id", "service", "month", "isrc", "product", "country", "total", "royalty", "userid", "status")


def load_platform_config(spark: SparkSession, folder: str) -> DataFrame:
    existing = sample_warehouse.build(spark, folder).read("platform_config")
    return dimensions.platform_rows(intake_platform_sheet(spark, folder), existing).drop("effective_to")


def import_revenue(spark: SparkSession, folder: str) -> DataFrame:
    warehouse = _fresh_warehouse(spark, folder, preload=True)
    result = jobs.import_revenue(spark, warehouse, _sheet(spark, folder, "revenue"))
    if not result.success:
        raise ValueError(result.message)
    return result.counts


def import_platforms(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.import_platforms(spark, _fresh_warehouse(spark, folder), _sheet(spark, folder, "platform"))


def validate_sheet(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, and of the first usable row of either sheet its id, code and name."""
    def checked(kind: str, sheet: str, name: str) -> DataFrame:
        of = {c: F.get_json_object("sample", f"$.{c}") for c in ("id", "isrc", name)}
        return sheets.validate_sheet(spark, _sheet(spark, folder, sheet), kind).select(
            F.lit(kind).alias("kind"), "rows_found", "rows_rejected", "valid", of["id"].alias("sample_id"),
            of["isrc"].alias("sample_isrc"), of[name].alias("sample_name"))

    return checked("revenue", "ordered", "product").unionByName(checked("platform", "platform", "platform_name"))


def intake_broken_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Usable rows of a sheet whose quoted products hold line breaks, commas and quotes."""
    return sheets.intake_revenue(spark, _sheet(spark, folder, "broken"), multi_line=True)[0]


def write_fact(spark: SparkSession, folder: str) -> DataFrame:
    built = sample_warehouse.build(spark, folder)
    target = Warehouse(spark, fresh_dir(spark, "job"))
    target.append_facts(built.read("fact_monthly_revenue"))
    return target.read("fact_monthly_revenue").groupBy("year", "month").agg(
        F.count(F.lit(1)).alias("facts"), F.sum("total_plays").alias("plays"),
        F.sum("revenue_amount").alias("revenue"), F.sum("royalty_amount").alias("royalty"))


# --- load -------------------------------------------------------------------------------

def _effective(staging: DataFrame, star: Star) -> DataFrame:
    return load.effective_platforms(staging, star)


def period_columns(spark: SparkSession, folder: str) -> DataFrame:
    rows = sample_warehouse.build(spark, folder).read("stg_revenue_import")
    token = F.date_format("month", "yyyy-MM")
    return rows.select("id", year_of("month").alias("year"), month_of("month").alias("month"),
                       year_of(month_date(token)).alias("token_year"), month_of(month_date(token)).alias("token_month"))


def load_upsert(spark: SparkSession, folder: str, key: tuple[str, ...] = load.UPSERT_KEY) -> DataFrame:
    """Forward load of all rows put over the grossed-up facts of 2020."""
    warehouse = sample_warehouse.build(spark, folder)
    star = warehouse.star()
    classified = load.classify(warehouse.read("stg_revenue_import"), star, skip_existing=False)
    incoming = load.upsert_source(load.facts_of(classified, star, forward=True), key)
    existing = load.upsert_source(sample_warehouse.preloaded(warehouse).facts, key)
    return load.upsert(existing, incoming, key)


def upsert_job(spark: SparkSession, folder: str) -> DataFrame:
    """The whole fact after one platform has sent all its sheets anew: its facts are replaced, all others stay row by row."""
    built, warehouse = sample_warehouse.build(spark, folder), _fresh_warehouse(spark, folder)
    warehouse.append_facts(built.read("fact_monthly_revenue"))
    sent = built.read("stg_revenue_import").where(F.col("service") == CORRECTED)
    jobs.upsert_batch(warehouse, jobs.stage_revenue(warehouse, sent))
    return warehouse.read("fact_monthly_revenue")


def load_lateral(spark: SparkSession, folder: str) -> DataFrame:
    warehouse = sample_warehouse.build(spark, folder)
    return load.load_by_details(warehouse.read("stg_revenue_import"), warehouse.star())[0]


def import_status_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts from the ledger after two batches: the rows of 2020 to 2022, then all others on top of their facts."""
    built, warehouse = sample_warehouse.build(spark, folder), _fresh_warehouse(spark, folder, preload=True)
    staging, first = built.read("stg_revenue_import"), F.year("month") <= 2022
    for part in (staging.where(first), staging.where(~first)):
        batch = jobs.stage_revenue(warehouse, part)
        jobs.publish(warehouse, jobs.append_batch(warehouse, batch)[0], batch.name)
    return jobs.import_status_counts(warehouse)


def _synced(spark: SparkSession, folder: str) -> tuple[Star, DataFrame, DataFrame]:
    star = sample_warehouse.build(spark, folder).star()
    sheet = sheets.dimension_sheet(spark, _sheet(spark, folder, "revenue"))
    return star, dimensions.new_artists(sheet, star), dimensions.new_songs(sheet, star)


def sync_counts(spark: SparkSession, folder: str) -> DataFrame:
    star, artists, songs = _synced(spark, folder)
    return dimensions.sync_counts(
        star.artists.select("artist_id").unionByName(artists.select("artist_id")),
        star.songs.select("isrc").unionByName(songs.select("isrc")))


def constraint_report(spark: SparkSession, folder: str) -> DataFrame:
    warehouse = sample_warehouse.refreshed(spark, folder)
    stored = {name: spark.read.parquet(warehouse.path(f"views/{name}")) for name in views.STORED}
    return quality.constraint_report(
        warehouse.star(), warehouse.read("stg_revenue_import"), sample_star.accounts(spark, folder), stored)


def geography_backfill(spark: SparkSession, folder: str) -> DataFrame:
    """The completed dimension with the number of staging rows per country."""
    warehouse = sample_warehouse.build(spark, folder)
    countries = warehouse.read("dim_geography").select("country_code", "country_name", "region")
    whole = countries.unionByName(dimensions.missing_countries(countries))
    used = warehouse.read("stg_revenue_import").groupBy(F.col("country").alias("country_code")).agg(
        F.count(F.lit(1)).alias("staged"))
    return whole.join(used, "country_code", "left").withColumn("staged", F.coalesce("staged", F.lit(0)))


def refresh_views(spark: SparkSession, folder: str) -> DataFrame:
    """Refresh of all stored views with the rows each one then holds."""
    warehouse = sample_warehouse.build(spark, folder)
    outcome = jobs.refresh_views(warehouse)
    failed = [row["message"] for row in outcome.where("NOT refreshed").collect()]
    if failed:
        raise RuntimeError(f"refresh failed: {failed}")
    held = None
    for name in views.STORED:
        rows = spark.read.parquet(warehouse.path(f"views/{name}")).agg(F.count("year").alias("rows")).select(
            F.lit(name).alias("view"), "rows")
        held = rows if held is None else held.unionByName(rows)
    return outcome.select("view", "refreshed").join(held, "view")


def _registered() -> dict[str, Query]:
    status = ("id", "status", "error_message")
    period = {"year": YEAR, "month": MONTH}
    return {
        # intake
        "intake_revenue_sheet": intake_revenue_sheet,
        "intake_rejects": intake_rejects,
        "intake_broken_lines": intake_broken_lines,
        "intake_platform_sheet": intake_platform_sheet,
        "parse_period_token": parse_period_token,
        "intake_raw_lines": intake_raw_lines,
        "intake_dimension_sheet": intake_dimension_sheet,
        "stage_revenue": stage_revenue,
        "load_platform_config": load_platform_config,
        "import_revenue": import_revenue,
        "import_platforms": import_platforms,
        "validate_sheet": validate_sheet,
        "write_fact": write_fact,
        # load
        "load_mark_skipped": _on_staging(
            lambda s, star: load.mark_skipped(s, star).select(*status), sample_warehouse.preloaded),
        "load_transform": _on_staging(load.load),
        "platform_effective_join": _on_staging(
            lambda s, star: _effective(s, star).select("id", "platform_id", "revenue_share_percentage")),
        "geo_left_join": _on_staging(
            lambda s, star: load.with_geography(s, star).select("id", "country", "geography_id")),
        "period_columns": period_columns,
        "gross_up": _on_staging(lambda s, star: _effective(s, star).select(
            "id", load.grossed_up(F.col("royalty"), F.col("revenue_share_percentage")).alias("revenue_amount"))),
        "royalty_forward": _on_staging(lambda s, star: _effective(s, star).select(
            "id", load.royalty_of(F.col("royalty"), F.col("revenue_share_percentage")).alias("royalty_amount"))),
        "load_classify": _on_staging(
            lambda s, star: load.classify(s, star).select(*status), sample_warehouse.preloaded),
        "load_artist_guard": _on_staging(lambda s, star: load.known_artists(s, star).select("id", "userid")),
        "load_upsert": load_upsert,
        "load_upsert_by_country": lambda spark, folder: load_upsert(spark, folder, (*load.UPSERT_KEY, "geography_id")),
        "upsert_job": upsert_job,
        "load_upsert_classify": _on_staging(lambda s, star: load.classify(
            s, star, skip_existing=False, window_matters=False).select(*status)),
        "import_status_counts": import_status_counts,
        "song_details": _on_star(load.song_details),
        "load_lateral": load_lateral,
        "sync_artists": lambda spark, folder: _synced(spark, folder)[1],
        "sync_songs": lambda spark, folder: _synced(spark, folder)[2],
        "sync_counts": sync_counts,
        "constraint_report": constraint_report,
        "geography_backfill": geography_backfill,
        # stored views
        **{name: _on_star(view) for name, view in {**views.STORED, **views.VARIANTS}.items()},
        "refresh_views": refresh_views,
        # parameterised reports
        "period_exists": _on_star(reports.period_exists, **period),
        "artist_exists": _on_star(reports.artist_exists, artist_id=ARTIST),
        "revenue_overview_lookup": _on_view("mv_revenue_overview", reports.revenue_overview_lookup, **period),
        "artist_latest_performance": _on_star(reports.artist_latest_performance, artist_id=ARTIST),
        "artist_earnings": _on_view("mv_artist_earnings", reports.artist_earnings, artist_id=ARTIST),
        "platform_metrics_current": _on_view("mv_platform_analytics", reports.platform_metrics_current, as_of=AS_OF),
        "revenue_by_platform": _on_star(reports.revenue_by_platform, **period),
        "top_artists": _on_star(reports.top_artists, **period),
        "label_performance_period": _on_star(reports.label_performance_period, **period),
        "geographic_analysis": _on_star(reports.geographic_analysis),
        "geographic_analysis_filtered": _on_star(reports.geographic_analysis, year=YEAR, country_code="AB"),
        "platform_label_matrix": _on_star(reports.platform_label_matrix),
        "platform_label_matrix_filtered": _on_star(reports.platform_label_matrix, platform_name="BUILDING", month=MONTH),
        "artist_song_performance": _on_view(
            "mv_artist_performance", reports.artist_song_performance, artist_id=ARTIST),
        # analytical reports
        "artist_label_earnings": _on_star(analytics.artist_label_earnings),
        "platform_activity": _on_star(analytics.platform_activity),
        "artist_label_performance": _on_star(analytics.artist_label_performance),
        "royalty_statement": _on_star(analytics.royalty_statement, artist_id=ARTIST, **period),
        "payment_eligible_artists": lambda spark, folder: analytics.payment_eligible_artists(
            refresh.summed_star(sample_warehouse.build(spark, folder)), sample_warehouse.payments(spark, folder)),
        "artist_growth_dashboard": _on_star(analytics.artist_growth_dashboard),
        "artist_growth_dashboard_literal": _on_star(analytics.artist_growth_dashboard_literal),
        "label_rates": _on_star(analytics.label_rates),
        "isrc_performance": _on_star(analytics.isrc_performance),
        "geographic_performance": _on_star(analytics.geographic_performance),
        "label_platform_performance": _on_star(analytics.label_platform_performance),
        "label_geography_share": _on_star(analytics.label_geography_share),
        "artist_platform_label_rates": _on_star(analytics.artist_platform_label_rates),
        "isrc_geo_platform_share": _on_star(analytics.isrc_geo_platform_share),
        "platform_trends": _on_star(analytics.platform_trends),
        "artist_platform_rate": _on_star(analytics.artist_platform_rate),
        "artist_song_summary": _on_star(analytics.artist_song_summary),
        "revenue_quality_monitor": _on_star(quality.revenue_quality_monitor),
        "missing_revenue_check": _on_star(quality.missing_revenue_check),
        "platform_consistency": _on_star(quality.platform_consistency),
        "latest_platform_metrics": _on_star(analytics.latest_platform_metrics),
        "artist_latest_dashboard": _on_star(analytics.artist_latest_dashboard),
    }


def _corpus():
    """The module with the corpus queries, or None where that subpackage is not installed."""
    try:
        from tuneledger.llm import queries as corpus
    except ModuleNotFoundError as missing:
        if missing.name in ("tuneledger.llm", "tuneledger.llm.queries", "corpus_pipeline"):
            return None
        raise
    return corpus


def queries() -> dict[str, Query]:
    """Every registered query as (spark, folder) -> DataFrame."""
    def plain(query: Query) -> Query:
        return lambda spark, folder: _plain(query(spark, folder))
    found = {name: plain(query) for name, query in _registered().items()}
    corpus = _corpus()
    return found if corpus is None else {**found, **corpus.queries()}


def oracle_sql() -> dict[str, str]:
    """The same results as DuckDB SQL on the supplied tables."""
    found = oracles.all_sql(ARTIST, YEAR, MONTH, AS_OF, CORRECTED)
    corpus = _corpus()
    return found if corpus is None else {**found, **corpus.oracle_sql()}


def entry(spark: SparkSession) -> DataFrame:
    """Revenue overview per period at the smallest scale."""
    return queries()["mv_revenue_overview"](spark, "/root/testdata/sf0.001")
