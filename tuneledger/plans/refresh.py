"""Refresh of the stored views: whole periods, or the changes of a batch's songs alone.

State kept beside the views, by year and month:

- ``state/month_sums``: the fact added up to month, song, platform, country and sheet artist.
- ``state/<view>`` for each grouped view: its additive sums per group, and counted members: one row per group, kind
  of id and id with the number of month sums behind it. A distinct count is the number of rows of a kind, the
  earliest date the least counted date. Adding the new and subtracting the old month sums of the touched songs
  gives the new state, and a member that nothing stands behind any more goes.
- ``state/steps/<table>``: for each period the refresh that a table was last brought up to. A change may only be
  added to a table that stands where the month sums stand; a period that does not, after a break or a failure, is
  built again from the month sums, and the month sums of a period without a step from the fact.

Views whose rows belong to one song replace the rows of the touched songs. In this way a refresh after a batch reads
the fact of the batch's songs only; files are sorted by song, so most of the other row groups are skipped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tuneledger.functions.columns import total
from tuneledger.operators.star import as_measures, rollup
from tuneledger.plans.views import BY_SONG, SONG_PLATFORM, STORED, Grouped
from tuneledger.session import drop_dir, fresh_dir, spares_disk
from tuneledger.sources.warehouse import Star, Warehouse

Period = tuple[int, str]
SUM_KEYS = (*SONG_PLATFORM, "geography_id", "sheet_artist")
_ADDITIVE = ("plays", "revenue", "royalty", "pct_total", "pct_rows")
_SUMS = "month_sums"


def in_periods(df: DataFrame, periods: list[Period]) -> DataFrame:
    """Literal filter on year and month, so Spark lists and reads only these folders."""
    wanted = F.lit(False)
    for year in sorted({year for year, _ in periods}):
        months = [month for y, month in periods if y == year]
        wanted = wanted | ((F.col("year") == year) & F.col("month").isin(months))
    return df.where(wanted)


def periods_of(rows: DataFrame) -> list[Period]:
    """Periods of rows with year and month: at most twelve per year, so they fit the driver."""
    return sorted((row["year"], row["month"]) for row in rows.select("year", "month").distinct().collect())


def only_songs(df: DataFrame, songs: DataFrame) -> DataFrame:
    """Rows of the given (year, month, song_id); the range of the ids prunes files sorted by song."""
    ends = songs.agg(F.min("song_id").alias("first"), F.max("song_id").alias("last")).first()
    near = df.where(F.col("song_id").between(ends["first"], ends["last"]))
    return near.join(songs, ["year", "month", "song_id"], "left_semi")


# --- steps ------------------------------------------------------------------------------

def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def steps_of(warehouse: Warehouse) -> dict[str, dict[Period, str]]:
    """By table: the refresh that each period was last brought up to, one row per table and calendar month."""
    found: dict[str, dict[Period, str]] = {}
    for part in ("sums", "views"):
        held = _stored(warehouse.spark, warehouse.path(f"state/steps/{part}"))
        for r in [] if held is None else held.collect():
            found.setdefault(r["name"], {})[r["year"], r["month"]] = r["step"]
    return found


def _note(warehouse: Warehouse, part: str, steps: dict[str, dict[Period, str]]) -> None:
    rows = [(name, year, month, step) for name, at in sorted(steps.items()) for (year, month), step in sorted(at.items())]
    frame = warehouse.spark.createDataFrame(rows, "name string, year int, month string, step string")
    frame.coalesce(1).write.mode("overwrite").parquet(warehouse.path(f"state/steps/{part}"))


def _note_sums(warehouse: Warehouse, steps: dict[Period, str]) -> None:
    _note(warehouse, "sums", {_SUMS: steps})


def _without(steps: dict[Period, str], periods: list[Period]) -> dict[Period, str]:
    return {period: step for period, step in steps.items() if period not in periods}


# --- month sums -------------------------------------------------------------------------

def month_sums(warehouse: Warehouse) -> DataFrame:
    kinds = rollup(as_measures(warehouse.star().facts), *SUM_KEYS).schema
    return warehouse.spark.read.schema(kinds).parquet(warehouse.path(f"state/{_SUMS}"))


def _put(warehouse: Warehouse, path: str, rows: DataFrame, whole: bool = False) -> None:
    """Replace the periods of ``rows`` by way of a folder of their own, so that a table may be made from itself."""
    pending = fresh_dir(warehouse.spark, "pending")
    rows.write.parquet(pending)
    warehouse.replace_periods(warehouse.path(path), warehouse.spark.read.parquet(pending), whole=whole)
    drop_dir(warehouse.spark, pending)


def write_month_sums(warehouse: Warehouse, facts: DataFrame | None = None, periods: list[Period] | None = None) -> str:
    """Add up the fact of whole periods, or all of it; returns the step they stand at from here on."""
    step, facts = uuid.uuid4().hex, warehouse.star().facts if facts is None else facts
    before = {} if periods is None else _without(steps_of(warehouse).get(_SUMS, {}), periods)
    _note_sums(warehouse, before)
    facts = facts if periods is None else in_periods(facts, periods)
    sums = rollup(as_measures(facts), *SUM_KEYS)
    warehouse.replace_periods(warehouse.path(f"state/{_SUMS}"), sums, "song_id", whole=periods is None)
    found = periods_of(month_sums(warehouse)) if periods is None else periods
    _note_sums(warehouse, {**before, **dict.fromkeys(found, step)})
    return step


def summed_star(warehouse: Warehouse) -> Star:
    """The star with the month sums of the last refresh, from which reports start instead of the fact."""
    star = warehouse.star()
    return star.with_facts(star.facts, month_sums(warehouse))


# --- counted members --------------------------------------------------------------------

def _state_rows(view: Grouped, measures: DataFrame, star: Star, sign: int = 1) -> DataFrame:
    """Month sums as state rows: one of additive sums, and one per counted member."""
    placed = view.placed(measures, star)
    nothing = {"member": F.lit(None).cast("bigint"), "created": F.lit(None).cast("timestamp_ntz")}

    def row(kind: str | None, **own) -> Column:
        values = {**nothing, **own}
        sums = [(F.col(c) * sign if kind is None else F.lit(None)).cast(placed.schema[c].dataType).alias(c) for c in _ADDITIVE]
        return F.struct(F.lit(kind).cast("string").alias("kind"), *[c.alias(name) for name, c in values.items()],
                        F.lit(sign).cast("bigint").alias("n"), *sums)

    made = [row(None), *[row(kind, member=F.col(c).cast("bigint")) for kind, c in view.members.items()]]
    if view.dated:
        made += [row(c, created=F.col(c)) for c in ("first_created", "last_created")]
    return placed.select(*view.by, F.explode(F.array(*made)).alias("state")).select(*view.by, "state.*")


def _merged(view: Grouped, rows: DataFrame) -> DataFrame:
    """State rows added up; what nothing stands behind any more is left out."""
    kinds = {c: rows.schema[c].dataType for c in _ADDITIVE}
    return rows.groupBy(*view.by, "kind", "member", "created").agg(
        F.sum("n").alias("n"), *[F.sum(c).cast(kinds[c]).alias(c) for c in _ADDITIVE]).where("n > 0")


def _view_of(view: Grouped, state: DataFrame, star: Star) -> DataFrame:
    """The view's rows from its state."""
    def of(kind: str | None) -> Column:
        return F.col("kind").isNull() if kind is None else F.col("kind") == kind

    counted = [F.count_if(of(kind)).alias(kind) for kind in view.members]
    sums = [F.sum("plays").alias("plays"), *[total(c).alias(c) for c in ("revenue", "royalty")],
            F.sum("pct_total").alias("pct_total"), F.sum("pct_rows").alias("pct_rows")]
    dates = [F.min(F.when(of("first_created"), F.col("created"))).alias("first_created"),
             F.max(F.when(of("last_created"), F.col("created"))).alias("last_created")]
    return view.finish(state.groupBy(*view.by).agg(*sums, *counted, *(dates if view.dated else ())), star)


# --- refresh ----------------------------------------------------------------------------

_OUTCOME = "view string, refreshed boolean, message string"

#: Bytes of month sums above which a view has tasks enough of its own. The shuffles of a view take up to 18 times as much.
LARGE_SUMS = 32_000_000


def _at_once(warehouse: Warehouse) -> int:
    """How many views to refresh at once, as the shuffles of all of them lie on disk together."""
    folder = warehouse.spark._jvm.org.apache.hadoop.fs.Path(warehouse.path(f"state/{_SUMS}"))
    held = folder.getFileSystem(warehouse.spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    return 1 if held > LARGE_SUMS else 4


def _reported(warehouse: Warehouse, refresh: Callable[[str], None], steps: dict[str, dict[Period, str]],
              periods: list[Period], step: str) -> DataFrame:
    """Run the refresh of each view, note the step of those that worked, and report."""
    def one(name: str) -> tuple[str, bool, str | None]:
        try:
            refresh(name)
            return name, True, None
        except Exception as error:  # reported per view, as the caller decides what to do
            return name, False, str(error).splitlines()[0]

    # The views are independent jobs; submitting a few at once keeps the executors busy.
    with ThreadPoolExecutor(max_workers=_at_once(warehouse)) as pool:
        outcome = list(pool.map(one, STORED))
    after = {name: at for name, at in steps.items() if name != _SUMS}
    for name, worked, _ in outcome:
        if worked:
            after[name] = {**after.get(name, {}), **dict.fromkeys(periods, step)}
    _note(warehouse, "views", after)
    return warehouse.spark.createDataFrame(outcome, _OUTCOME)


def _no_sums(warehouse: Warehouse, error: Exception) -> DataFrame:
    """No view can be refreshed without the sums."""
    message = str(error).splitlines()[0]
    return warehouse.spark.createDataFrame([(name, False, message) for name in STORED], _OUTCOME)


def _build(warehouse: Warehouse, name: str, star: Star, periods: list[Period] | None) -> None:
    """One view of whole periods from the month sums."""
    view, path, whole = STORED[name], f"views/{name}", periods is None
    if isinstance(view, Grouped):
        sums = star.summed if whole else in_periods(star.summed, periods)
        state = _merged(view, _state_rows(view, sums, star))
        warehouse.replace_periods(warehouse.path(f"state/{name}"), state, whole=whole)
        held = warehouse.spark.read.schema(state.schema).parquet(warehouse.path(f"state/{name}"))
        rows = _view_of(view, held if whole else in_periods(held, periods), star)
    else:
        rows = view(star if whole else star.with_facts(in_periods(star.facts, periods), in_periods(star.summed, periods)))
    warehouse.replace_periods(warehouse.path(path), rows, whole=whole)


def _change(warehouse: Warehouse, name: str, star: Star, periods: list[Period], songs: DataFrame, change: DataFrame) -> None:
    """One view after a change of some songs, from what it holds."""
    view, spark = STORED[name], warehouse.spark
    if isinstance(view, Grouped):
        kinds = _merged(view, _state_rows(view, star.summed, star)).schema
        held = spark.read.schema(kinds).parquet(warehouse.path(f"state/{name}"))
        signs = [_state_rows(view, change.where(F.col("sign") == sign).drop("sign"), star, sign) for sign in (1, -1)]
        rows = in_periods(held, periods).unionByName(signs[0]).unionByName(signs[1])
        _put(warehouse, f"state/{name}", _merged(view, rows.select(*[F.col(f.name).cast(f.dataType) for f in kinds.fields])))
        held = spark.read.schema(kinds).parquet(warehouse.path(f"state/{name}"))
        warehouse.replace_periods(warehouse.path(f"views/{name}"), _view_of(view, in_periods(held, periods), star))
    else:
        codes = songs.join(star.songs.select("song_id", "isrc"), "song_id").select("year", "month", "isrc")
        sums = change.where("sign = 1").drop("sign")
        fresh = view(star.with_facts(only_songs(in_periods(star.facts, periods), songs), sums))
        held = in_periods(spark.read.schema(fresh.schema).parquet(warehouse.path(f"views/{name}")), periods)
        _put(warehouse, f"views/{name}", held.join(codes, ["year", "month", "isrc"], "left_anti").unionByName(fresh))


def changed_sums(warehouse: Warehouse, periods: list[Period], songs: DataFrame) -> DataFrame:
    """Month sums of the touched songs: the fact's with sign 1, the stored ones with sign -1."""
    new = rollup(as_measures(only_songs(in_periods(warehouse.star().facts, periods), songs)), *SUM_KEYS)
    old = only_songs(in_periods(month_sums(warehouse), periods), songs)
    same = [F.col(f.name).cast(f.dataType).alias(f.name) for f in old.schema.fields]
    return new.select(*same, F.lit(1).alias("sign")).unionByName(old.withColumn("sign", F.lit(-1)))


@spares_disk
def refresh_songs(warehouse: Warehouse, songs: DataFrame) -> DataFrame:
    """Bring sums and views up to the fact after a change of some (year, month, song_id) only; reports per view."""
    folder = fresh_dir(warehouse.spark, "touched")
    try:
        songs.select("year", "month", "song_id").distinct().write.parquet(f"{folder}/songs")
        return _follow(warehouse, warehouse.spark.read.parquet(f"{folder}/songs"), f"{folder}/sums")
    finally:
        drop_dir(warehouse.spark, folder)


def _follow(warehouse: Warehouse, songs: DataFrame, path: str) -> DataFrame:
    """The refresh of written (year, month, song_id); ``path`` is for the changes of their month sums."""
    touched, steps = periods_of(songs), steps_of(warehouse)
    sums = steps.get(_SUMS, {})
    new, known = [p for p in touched if p not in sums], [p for p in touched if p in sums]
    step, change = uuid.uuid4().hex, None
    try:
        if new:
            step = write_month_sums(warehouse, periods=new)
        if known:
            changed_sums(warehouse, known, songs).write.parquet(path)
            change = warehouse.spark.read.parquet(path)
            after = {**sums, **dict.fromkeys(new, step)}
            _note_sums(warehouse, _without(after, known))
            kept = in_periods(month_sums(warehouse), known).join(songs, ["year", "month", "song_id"], "left_anti")
            _put(warehouse, f"state/{_SUMS}", kept.unionByName(change.where("sign = 1").drop("sign")))
            _note_sums(warehouse, {**after, **dict.fromkeys(known, step)})
    except Exception as error:
        return _no_sums(warehouse, error)
    star = summed_star(warehouse)

    def refresh(name: str) -> None:
        at = steps.get(name, {})
        changes = isinstance(STORED[name], Grouped) or name in BY_SONG
        follows = [p for p in known if changes and at.get(p) == sums[p]]
        rest = [p for p in touched if p not in follows]
        if follows:
            _change(warehouse, name, star, follows, in_periods(songs, follows), in_periods(change, follows))
        if rest:
            _build(warehouse, name, star, rest)

    return _reported(warehouse, refresh, steps, touched, step)


@spares_disk
def refresh_periods(warehouse: Warehouse, periods: list[Period] | None = None) -> DataFrame:
    """Build sums and views of whole periods, or all, from the fact; reports per view. Needed after dimensions change."""
    try:
        step = write_month_sums(warehouse, periods=periods)
    except Exception as error:
        return _no_sums(warehouse, error)
    star, steps = summed_star(warehouse), steps_of(warehouse)
    whole = sorted(steps[_SUMS]) if periods is None else periods
    return _reported(warehouse, lambda name: _build(warehouse, name, star, periods), {} if periods is None else steps, whole, step)
