"""The stored star schema: Parquet folders below one root, the fact by year and month, staging rows by batch.

A batch is published by its rows in ``ledger``: its counts per status, written as one file. Staging rows and ids of a
batch count only if the ledger has it, so what a broken run left behind is never read.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tuneledger import schemas
from tuneledger.session import drop_dir, spares_disk

PERIOD = ("year", "month")

_SCHEMAS = {
    "label": schemas.LABEL, "artist": schemas.ARTIST, "song": schemas.SONG,
    "dim_geography": schemas.GEOGRAPHY, "platform_config": schemas.PLATFORM,
    "stg_revenue_import": schemas.STAGING, "fact_monthly_revenue": schemas.FACT,
    # Ids whose facts a run has begun to append, by batch; those of a broken run are known by them.
    "loading": T.StructType([T.StructField("revenue_id", T.StringType()), T.StructField("batch", T.StringType())]),
    "ledger": T.StructType([
        T.StructField("batch", T.StringType()), T.StructField("status", T.StringType()), T.StructField("rows", T.LongType())]),
}


@dataclass(frozen=True)
class Star:
    """The tables a report reads.

    ``summed`` may hold the fact already added up to month, song, platform and country; the
    refresh job sets it so that all views share one pass over the fact.
    """

    facts: DataFrame
    songs: DataFrame
    artists: DataFrame
    labels: DataFrame
    platforms: DataFrame
    countries: DataFrame
    summed: DataFrame | None = None
    #: Year and month of the fact's folders in calendar order, if they are known.
    periods: tuple[tuple[int, str], ...] | None = None

    def with_facts(self, facts: DataFrame, summed: DataFrame | None = None) -> Star:
        return replace(self, facts=facts, summed=summed)


# Fact rows aimed at per file, some 150 MB of Parquet.
ROWS_PER_FILE = 4_000_000


def parts_per_period(rows: int, periods: int) -> int:
    """Into how many parts to hash the songs of one period, so that a part fills about one file."""
    return max(1, math.ceil(rows / (max(1, periods) * ROWS_PER_FILE)))


def clustered_by_period(df: DataFrame, *within: str, song_parts: int = 1) -> DataFrame:
    """Rows arranged for a write by year and month.

    The rebalance lets adaptive execution split a month or song that holds much of the data
    over many tasks and join small months together, so files come out at an even size. With
    several song parts all rows of a song in a month lie in one file, next to each other,
    where a later sum over them shrinks the data before its shuffle.
    """
    if song_parts == 1:
        arranged = df.hint("rebalance", *PERIOD)
    else:
        part = F.pmod(F.xxhash64("song_id"), F.lit(song_parts))
        arranged = df.withColumn("song_part", part).hint("rebalance", *PERIOD, "song_part").drop("song_part")
    return arranged.sortWithinPartitions(*PERIOD, *within)


@dataclass(frozen=True)
class Warehouse:
    spark: SparkSession
    root: str
    #: Buckets of the published ids; some hundred million ids each are fine. Fixed once ids are there.
    id_buckets: int = 32

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str) -> DataFrame:
        """A table; of the staging table the rows of published batches."""
        if name != "stg_revenue_import":
            return self.spark.read.schema(_SCHEMAS[name]).parquet(self.path(name))
        staged = self.spark.read.schema(T.StructType([*_SCHEMAS[name].fields, T.StructField("batch", T.StringType())])).parquet(self.path(name))
        return staged.join(self.read("ledger").select("batch").distinct(), "batch", "left_semi").drop("batch")

    def write_of_batch(self, name: str, batch: str, df: DataFrame) -> None:
        """Store a batch's rows in the folder of the batch, in the place of what a run of it has left there."""
        fields = [f for f in _SCHEMAS[name].fields if f.name != "batch"]
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in fields]
        df.select(*columns).write.mode("overwrite").parquet(self.path(f"{name}/batch={batch}"))

    def drop_batch(self, name: str, batch: str) -> None:
        """Delete a batch's folder of a table."""
        drop_dir(self.spark, self.path(f"{name}/batch={batch}"))

    def published_ids(self) -> str:
        """Name of the table (id, batch) of all published ids, bucketed by id: joins on the id move only the other side."""
        name = f"published_ids_{hashlib.sha256(self.root.encode()).hexdigest()[:16]}"
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (id STRING, batch STRING) USING parquet "
            f"CLUSTERED BY (id) INTO {self.id_buckets} BUCKETS LOCATION '{self.path('published_ids')}'")
        return name

    @spares_disk
    def publish(self, batch: str, staged: DataFrame) -> None:
        """Add a batch's staging rows and ids; its status counts, written last, make it count."""
        self.write_of_batch("stg_revenue_import", batch, staged)
        rows = self.spark.read.schema(schemas.STAGING).parquet(self.path(f"stg_revenue_import/batch={batch}"))
        ids, table = rows.select("id", F.lit(batch).alias("batch")), self.published_ids()
        ids.repartition(self.id_buckets, "id").write.insertInto(table)
        counts = rows.groupBy("status").agg(F.count(F.lit(1)).alias("rows"))
        self.write("ledger", counts.select(F.lit(batch).alias("batch"), "status", "rows").coalesce(1))

    def read_if_present(self, name: str) -> DataFrame | None:
        try:
            return self.read(name)
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def write(self, name: str, df: DataFrame, mode: str = "append") -> None:
        """Store rows of a dimension or of the ledger in their declared column types."""
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in _SCHEMAS[name].fields]
        df.select(*columns).write.mode(mode).parquet(self.path(name))

    @spares_disk
    def append_facts(self, facts: DataFrame, song_parts: int = 1) -> None:
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.FACT.fields]
        arranged = clustered_by_period(facts.select(*columns), "song_id", song_parts=song_parts)
        arranged.write.mode("append").partitionBy(*PERIOD).parquet(self.path("fact_monthly_revenue"))

    def replace_periods(
            self, path: str, df: DataFrame, *within: str, whole: bool = False, song_parts: int = 1) -> None:
        """Overwrite exactly the year/month folders that occur in ``df``, or the whole table."""
        (clustered_by_period(df, *within, song_parts=song_parts).write.mode("overwrite")
         .option("partitionOverwriteMode", "static" if whole else "dynamic")
         .partitionBy(*PERIOD).parquet(path))

    def periods(self) -> tuple[tuple[int, str], ...]:
        """Year and month of the fact's folders in calendar order, from the listing alone: at most twelve per year."""
        folders = self.spark._jvm.org.apache.hadoop.fs.Path(self.path("fact_monthly_revenue/year=*/month=*"))
        held = folders.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(folders) or []
        found = [(status.getPath().getParent().getName(), status.getPath().getName()) for status in held]
        return tuple(sorted(((int(y.split("=")[1]), m.split("=")[1]) for y, m in found), key=lambda p: (p[0], schemas.MONTHS.index(p[1]))))

    def star(self) -> Star:
        facts = self.read_if_present("fact_monthly_revenue")
        if facts is None:
            # The limit tells the planner that there is nothing, so a load does not shuffle its rows to meet it.
            facts = self.spark.createDataFrame([], schemas.FACT).limit(0)
        return Star(
            periods=self.periods(), facts=facts, songs=self.read("song"), artists=self.read("artist"),
            labels=self.read("label"), platforms=self.read("platform_config"),
            countries=self.read("dim_geography"))
