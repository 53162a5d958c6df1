"""Live change streams.

A micro-batch runs the same DataFrame operators as a batch job: the newest row per key of the
earlier batches is put before the new rows, the change operator runs over both, and its output
for new rows is appended. State (one row per key) and output are written per batch id as new
folders in the shared checkpoint folder, so a replayed batch rewrites exactly its own folder and
a lost executor costs a recomputation, not state. A key with most of the rows of a batch is
split by the bucketed scan instead of being gathered in one Python worker.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorebook.operators import feeds
from scorebook.operators.joins import key_changes
from scorebook.operators.windows import dedup_latest
from scorebook.sources.tables import exists

Step = Callable[[DataFrame], DataFrame]


@dataclass
class KeyedChanges:
    """``foreachBatch`` sink that applies an ordered operator per key across micro-batches.

    ``step`` maps rows to output rows and must keep ``order``. Rows of a batch may arrive in any
    order; they are ordered by ``order``. Rows not later than the key's stored row are dropped:
    a later document has already replaced them.
    """

    spark: SparkSession
    path: str
    key: str
    order: list[str]
    step: Step

    def state_folder(self, batch_id: int) -> str:
        return f"{self.path}/state/b={batch_id:08d}"

    def output(self, batch_id: int) -> str:
        return f"{self.path}/out/b={batch_id:08d}"

    def previous(self, batch_id: int) -> DataFrame | None:
        """State after the batch before ``batch_id``. Every batch writes one, so it is the next lower id.

        Only the first batch may start without one; a missing folder later on is an error.
        """
        if batch_id == 0:
            return None
        path = self.state_folder(batch_id - 1)
        if not exists(self.spark, f"{path}/_SUCCESS"):
            raise FileNotFoundError(f"batch {batch_id} needs the state in {path}")
        return self.spark.read.parquet(path)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        before = self.previous(batch_id)
        rows = batch.withColumn("__new", F.lit(True))
        if before is not None:
            at = F.struct(*self.order)
            last = before.select(self.key, at.alias("__last"))
            rows = rows.join(last, self.key, "left").where(F.col("__last").isNull() | (at > F.col("__last"))).drop("__last")
            rows = before.withColumn("__new", F.lit(False)).unionByName(rows)
        self.step(rows).where("__new").drop("__new").write.mode("overwrite").parquet(self.output(batch_id))
        newest = dedup_latest(rows.drop("__new"), [self.key], [F.col(c).desc() for c in self.order])
        newest.write.mode("overwrite").parquet(self.state_folder(batch_id))

    def read(self) -> DataFrame:
        """All output written so far."""
        return self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.path}/out")

    def snapshot(self) -> DataFrame:
        """Newest row per key after the last finished batch."""
        return newest_output(self.spark, f"{self.path}/state")


def newest_output(spark: SparkSession, path: str) -> DataFrame:
    """The last finished batch folder ``b=<id>`` below ``path``, found in one listing."""
    hp = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hp.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted((s.getPath().getName() for s in fs.listStatus(hp) if s.getPath().getName().startswith("b=")), reverse=True)
    done = next(n for n in names if exists(spark, f"{path}/{n}/_SUCCESS"))
    return spark.read.parquet(f"{path}/{done}")


def drop_repeats_step(key: str, order: list[str], bucket: Column, cols: list[str]) -> Step:
    return lambda df: feeds.drop_repeats(df, key, order, bucket, cols)


def changes_step(key: str, order: list[str], bucket: Column, cols: list[str]) -> Step:
    return lambda df: feeds.changes(df, key, order, bucket, cols)


def transitions_step(key: str, order: list[str], bucket: Column) -> Step:
    return lambda df: feeds.transitions_live(df, key, order, bucket)


def inning_flips_step(key: str, order: list[str], bucket: Column) -> Step:
    return lambda df: feeds.inning_flips(df, key, order, bucket)


def previous_end_step(key: str, order: list[str], bucket: Column, end: str) -> Step:
    from scorebook.plans.ordered import scan

    return lambda df: scan(df, [key], order, bucket, prev={f"prev_{end}": F.col(end)})


def coalesce_jobs(batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Queued jobs of a drain, the latest per key."""
    return feeds.latest(batch, key, order)


def keyset_sink(spark: SparkSession, path: str, key: str) -> Callable[[DataFrame, int], None]:
    """Write the keys that appeared or disappeared against the previous batch's key set.

    Every batch is a full listing. Listings and changes are kept per batch id.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        keys = batch.select(key).distinct()
        keys.write.mode("overwrite").parquet(f"{path}/keys/b={batch_id:08d}")
        now = spark.read.parquet(f"{path}/keys/b={batch_id:08d}")
        prior = f"{path}/keys/b={batch_id - 1:08d}"
        before = spark.read.parquet(prior) if exists(spark, prior) else now.limit(0)
        key_changes(before, now, key).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{path}/out/b={batch_id:08d}")

    return run


#: Folders of an append-only result series. A key lies in one of them, so that files do not grow with the number of keys.
RESULT_FOLDERS = 32


def _result_folder(key: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(folders)).cast("int")


def append_results(stream: DataFrame, path: str, checkpoint: str, key: str = "game_pk", folders: int = RESULT_FOLDERS):
    """Append-only result series (exactly once, by the file sink's log): the rows of a key lie in one of ``folders`` folders.

    A task writes one file a folder at most, whatever the number of keys, and a hot key is shared by the tasks that read it.
    """
    return (stream.withColumn("folder", _result_folder(F.col(key), folders)).writeStream.format("parquet").outputMode("append").partitionBy("folder")
            .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True))


def read_results(spark: SparkSession, path: str, value: Column | None = None, key: str = "game_pk", folders: int = RESULT_FOLDERS) -> DataFrame:
    """The series written by ``append_results``; with a key's ``value``, of its type, only that key's folder is read."""
    rows = spark.read.parquet(path)
    if value is not None:
        rows = rows.where((F.col("folder") == _result_folder(value, folders)) & F.col(key).eqNullSafe(value))
    return rows.drop("folder")


def poll_metrics_stream(stream: DataFrame, key: str = "game_pk") -> DataFrame:
    """Running counters and response times per game, for update or complete output."""
    failed = F.col("error").isNotNull() & (F.col("error") != "")
    ok = F.when(~failed, F.col("response_ms"))
    return stream.groupBy(key).agg(
        F.count(F.lit(1)).alias("poll_count"), F.count_if(~failed).alias("success_count"),
        F.count_if(failed).alias("error_count"), F.count_if(F.coalesce("changed", F.lit(False))).alias("changed_count"),
        F.coalesce(F.avg(ok), F.lit(0.0)).alias("avg_response_ms"),
        F.coalesce(F.max(ok), F.lit(0.0)).alias("max_response_ms"))


def run_to_end(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Drive a stream through a ``foreachBatch`` sink until its input is used up."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


# --- silence -----------------------------------------------------------------

def with_clock(stream: DataFrame) -> DataFrame:
    """The stream with one all-NULL row a second, so that a micro-batch runs although the source is silent."""
    clock = stream.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load()
    return stream.unionByName(clock.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema.fields]))


@dataclass
class StaleAlerts:
    """``foreachBatch`` sink that reports live keys without a new row for ``seconds``.

    The newest row per key is kept like in :class:`KeyedChanges`; every batch checks all keys
    against the clock, so a key is found although it sends nothing. Feed it ``with_clock(stream)``
    on a processing-time trigger: without the clock a source that stops altogether runs no batch.
    Rows without a key only tick.
    """

    spark: SparkSession
    path: str
    key: str
    ts: str
    seconds: int = 120
    state: str = "abstract_game_state"

    def __call__(self, batch: DataFrame, batch_id: int, now: datetime | None = None) -> None:
        keep = KeyedChanges(self.spark, self.path, self.key, [self.ts], lambda df: df)
        before, batch = keep.previous(batch_id), batch.where(F.col(self.key).isNotNull())
        rows = batch if before is None else before.unionByName(batch)
        dedup_latest(rows, [self.key], [F.col(self.ts).desc()]).write.mode("overwrite").parquet(keep.state_folder(batch_id))
        newest = self.spark.read.parquet(keep.state_folder(batch_id))
        alerts = feeds.stale(newest, now or datetime.now(timezone.utc), self.seconds, self.key, self.state, self.ts)
        alerts.write.mode("overwrite").parquet(keep.output(batch_id))

    def read(self) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.path}/out")
