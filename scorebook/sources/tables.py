"""Table lifecycle on plain Parquet: versions, increments, upserts, drift and compaction."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorebook import constants as K
from scorebook.operators.windows import dedup_latest
from scorebook.session import fresh_path


def _fs(spark: SparkSession, path: str):
    hp = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hp.getFileSystem(spark._jsc.hadoopConfiguration()), hp


def exists(spark: SparkSession, path: str) -> bool:
    fs, hp = _fs(spark, path)
    return fs.exists(hp)


def data_files(spark: SparkSession, path: str) -> tuple[int, int]:
    """Number and bytes of the Parquet files below a path (two numbers, from the file system)."""
    fs, hp = _fs(spark, path)
    it, n, size = fs.listFiles(hp, True), 0, 0
    while it.hasNext():
        f = it.next()
        if f.getPath().getName().endswith(".parquet"):
            n, size = n + 1, size + f.getLen()
    return n, size


@dataclass
class VersionedTable:
    """A table whose every write is a new folder ``v=<n>``; a folder with ``_SUCCESS`` is complete.

    Readers keep the version they opened, a failed write is never seen, and a second writer of
    the same version fails instead of overwriting.
    """

    spark: SparkSession
    path: str

    def version(self) -> int:
        fs, hp = _fs(self.spark, self.path)
        if not fs.exists(hp):
            return 0
        done = [0]
        for s in fs.listStatus(hp):
            name = s.getPath().getName()
            if name.startswith("v=") and exists(self.spark, f"{self.path}/{name}/_SUCCESS"):
                done.append(int(name[2:]))
        return max(done)

    def folder(self, version: int) -> str:
        return f"{self.path}/v={version:08d}"

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.folder(self.version()))

    def write(self, df: DataFrame, partition_by: list[str] = ()) -> int:
        version = self.version() + 1
        df.write.mode("errorifexists").partitionBy(*partition_by).parquet(self.folder(version))
        return version


def materialize(df: DataFrame, table: VersionedTable, full_refresh: bool = True) -> DataFrame:
    """Rebuild a table, or create it only where it does not exist yet."""
    if full_refresh or table.version() == 0:
        table.write(df)
    return table.read()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Several consumers then read only their columns of one finished table, and a lost executor
    costs a re-read, not the work behind it.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


# --- increments --------------------------------------------------------------

def new_by_key(src: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Rows whose key the target does not hold. Late keys of any date are accepted."""
    return src.join(target.select(key).distinct(), key, "left_anti")


def new_by_date(src: DataFrame, target: DataFrame, col: str = "game_date") -> DataFrame:
    """Rows above the target's latest date. Late rows on or before that date are skipped."""
    top = target.agg(F.max(col)).scalar()
    return src.where(top.isNull() | (F.col(col) > top))


def chunk(df: DataFrame, start: str, end: str, col: str = "game_date") -> DataFrame:
    return df.where(F.col(col).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def restrict_keys(df: DataFrame, keys: DataFrame, key: str = "game_pk") -> DataFrame:
    """Rows of the listed keys."""
    return df.join(keys.select(key), key, "left_semi")


#: Keys that are looked up one by one; more are looked up by ranges.
LISTED_KEYS = 1000
KEY_RANGES = 64
#: Values of one IN list that Spark hands to the Parquet reader as they are (its default); longer lists become their span.
IN_LIST = 10


def write_by_key(df: DataFrame, path: str, key: str = "game_pk", distinct_keys: int = 100_000, row_group_bytes: int | None = None) -> None:
    """A table laid out for look-ups: files and row groups are ranges of the key and carry Bloom filters of it."""
    writer = df.repartitionByRange(key).sortWithinPartitions(key).write.mode("errorifexists")
    writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", distinct_keys)
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    writer.parquet(path)


def read_keys(spark: SparkSession, path: str, keys: DataFrame, key: str = "game_pk", listed: int = LISTED_KEYS) -> DataFrame:
    """Rows of the listed keys of a table made by ``write_by_key``; files and row groups without any are not read.

    Up to ``listed`` keys reach the reader as lists of ten, which it checks against spans and Bloom filters. More
    keys are cut into ``KEY_RANGES`` ranges; the reader skips what lies between these, and a join takes the rest.
    """
    wanted = keys.select(key).where(F.col(key).isNotNull()).distinct()
    some = sorted(r[0] for r in wanted.limit(listed + 1).collect())
    table = spark.read.parquet(path)
    if not some:
        return table.limit(0)
    if len(some) <= listed:
        return table.where(_any([F.col(key).isin(some[i : i + IN_LIST]) for i in range(0, len(some), IN_LIST)]))
    shares = F.array(*[F.lit(i / KEY_RANGES) for i in range(1, KEY_RANGES)])
    cuts = wanted.agg(F.percentile_approx(key, shares, 1000)).first()[0]
    slot = F.size(F.filter(F.lit(cuts), lambda c: c < F.col(key)))
    spans = wanted.groupBy(slot.alias("slot")).agg(F.min(key).alias("lo"), F.max(key).alias("hi")).collect()
    return table.where(_any([F.col(key).between(r.lo, r.hi) for r in spans])).join(wanted, key, "left_semi")


def _any(conditions: list[Column]) -> Column:
    """Joined by OR as a balanced tree, so that many of them do not nest deeply."""
    while len(conditions) > 1:
        conditions = [a | b for a, b in zip(conditions[::2], conditions[1::2])] + (conditions[-1:] if len(conditions) % 2 else [])
    return conditions[0]


def delete_insert(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Target without the keys present in ``new``, plus ``new``."""
    kept = target.join(new.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(new)


def upsert(table: VersionedTable, new: DataFrame, keys: list[str]) -> DataFrame:
    table.write(delete_insert(table.read(), new, keys) if table.version() else new)
    return table.read()


def upsert_partitions(spark: SparkSession, path: str, new: DataFrame, keys: list[str], partition_by: list[str]) -> DataFrame:
    """Upsert that rewrites only the partitions ``new`` touches.

    The key must determine the partition. The merged partitions are written to the shared folder
    first, so the overwrite never reads what it replaces and can be repeated after a failure.
    """
    if not exists(spark, path):
        new.write.partitionBy(*partition_by).parquet(path)
        return spark.read.parquet(path)
    touched = new.select(*partition_by).distinct()
    old = spark.read.parquet(path).join(touched, partition_by, "left_semi")
    stage = fresh_path(spark, "upsert")
    delete_insert(old, new.select(*old.columns), keys).write.parquet(stage)
    # Rebalancing gathers each partition's rows into few files and splits a partition that is too big.
    spark.read.parquet(stage).hint("rebalance", *partition_by).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
    return spark.read.parquet(path)


def upsert_latest(target: DataFrame, new: DataFrame, key: list[str], ts: str) -> DataFrame:
    """Dimension rows after the upsert, the last write winning; a tie goes to the new row."""
    both = target.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return dedup_latest(both, key, [F.col(ts).desc(), F.col("__new").desc()]).drop("__new")


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


# --- ledger and pending work -------------------------------------------------

def record_keys(df: DataFrame, path: str, key: str = "game_pk", at: Column | None = None) -> None:
    """Append extracted keys with their time; the ledger is created by the first call."""
    df.select(key).distinct().withColumn("extracted_at", F.current_timestamp() if at is None else at) \
        .write.mode("append").parquet(path)


def pending_keys(games: DataFrame, done: DataFrame, game_types: list[str] | None = None, limit: int | None = None,
                 key: str = "game_pk") -> DataFrame:
    """Finished games not processed yet, oldest first."""
    df = games.where((F.col("abstract_game_state") == "Final") & ~F.col("status").isin(K.DEAD_STATUSES))
    if game_types:
        df = df.where(F.col("game_type").isin(game_types))
    df = df.join(done.select(key).distinct(), key, "left_anti").select(key, "game_date").orderBy("game_date", key)
    return df.limit(limit) if limit is not None else df


def refetch_dates(games: DataFrame, asof, days: int = 3) -> DataFrame:
    """Recent dates that still hold games without a final state."""
    today = F.lit(asof).cast("date")
    return games.where(F.col("abstract_game_state").isNotNull() & (F.col("abstract_game_state") != "Final")
                       & (F.col("game_date") <= today) & (F.col("game_date") >= F.date_sub(today, days))
                       ).select("game_date").distinct()


def next_date(games: DataFrame) -> DataFrame:
    """Start of the forward scan: the day after the latest known one."""
    return games.agg(F.date_add(F.max("game_date"), 1).alias("start_date"))


# --- schema drift ------------------------------------------------------------

def schema_drift(df: DataFrame, table: DataFrame, policy: str = "fail") -> tuple[list[str], list[str], str]:
    """(added, removed, action): names only, as types are cast on write.

    ``fail`` asks for a rebuild on any difference, ``append`` accepts new columns.
    """
    added = sorted(set(df.columns) - set(table.columns))
    removed = sorted(set(table.columns) - set(df.columns))
    if not added and not removed:
        return added, removed, "none"
    if policy == "append" and not removed:
        return added, removed, "append"
    return added, removed, "rebuild"


# --- file maintenance --------------------------------------------------------

MIN_FILES = 50
SMALL_BYTES = 16 * 1024 * 1024
TARGET_BYTES = 256 * 1024 * 1024


def list_files(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """(table, path, length) of the files below ``path``; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option(
        "recursiveFileLookup", "true").load(path).select("path", "length")
    return files.withColumn("table", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))


def fragmented(files: DataFrame, min_files: int = MIN_FILES, small: int = SMALL_BYTES) -> DataFrame:
    """Tables of many small files, the most files first."""
    return files.groupBy("table").agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("total_bytes")).where(
        (F.col("n_files") >= min_files) & (F.col("total_bytes") < F.col("n_files") * small)
    ).orderBy(F.col("n_files").desc(), "table")


#: Small files of one batch, which is committed as a whole.
BATCH_FILES = 1000


def first_fit(lengths: list[int], target: int) -> list[int]:
    """Bin of every length: the first with room for it, in the order given; one that is as long as ``target`` fills a bin."""
    import numpy as np

    room, n, out = np.full(max(1, len(lengths)), target, np.int64), 0, []
    for x in lengths:
        fits = np.flatnonzero(room[:n] >= x)
        at = int(fits[0]) if len(fits) else n
        n = max(n, at + 1)
        room[at] -= x
        out.append(at)
    return out


def compaction_plan(files: DataFrame, target_bytes: int = TARGET_BYTES, batch_files: int = BATCH_FILES) -> DataFrame:
    """table, batch, bin, path, length: which small files become one file of at most ``target_bytes``, and which of these are one batch.

    Files are packed first-fit, the longest first; a file that fills half a target or more, or that finds no
    other, stays as it is and is not in the plan. A batch takes bins until it has ``batch_files`` files.
    """
    small = files.where(F.col("length") * 2 < target_bytes).select("table", "path", "length")

    def packed(key, rows):
        rows = rows.sort_values(["length", "path"], ascending=[False, True]).reset_index(drop=True)
        rows["bin"] = first_fit(rows["length"].tolist(), target_bytes)
        sizes = rows.groupby("bin")["path"].transform("size")
        rows = rows[sizes > 1]
        per = rows.groupby("bin")["path"].size()
        batch, have, of = 0, 0, {}
        for b, n in per.items():
            if have and have + n > batch_files:
                batch, have = batch + 1, 0
            of[b], have = batch, have + n
        return rows.assign(batch=rows["bin"].map(of).astype("int64"))[["table", "batch", "bin", "path", "length"]]

    return small.groupBy("table").applyInPandas(packed, "table string, batch long, bin long, path string, length long")  # a listing, not the data


def run_compaction(spark: SparkSession, src: str, dst: str, target_bytes: int = TARGET_BYTES, batch_files: int = BATCH_FILES, most_batches: int | None = None) -> DataFrame:
    """Packs the small files of the table at ``src`` into new ones below ``dst``; returns counts before and after.

    The plan is written first, then batch by batch: each is one job, a task and a file a bin, and counts once its
    own ``_SUCCESS`` exists. A run that was stopped is taken up by the next call, which does only what is
    missing, by the plan that is there. ``src`` is not changed; ``compacted`` reads the result.
    """
    plan_path = f"{dst}/plan"
    if not exists(spark, f"{plan_path}/_SUCCESS"):
        compaction_plan(list_files(spark, src).withColumn("table", F.lit(src)), target_bytes, batch_files).write.mode("overwrite").parquet(plan_path)
    plan = spark.read.parquet(plan_path)
    schema = spark.read.parquet(src).schema
    batches = [r.batch for r in plan.select("batch").distinct().orderBy("batch").collect()]
    missing = [b for b in batches if not exists(spark, f"{dst}/batches/b={b:06d}/_SUCCESS")]
    for b in missing[:most_batches]:
        bins = plan.where(F.col("batch") == b).groupBy("bin").agg(F.collect_list("path").alias("paths")).orderBy("bin").collect()
        parts = [spark.read.schema(schema).parquet(*r.paths).coalesce(1) for r in bins]
        while len(parts) > 1:
            parts = [x.union(y) for x, y in zip(parts[::2], parts[1::2])] + (parts[-1:] if len(parts) % 2 else [])
        parts[0].write.mode("overwrite").parquet(f"{dst}/batches/b={b:06d}")
    n, size = data_files(spark, src)
    packed = plan.agg(F.count(F.lit(1)).alias("files"), F.countDistinct("bin").alias("bins")).first()
    return spark.createDataFrame([(n, size, n - packed.files + packed.bins, len(batches), len(missing) - len(missing[:most_batches]))],
                                 "files_before long, bytes_before long, files_after long, batches long, batches_left long")


def compacted(spark: SparkSession, src: str, dst: str) -> DataFrame:
    """The table after ``run_compaction``: the new files and those that stayed. An unfinished compaction is an error."""
    plan, schema = spark.read.parquet(f"{dst}/plan"), spark.read.parquet(src).schema
    batches = [r.batch for r in plan.select("batch").distinct().collect()]
    left = [b for b in batches if not exists(spark, f"{dst}/batches/b={b:06d}/_SUCCESS")]
    if left:
        raise ValueError(f"{len(left)} of {len(batches)} batches are missing in {dst}")
    stay = [r.path for r in list_files(spark, src).join(plan, "path", "left_anti").collect()]
    out = [spark.read.schema(schema).parquet(*stay)] if stay else []
    out += [spark.read.schema(schema).parquet(*[f"{dst}/batches/b={b:06d}" for b in sorted(batches)])] if batches else []
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def compact(spark: SparkSession, src: str, dst: str, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Rewrite small files into files of about ``target_bytes``; returns counts before and after.

    Whole files are packed into read splits of the target size, so each task writes one file and
    no row is shuffled.
    """
    n, size = data_files(spark, src)
    names = {"spark.sql.files.maxPartitionBytes": str(target_bytes), "spark.sql.files.openCostInBytes": "0",
             "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        spark.read.parquet(src).write.mode("errorifexists").parquet(dst)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    m, after = data_files(spark, dst)
    want = max(1, math.ceil(size / target_bytes))
    return spark.createDataFrame([(n, size, m, after, want)],
                                 "files_before long, bytes_before long, files_after long, bytes_after long, target_files long")
