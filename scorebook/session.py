"""Session defaults and the shared work folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # HotSpot never compiles a method over 8,000 bytes: a fused stage of wide rows would be interpreted, row by row.
    # Above this its operators run one by one, each in methods that are compiled.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Runtime settings every operator relies on (UTC, AQE, skew join, compiled code)."""
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "scorebook") -> SparkSession:
    """Single-machine session for tests and the bench."""
    return apply_defaults(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        # Recording the Python call site of every Column is slow for wide frames (static setting).
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.parquet.compression.codec", "zstd")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir``; on a local master also a folder below the warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return path or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Let ``DataFrame.checkpoint`` work where the cluster has not named a folder."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


_MADE: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, never used path below the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete one folder that ``fresh_path`` named."""
    _MADE.remove(path)
    hp = spark._jvm.org.apache.hadoop.fs.Path(path)
    hp.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hp, True)


def remove_staged(spark: SparkSession) -> None:
    """Delete what this process staged. Call it when no result is read any more."""
    for path in list(_MADE):
        remove_path(spark, path)
