"""Poll logs and lookup artefacts as JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POLL_SCHEMA = ("ts double, response_ms double, changed boolean, error string, event_type string, mlb_event_ts string, "
               "interval_s double, inning int, inning_half string, inning_transition boolean")


def write_poll_logs(df: DataFrame, path: str) -> None:
    """One folder per date and game, with few files each; a game with very many rows is split."""
    rounded = df.withColumn("response_ms", F.round("response_ms", 1))
    rounded.hint("rebalance", "game_date", "game_pk").write.partitionBy("game_date", "game_pk").option(
        "ignoreNullFields", "false").mode("append").json(path)


def read_poll_logs(spark: SparkSession, path: str, schema: str = POLL_SCHEMA) -> DataFrame:
    """Log lines of the ``game_date=<date>/game_pk=<game>/`` layout; filters on either skip whole folders."""
    return spark.read.schema(f"{schema}, game_date string, game_pk long").json(path)


def read_flat_poll_logs(spark: SparkSession, path: str, schema: str = POLL_SCHEMA) -> DataFrame:
    """Log lines of the ``<date>/<game>.jsonl`` layout, with date and game taken from the path.

    Give ``path`` the folder of a date to read only that one.
    """
    raw = spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)
    name = F.input_file_name()
    return raw.withColumns({
        "game_date": F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})/", 1),
        "game_pk": F.regexp_extract(name, r"/(\d+)\.jsonl", 1).try_cast("long"),
    })


def write_lookup(df: DataFrame, path: str, metadata: dict) -> None:
    """Lookup rows as JSON lines, with a one-row description next to them."""
    spark = df.sparkSession
    df.write.mode("errorifexists").json(f"{path}/table")
    facts = spark.read.json(f"{path}/table").agg(F.count(F.lit(1)).alias("n_rows")).withColumns(
        {k: F.lit(v) for k, v in metadata.items()}).withColumn("built_at", F.current_timestamp())
    facts.write.mode("errorifexists").json(f"{path}/metadata")


def read_lookup(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(schema).json(f"{path}/table"), spark.read.json(f"{path}/metadata")
