"""Registration of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def shift(digits: int) -> str:
    """Added before rounding, so that means that end exactly in a half are rounded alike by both engines."""
    return f"{3.7 * 10.0 ** -(digits + 4):.2e}"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for the comparison only: two engines add in different orders.

    ``round`` makes a decimal of every value. Up to 42 bits of digits a value is rounded as a whole number instead,
    which is compiled arithmetic and gives the same unless it lies near a half; those, larger ones, NaN and infinity
    are left to ``round``.
    """
    p = 10 ** digits

    def near(name: str) -> str:
        v = f"{name} + {shift(digits)}D"
        scaled = f"(abs({v}) * {p}D)"
        whole = f"floor({scaled} + 0.5D)"
        return (f"CASE WHEN {scaled} < {1 << 42}D AND abs({scaled} - {whole}) < 0.498D THEN signum({v}) * {whole} / {p}D "
                f"ELSE round({v}, {digits}) END + 0D AS {name}")

    return df.selectExpr(*[near(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else f.name for f in df.schema.fields])


def rounded_sql(sql: str, doubles: str | list[str], digits: int = 6) -> str:
    names = doubles.split() if isinstance(doubles, str) else doubles
    repl = ", ".join(f"round(CAST({n} AS DOUBLE) + {shift(digits)}::DOUBLE, {digits}) + 0.0 AS {n}" for n in names)
    return f"SELECT * REPLACE ({repl}) FROM ({sql})"


def query(name: str, sql: str | None = None, doubles: str | list[str] = (), digits: int = 6):
    """Register a query; ``doubles`` names the DOUBLE columns of its SQL that are rounded."""
    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = (lambda spark, sf: rounded(fn(spark, sf), digits)) if doubles else fn
        if sql is not None:
            ORACLE[name] = rounded_sql(sql, doubles, digits) if doubles else sql
        return fn

    return wrap
