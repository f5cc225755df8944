"""The registry of queries: functions of named inputs, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import load, with_inputs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _rounded(df: DataFrame, digits: int) -> DataFrame:
    return df.select(*((F.round(F.col(c), digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(inputs: str, sql: str | None = None, digits: int = 4) -> Callable:
    """Registers a function of the named inputs; sql sees them as tables, and gets its doubles rounded as well."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: _rounded(f(*(load(spark, sf_dir, n) for n in inputs.split())), digits)
        if sql:
            ORACLES[f.__name__] = with_inputs(inputs, sql)
        return f

    return register
