"""Functions as users declare them: SQL scalar and table functions, strictness, window functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession, WindowSpec
from pyspark.sql import functions as F

from tablespec.operators.constraints import all_of


def sql_function(spark: SparkSession, name: str, args: str, returns: str, body: str) -> None:
    """A temporary scalar SQL function; the body may hold a correlated subquery over a view."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")


def table_function(spark: SparkSession, name: str, args: str, columns: str, body: str) -> None:
    """A temporary SQL function that returns a table."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS TABLE({columns}) RETURN {body}")


def strict(fn: Callable[..., Column]) -> Callable[..., Column]:
    """The function, giving null if any argument is null."""

    def run(*args: Column) -> Column:
        return F.when(all_of([a.isNotNull() for a in args]), fn(*args))

    return run


def volatile(udf):
    """Marks a user function as not deterministic, so that it is not folded or repeated."""
    return udf.asNondeterministic()


def window_function(fn: Callable[[pd.Series], float], returns: str, col: str, window: WindowSpec) -> Column:
    """A user aggregate over a window frame, batched by Arrow."""

    def run(values: pd.Series) -> float:
        return fn(values)

    run.__annotations__ = {"values": pd.Series, "return": float}
    return F.pandas_udf(run, returns)(F.col(col)).over(window)
