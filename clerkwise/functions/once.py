"""Evaluate expensive expressions once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, columns: dict[str, Column], apart: bool = False) -> DataFrame:
    """``withColumns`` for expensive expressions that later filters refer to.

    A filter on a projected column is pushed below the projection with the
    expression copied into it, so regexes and keyword tests would run twice, and
    chains of such columns grow without bound. A one-element explode stays in
    the same generated stage, moves no data, and is not crossed by filters.

    A higher-order function among the expressions keeps the explode from being compiled, and all of them are then
    interpreted for each row. With ``apart`` they stand in a projection below it, which is compiled all the same.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    made = F.struct(*[expr.alias(name) for name, expr in columns.items()])
    if apart:
        df, made = df.select(*kept, made.alias("__made")), F.col("__made")
    out = df.select(*kept, F.explode(F.array(made)).alias("__once"))
    return out.select(*kept, *[F.col(f"__once.{name}").alias(name) for name in columns])
