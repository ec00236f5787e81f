"""Shared helpers for the registered query plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double output to ``digits`` places (and turn -0.0 into 0.0),
    so results compare across engines whose float sums run in another order."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append((F.round(F.col(f.name).cast("double"), digits) + F.lit(0.0)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


class Registry:
    """Ordered (name -> spark builder, name -> oracle SQL) pairs."""

    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict = {}

    def add(self, name: str, sql: str | None = None):
        def deco(fn):
            self.queries[name] = fn
            if sql is not None:
                self.oracles[name] = sql
            return fn
        return deco
