"""Expectations as a table: one row per check with the number of violations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


class Expect:
    """Collects checks on DataFrames; `result` is (check, n_violations)."""

    def __init__(self) -> None:
        self.parts: list[DataFrame] = []

    def _add(self, name: str, counted: DataFrame) -> "Expect":
        self.parts.append(counted.select(F.lit(name).alias("check"), F.col("n").cast("long").alias("n_violations")))
        return self

    def required(self, df: DataFrame, cols: Sequence[str], name: str = "required") -> "Expect":
        """Rows where any of the columns is NULL."""
        bad = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
        return self._add(name, df.agg(F.count_if(bad).alias("n")))

    def unique(self, df: DataFrame, key: Sequence[str], name: str = "unique") -> "Expect":
        """Keys that occur more than once."""
        return self._add(name, df.groupBy(*key).agg(F.count("*").alias("c")).where("c > 1")
                         .agg(F.count("*").alias("n")))

    def allowed(self, df: DataFrame, col: str, values: Sequence, name: str = "allowed") -> "Expect":
        return self.holds(df, F.col(col).isin(list(values)), name)

    def holds(self, df: DataFrame, condition: Column, name: str) -> "Expect":
        """Rows for which the condition is not true; NULL counts as not true."""
        return self._add(name, df.agg(F.count_if(~F.coalesce(condition, F.lit(False))).alias("n")))

    def between(self, df: DataFrame, col: str, low, high, name: str = "range") -> "Expect":
        return self.holds(df, F.col(col).between(low, high), name)

    def row_count(self, df: DataFrame, expected: int, name: str = "row_count") -> "Expect":
        """1 if the table does not have exactly the expected number of rows."""
        return self._add(name, df.agg((F.count("*") != expected).cast("int").alias("n")))

    def contained(self, df: DataFrame, other: DataFrame, key: str, name: str = "contained") -> "Expect":
        """Distinct keys without a partner in the other table."""
        missing = df.select(key).distinct().join(other.select(key).distinct(), key, "left_anti")
        return self._add(name, missing.agg(F.count("*").alias("n")))

    def result(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)
