"""Checks as tables: every check gives one row (check, passed, violations)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from skyledger.functions.numbers import close_to
from skyledger.operators.joins import key_difference
from skyledger.operators.measures import duplicated_keys
from skyledger.operators.skew import with_scalars


def _result(bad: DataFrame, name: str) -> DataFrame:
    n = F.count(F.lit(1))
    return bad.agg(n.alias("violations")).select(
        F.lit(name).alias("check"), (F.col("violations") == 0).alias("passed"), "violations"
    )


def row_checks(df: DataFrame, rows: Mapping[str, Column], values: Mapping[str, tuple[str, int]] | None = None) -> DataFrame:
    """Several checks of one table in one scan, a row each.

    ``rows``: tests that hold on every row, null being a violation. ``values``: a column and the
    number of distinct values it has to have; the violations are the difference.
    """
    values = values or {}
    counts = [F.count_if(~F.coalesce(test, F.lit(False))) for test in rows.values()]
    counts += [F.abs(F.count_distinct(F.col(c)) - n) for c, n in values.values()]
    found = df.agg(F.array(*[F.struct(F.lit(name).alias("check"), n.cast("bigint").alias("violations")) for name, n in zip([*rows, *values], counts)]).alias("_c"))
    return found.select(F.inline("_c")).select("check", (F.col("violations") == 0).alias("passed"), "violations")


def sums_to_one(df: DataFrame, keys: Sequence[str], share: str, name: str) -> DataFrame:
    sums = df.groupBy(*keys).agg(F.sum(share).alias("s"))
    return _result(sums.where(~close_to("s", F.lit(1.0))), name)


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return _result(key_difference(a, b, keys), name)


def covers(big: DataFrame, small: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Every key of the small table occurs in the big one."""
    keys = list(keys)
    return _result(small.select(*keys).distinct().join(big.select(*keys), keys, "left_anti"), name)


def not_null(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    return _result(df.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])), name)


def unique(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return _result(duplicated_keys(df, keys), name)


def same_row_count(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    rows = lambda df, c: df.agg(F.count(F.lit(1)).alias(c))
    gap = with_scalars(rows(a, "m"), rows(b, "n")).select(F.abs(F.col("m") - F.col("n")).alias("violations"))
    return gap.select(F.lit(name).alias("check"), (F.col("violations") == 0).alias("passed"), "violations")


def holds(df: DataFrame, test: Column, name: str) -> DataFrame:
    """The test is true on every row; null counts as a violation."""
    return _result(df.where(~F.coalesce(test, F.lit(False))), name)


def group_size(df: DataFrame, keys: Sequence[str], size: int, name: str) -> DataFrame:
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return _result(sizes.where(F.col("n") != size), name)


def distinct_count(df: DataFrame, column: str, size: int, name: str) -> DataFrame:
    n = F.count_distinct(F.col(column))
    return df.agg(F.abs(n - size).alias("violations")).select(
        F.lit(name).alias("check"), (F.col("violations") == 0).alias("passed"), "violations"
    )


def totals_agree(
    a: DataFrame, b: DataFrame, keys: Sequence[str], left: str, right: str, name: str,
    rtol: float = 1e-5,
) -> DataFrame:
    """Sums per key agree within the tolerance; a key on one side only is a violation."""
    l = a.groupBy(*keys).agg(F.sum(left).alias("l"))
    r = b.groupBy(*keys).agg(F.sum(right).alias("r"))
    both = l.join(r, list(keys), "full_outer")
    return _result(both.where(~close_to("l", "r", rtol=rtol)), name)


def empty(df: DataFrame, name: str) -> DataFrame:
    return _result(df, name)


def report(*checks: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), checks)
