"""Reshaping: pivots, unpivots, year series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skyledger.operators.skew import attach_totals
from skyledger.session import settle


def conditional_pivot(
    df: DataFrame,
    keys: Sequence[str],
    category: str,
    columns: Mapping[str, str],
    measure: str,
    factor: float = 1.0,
    total: str | None = None,
) -> DataFrame:
    """One sum per listed category in a single pass, and their total.

    ``columns`` maps a category value to the output column.
    """
    sums = [
        (F.sum(F.when(F.col(category) == value, F.col(measure)).otherwise(0.0)) * factor).alias(name)
        for value, name in columns.items()
    ]
    out = df.groupBy(*keys).agg(*sums)
    if total:
        whole = F.lit(0.0)
        for name in columns.values():
            whole = whole + F.col(name)
        out = out.withColumn(total, whole)
    return out


def pivot_unique(
    df: DataFrame, keys: Sequence[str], category: str, values: Sequence[str], measure: str
) -> DataFrame:
    """Long to wide with a fixed column order; a repeated (key, category) is an error."""
    cells = []
    for v in values:
        cell = F.when(F.col(category) == v, F.col(measure))
        seen = F.count_if(F.col(category) == v)
        cells.append(
            F.when(seen > 1, F.raise_error(F.lit(f"repeated key for {v}")).cast("double"))
            .otherwise(F.max(cell)).alias(v)
        )
    return df.groupBy(*keys).agg(*cells)


def two_grain(
    df: DataFrame, fine: Sequence[str], coarse: Sequence[str], sums: Mapping[str, str]
) -> tuple[DataFrame, DataFrame]:
    """(coarse, fine) sums; the coarse table is made from the fine one.

    Rows with a null fine key count in the coarse table only.
    """
    every = settle(df.groupBy(*fine).agg(*[F.sum(c).alias(n) for n, c in sums.items()]))
    top = every.groupBy(*coarse).agg(*[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in sums])
    bottom = every.dropna(subset=list(fine)).withColumns(
        {n: F.coalesce(F.col(n), F.lit(0.0)) for n in sums}
    )
    return top.dropna(subset=list(coarse)), bottom


def unpivot(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str
) -> DataFrame:
    """Wide to long, dropping empty cells."""
    long = df.unpivot(list(ids), list(columns), name, value)
    return long.where(F.col(value).isNotNull())


def unpivot_records(
    df: DataFrame, ids: Sequence[str], name: str, records: Mapping[str, Mapping[str, Column | str]]
) -> DataFrame:
    """Wide to long with several measures per class.

    ``records`` maps a class label to ``{measure: source column}``.
    """
    def field(c):
        return F.col(c) if isinstance(c, str) else c

    rows = F.array(*[
        F.struct(
            F.lit(label).alias(name),
            *[field(c).cast("double").alias(m) for m, c in measures.items()],
        )
        for label, measures in records.items()
    ])
    return df.select(*ids, F.explode(rows).alias("_r")).select(*ids, "_r.*")


def over_years(df: DataFrame, first: int, last: int, year: str) -> DataFrame:
    """One row per input row and year of the range."""
    return df.withColumn(year, F.explode(F.sequence(F.lit(first), F.lit(last))))


def extend_series(df: DataFrame, key: str, year: str, end: int, last: int) -> DataFrame:
    """Carry the value of year ``end`` forward to ``last``.

    A key that already has a later year is left alone; otherwise years after
    ``end`` cannot occur, so only the ``end`` row is repeated.
    """
    seen = attach_totals(df, [key], split=False, _last=F.max(year))
    years = F.when(
        (F.col("_last") <= end) & (F.col(year) == end), F.sequence(F.lit(end), F.lit(last))
    ).otherwise(F.array(F.col(year).cast("int")))
    return seen.withColumn(year, F.explode(years)).drop("_last")


def fill_gaps(
    df: DataFrame,
    keys: Sequence[str],
    year: str,
    first: int,
    last: int,
    value: str,
    fill: float,
    only: Column | None = None,
) -> DataFrame:
    """Add the missing years of a range with a constant; ``only`` limits the keys.

    Columns other than the keys, the year and the value are null in added rows.
    """
    wanted = df.where(only) if only is not None else df
    grid = over_years(wanted.select(*keys).distinct(), first, last, year)
    missing = grid.join(df.select(*keys, year), [*keys, year], "left_anti")
    return df.unionByName(missing.withColumn(value, F.lit(fill)), allowMissingColumns=True)


def with_series(df: DataFrame, series: DataFrame, first: int, last: int, year: str) -> DataFrame:
    """Give every row the whole national series.

    The rows are spread over the literal year range and each year looks up its
    value; the series is reduced to that range, one row per year, so its size is
    fixed by the range. A year that the series lacks has null values.
    """
    values = [c for c in series.columns if c != year]
    bounded = series.where(F.col(year).between(first, last)).groupBy(
        F.col(year).cast("int").alias(year)
    ).agg(*[F.max(c).alias(c) for c in values])
    return over_years(df, first, last, year).join(F.broadcast(bounded), year, "left")
