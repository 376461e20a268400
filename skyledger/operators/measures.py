"""Group measures: shares, weighted sums, de-duplicated sums, audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyledger.functions.numbers import ratio
from skyledger.operators.ranking import first_per_group
from skyledger.operators.skew import attach_scalar, attach_totals


def group_sums(df: DataFrame, keys: Sequence[str], **sums: str) -> DataFrame:
    """Named sums; null keys are dropped and an all-null sum is zero."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(name) for name, c in sums.items()]
    )


def share_of_group(
    df: DataFrame, keys: Sequence[str], measure: str, share: str, total: str | None = None
) -> DataFrame:
    """Measure over the group's sum, on rows of any number per group."""
    name = total or "_total"
    out = attach_totals(df, keys, **{name: F.sum(measure)}).withColumn(
        share, ratio(measure, name)
    )
    return out if total else out.drop(name)


def share_of_aggregate(
    df: DataFrame, keys: Sequence[str], measure: str, share: str, total: str
) -> DataFrame:
    """Measure over the group's sum, for rows that are already aggregated.

    Use it where a group has at most one row per entry of a fixed code list (an
    aircraft, a brand): the window then holds no more rows than the list.
    """
    w = Window.partitionBy(*keys)
    return df.withColumn(total, F.sum(measure).over(w)).withColumn(share, ratio(measure, total))


def share_of_total(df: DataFrame, measure: str, share: str) -> DataFrame:
    return attach_scalar(df, _total=F.sum(measure)).withColumn(
        share, ratio(measure, "_total")
    ).drop("_total")


def reshare(df: DataFrame, keys: Sequence[str], share: str, total: str, ops: str) -> DataFrame:
    """Scale shares to sum to one again, then recompute operations from them."""
    return share_of_group(df.withColumnRenamed(share, "_old"), keys, "_old", share).drop(
        "_old"
    ).withColumn(ops, F.col(share) * F.col(total))


def redistribute(
    df: DataFrame, keys: Sequence[str], keep: Column, share: str, ops: str, sketch_of: DataFrame | None = None,
) -> DataFrame:
    """Drop rows and hand their operations to the rest in proportion to the share.

    Adds ``ops_fleet_adj`` (share x lost + own), ``fleetmix_adj`` (its share of
    the group) and ``lost_ops``.
    """
    marked = df.withColumn("_keep", F.coalesce(keep, F.lit(False)))
    lost = F.coalesce(F.sum(F.when(~F.col("_keep"), F.col(ops))), F.lit(0.0))
    mix = F.sum(F.when(F.col("_keep"), F.col(share)))
    kept = F.sum(F.when(F.col("_keep"), F.col(ops)))
    with_sums = attach_totals(marked, keys, sketch_of=sketch_of, lost_ops=lost, _mix=mix, _kept=kept)
    adjusted = F.col(share) * F.col("lost_ops") + F.col(ops)
    whole = F.col("_mix") * F.col("lost_ops") + F.col("_kept")
    return with_sums.where("_keep").withColumn("ops_fleet_adj", adjusted).withColumn(
        "fleetmix_adj", F.try_divide(F.col("ops_fleet_adj"), whole)
    ).drop("_keep", "_mix", "_kept")


def group_count(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """Number of non-null values in the group, on every row."""
    return attach_totals(df, keys, **{name: F.count(column)})


def group_min(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    return attach_totals(df, keys, **{name: F.min(column)})


def weighted_totals(
    df: DataFrame, keys: Sequence[str], rates: Mapping[str, str], weight: str
) -> DataFrame:
    """Sum of rate x weight for each rate, ``{output: rate column}``, in one pass."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.col(r) * F.col(weight)), F.lit(0.0)).alias(n) for n, r in rates.items()]
    )


def intensity(df: DataFrame, amount: str, volume: str, name: str) -> DataFrame:
    return df.withColumn(name, ratio(amount, volume))


def sliced_sum(df: DataFrame, keys: Sequence[str], slice_: Column, measure: str, name: str) -> DataFrame:
    """Sum of a measure that repeats on many rows: only one slice of the rows counts."""
    return group_sums(df.where(slice_), keys, **{name: measure})


def unit_sum(
    df: DataFrame, keys: Sequence[str], unit: Sequence[str], order: Sequence[Column],
    measure: str, name: str,
) -> DataFrame:
    """Sum of a measure that repeats within a unit: each unit counts once."""
    return group_sums(first_per_group(df, unit, order), keys, **{name: measure})


def scale_to_total(
    df: DataFrame, keys: Sequence[str], part: str, total: str, out: str
) -> DataFrame:
    """Scale parts so that they add up to the group's stated total."""
    return attach_totals(df, keys, _sum=F.sum(part)).withColumn(
        out, F.col(part) * ratio(total, "_sum")
    ).drop("_sum")


def loss_audit(before: DataFrame, after: DataFrame, keys: Sequence[str], measure: str) -> DataFrame:
    """What a step lost, per group: before, after, lost and percent lost."""
    b = group_sums(before, keys, before=measure)
    a = group_sums(after, keys, after=measure)
    lost = F.col("before") - F.col("after")
    return b.join(a, list(keys), "full_outer").withColumns(
        {"lost": lost, "percent_lost": ratio(lost * 100, "before")}
    )


def first_known(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], **sums: str
) -> DataFrame:
    """Per column the first non-null value in the order, and named sums, in one
    pass of partial aggregates."""
    at = F.struct(*order)
    firsts = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns]
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(
        *firsts, *[F.coalesce(F.sum(c), F.lit(0.0)).alias(n) for n, c in sums.items()]
    )


def any_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Columns of the row that is first in the order, one row per key."""
    row = F.min_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(*keys).agg(row.alias("_r")).select(*keys, "_r.*")


def distinct_values(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """Sorted distinct values per key. Duplicates go before the values are gathered,
    so an array is as long as the column's vocabulary, however many rows the key has."""
    return (
        df.select(*keys, column).where(F.col(column).isNotNull()).distinct()
        .groupBy(*keys).agg(F.array_sort(F.collect_list(column)).alias(name))
    )


def list_vocabulary(df: DataFrame, column: str, sep: str, name: str) -> DataFrame:
    """Distinct entries of a column of separated lists."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().select(
        F.explode(F.split(column, sep)).alias(name)
    ).distinct()


def value_counts(df: DataFrame, column: str, name: str = "count") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(name)).orderBy(column)


def duplicated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def split_duplicates(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of unique keys, rows of repeated keys)."""
    counted = attach_totals(df, keys, _n=F.count(F.lit(1)))
    return counted.where("_n = 1").drop("_n"), counted.where("_n > 1").drop("_n")
