"""Borrowing: find a donor for rows without data and copy the donor's rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from skyledger.operators.ranking import with_cuts
from skyledger.operators.skew import split_join, with_scalars
from skyledger.session import settle


def nearest_value(
    needy: DataFrame, donors: DataFrame, group: str, metric: str, donor_key: str,
    sketch_of: DataFrame | None = None,
) -> DataFrame:
    """Give every needy row the donor of its group whose metric is nearest.

    Ties go to the lowest donor id. Adds ``donor_id``, ``ops_diff`` and
    ``ops_per_diff`` (percent of the row's own metric); all null where the group
    has no donor. No needy/donor pairs are formed: distinct metric values are laid
    on a line cut into slices, each value sees its neighbours inside the slice,
    and the slice table supplies the neighbours beyond its ends.
    """
    line = (
        donors.where(F.col(metric).isNotNull())
        .groupBy(group, metric).agg(F.min(donor_key).alias("_donor"))
        .unionByName(
            needy.select(group, metric).distinct().where(F.col(metric).isNotNull()),
            allowMissingColumns=True,
        )
    )
    value = F.col(metric).cast("double")
    line = with_cuts(line, _cuts=value).withColumn("_slice", F.size(F.filter("_cuts", lambda p: p < value))).drop("_cuts")
    # One row per group and metric value; four steps below read it.
    line = settle(line)
    spot = F.when(F.col("_donor").isNotNull(), F.struct(F.col(metric).alias("m"), F.col("_donor").alias("d")))

    slot = Window.partitionBy(group, "_slice")
    reach = (Window.unboundedPreceding, Window.currentRow)
    seen = line.withColumns({
        "_lo": F.last(spot, ignorenulls=True).over(slot.orderBy(metric).rangeBetween(*reach)),
        "_hi": F.last(spot, ignorenulls=True).over(
            slot.orderBy(F.col(metric).desc()).rangeBetween(*reach)
        ),
    }).where(F.col("_donor").isNull()).drop("_donor")

    # One row per group and slice, a fixed largest number per group.
    ends = line.groupBy(group, "_slice").agg(F.max(spot).alias("_top"), F.min(spot).alias("_bottom"))
    rows = (Window.unboundedPreceding, -1)
    by_group = Window.partitionBy(group)
    ends = ends.select(
        group, "_slice",
        F.last("_top", ignorenulls=True).over(by_group.orderBy("_slice").rowsBetween(*rows)).alias("_below"),
        F.last("_bottom", ignorenulls=True).over(
            by_group.orderBy(F.col("_slice").desc()).rowsBetween(*rows)
        ).alias("_above"),
    )
    lo, hi = F.coalesce("_lo", "_below"), F.coalesce("_hi", "_above")
    gap_lo, gap_hi = F.abs(F.col(metric) - lo["m"]), F.abs(F.col(metric) - hi["m"])
    take_lo = hi.isNull() | (gap_lo < gap_hi) | ((gap_lo == gap_hi) & (lo["d"] <= hi["d"]))
    chosen = seen.join(ends, [group, "_slice"], "left").select(
        group, metric,
        F.when(take_lo, lo["d"]).otherwise(hi["d"]).alias("donor_id"),
        F.when(take_lo, gap_lo).otherwise(gap_hi).alias("ops_diff"),
    )
    return split_join(needy, chosen, [group, metric], "left", sketch_of).withColumn(
        "ops_per_diff", F.try_divide(F.col("ops_diff") * 100.0, F.abs(F.col(metric)).cast("double"))
    )


def copy_donor_rows(
    needy: DataFrame, detail: DataFrame, detail_key: str, columns: Sequence[str]
) -> DataFrame:
    """Repeat each needy row (with ``donor_id``) once per detail row of its donor."""
    rows = detail.select(F.col(detail_key).alias("donor_id"), *columns)
    return split_join(needy, rows, ["donor_id"], "left")


def lowest_donor(needy: DataFrame, donors: DataFrame, donor_key: str, metric: str) -> DataFrame:
    """One donor for all: the one with the lowest metric, then the lowest id."""
    best = donors.agg(F.min_by(F.col(donor_key), F.struct(metric, donor_key)).alias("donor_id"))
    return with_scalars(needy, best)


def only_donor(needy: DataFrame, donors: DataFrame, donor_key: str) -> DataFrame:
    """One donor for all; fails when the donors hold more than one id."""
    low, high = F.min(donor_key), F.max(donor_key)
    pick = F.when(low == high, low).otherwise(
        F.raise_error(F.lit("more than one donor has data")).cast("string")
    )
    return with_scalars(needy, donors.agg(pick.alias("donor_id")))


def clone_rows(df: DataFrame, test, changes: Mapping[str, object]) -> DataFrame:
    """Add copies of the rows that pass the test, with some columns replaced."""
    copies = df.where(test).withColumns({c: F.lit(v) for c, v in changes.items()})
    return df.unionByName(copies)


def constant_mix(
    df: DataFrame, mix: Sequence[Mapping[str, object]], share: str = "fleetmix"
) -> DataFrame:
    """Repeat every row once per entry of a literal mix, in equal shares."""
    entries = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in m.items()]) for m in mix])
    names = list(mix[0])
    keep = [c for c in df.columns if c not in (*names, share)]
    return (
        df.select(*keep, F.explode(entries).alias("_m"))
        .select(*keep, *[F.col(f"_m.{n}") for n in names], F.lit(1.0 / len(mix)).alias(share))
    )
