"""Ordered picks: keep-first, top-k, ties at the extreme, row numbers and pairs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyledger.operators.skew import attach_totals, hot_keys, with_scalars
from skyledger.session import settle, shuffle_width

CUTS = 64  # fewest splitters of an order
SAMPLE = 16  # sampled rows for each splitter


def _sort(name: str, ascending: bool = True) -> Column:
    """Nulls last in both directions, as in the source data's conventions."""
    return F.col(name).asc_nulls_last() if ascending else F.col(name).desc_nulls_last()


def sort_by(df: DataFrame, **directions: bool) -> DataFrame:
    """Multi-key sort, ``column=True`` ascending and ``column=False`` descending."""
    return df.orderBy(*[_sort(c, up) for c, up in directions.items()])


def top_k_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows per key. Spark cuts each group to ``k`` rows before the
    shuffle, so a task receives at most ``k`` rows per upstream task and key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Drop duplicates by key, keeping the first row in the declared order."""
    return top_k_per_group(df, keys, order, 1, "_first").drop("_first")


def tied_at_extreme(
    df: DataFrame, keys: Sequence[str], column: str, largest: bool = True
) -> DataFrame:
    """Every row whose value equals the group's extreme, ties included."""
    pick = F.max(column) if largest else F.min(column)
    return attach_totals(df, keys, _extreme=pick).where(F.col(column) == F.col("_extreme")).drop(
        "_extreme"
    )


def with_cuts(df: DataFrame, cuts: int = CUTS, **values: Column) -> DataFrame:
    """Add an array per numeric value: at most ``cuts`` points that cut the table into even slices."""
    grid = [i / (cuts + 1) for i in range(1, cuts + 1)]
    points = {n: F.array_distinct(F.percentile_approx(v, grid, 10_000)) for n, v in values.items()}
    return with_scalars(df, df.agg(*[c.alias(n) for n, c in points.items()]))


def before(a: Callable[[str], Column], b: Callable[[str], Column], order: Sequence[tuple[str, bool]]) -> Column:
    """Whether row ``a`` stands before row ``b`` in a mixed order, nulls last in both directions."""
    (name, up), rest = order[0], order[1:]
    x, y = a(name), b(name)
    less = F.coalesce(x < y if up else x > y, x.isNotNull() & y.isNull())
    return less | (x.eqNullSafe(y) & before(a, b, rest)) if rest else less


def splitters(df: DataFrame, order: Sequence[tuple[str, bool]], cuts: int) -> DataFrame:
    """One row, one column ``_cuts``: ascending rows of the order that cut the table into even slices.

    They are taken from the ``cuts * SAMPLE`` rows with the smallest hash of all columns of
    the order, so a key with many rows gets many of them, however narrow its range of
    values. They steer the layout only; rows are compared with them exactly.
    """
    names = [c for c, _ in order]
    few = df.select(*names, F.xxhash64(*names).alias("_h")).orderBy("_h").limit(cuts * SAMPLE)
    place = Window.orderBy(*[_sort(c, up) for c, up in order])  # over the sample only
    picked = few.withColumn("_i", F.row_number().over(place)).where(F.col("_i") % SAMPLE == 0)
    return picked.agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", F.struct(*names).alias("_row")))), lambda e: e["_row"]).alias("_cuts"))


def with_slices(df: DataFrame, order: Sequence[tuple[str, bool]]) -> DataFrame:
    """Add ``_slice``, the number of splitters at or before a row: it ascends with the order.

    Found by halving in about ``log2`` of the number of splitters, of which there
    are as many as shuffle partitions and at least ``CUTS``.
    """
    cuts = max(CUTS, shuffle_width(df.sparkSession))
    steps = F.sequence(F.lit(1), F.lit(cuts.bit_length()))
    row = lambda name: F.col(name)

    def halve(span: Column, _: Column) -> Column:
        middle = F.shiftright(span["low"] + span["high"], 1)
        after = before(row, lambda name: F.get("_cuts", middle)[name], order)
        ended = span["low"] >= span["high"]
        return F.struct(F.when(ended | after, span["low"]).otherwise(middle + 1).alias("low"), F.when(after & ~ended, middle).otherwise(span["high"]).alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.size("_cuts").alias("high"))
    found = F.aggregate(steps, start, halve, lambda span: span["low"])
    return with_scalars(df, splitters(df, order, cuts)).withColumn("_slice", found).drop("_cuts")


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[tuple[str, bool]],
    name: str = "row_no",
    sketch_of: DataFrame | None = None,
) -> DataFrame:
    """Row number per key in a total order, without one task per hot key.

    A key that is not hot holds a small share of the rows and is numbered by one window. The
    rows of hot keys are cut into slices of the order (keys, then ``order``); a hot key covers
    many of them. Rows are numbered inside their slice, and where a key goes on from the slice
    before, the number of its rows in earlier slices is added. Only the first key
    of a slice can go on, so the table of these numbers has at most two rows for each slice.
    Where ``df`` is costly, ``sketch_of`` is a plainer table with some of the keys to look for hot ones in.
    """
    keys = list(keys)
    sorts = [_sort(c, up) for c, up in order]
    hot = hot_keys(df, keys, sketch_of) if keys else []
    if keys and not hot:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*sorts))
        return df.select("*", place.cast("bigint").alias(name))
    is_hot = F.xxhash64(*keys).isin(*hot) if keys else F.lit(True)
    whole = [*[(k, True) for k in keys], *order]
    spread = with_slices(df.where(is_hot), whole)
    sliced = settle(spread.unionByName(df.where(~is_hot).withColumn("_slice", F.lit(-1))) if keys else spread)
    sizes = sliced.where("_slice >= 0").groupBy("_slice", *keys).agg(F.count(F.lit(1)).alias("_n"))
    # the first and the last key of each slice; a key between them lies in this slice only
    entry = F.struct(*[c for k in keys for c in (F.col(k).isNull().alias(f"_no_{k}"), F.col(k))], F.col("_n"))
    edge = sizes.groupBy("_slice").agg(F.array_distinct(F.array(F.min(entry), F.max(entry))).alias("_ends")).select("_slice", F.inline("_ends"))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = edge.withColumn("_before", F.sum("_n").over(earlier)).where("_before IS NOT NULL").select("_slice", *keys, "_before")
    inside = Window.partitionBy("_slice", *keys).orderBy(*sorts)
    left = sliced.withColumn("_inside", F.row_number().over(inside)).alias("l")
    same = F.col("l._slice") == F.col("r._slice")
    for c in keys:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return left.join(F.broadcast(offsets).alias("r"), same, "left").select(
        *[F.col(f"l.{c}") for c in df.columns],
        (F.col("l._inside") + F.coalesce("r._before", F.lit(0))).cast("bigint").alias(name),
    )


def exact_quantile(df: DataFrame, column: str, p: float, name: str = "quantile") -> DataFrame:
    """Exact interpolated quantile of a column, one row.

    The values are ranked slice by slice, so no task holds all of them.
    """
    values = df.select(column).where(F.col(column).isNotNull())
    ranked = numbered(values, [], [(column, True)], "_i")
    at = values.agg(((F.count(F.lit(1)) - 1) * p + 1).alias("_at"))
    near = with_scalars(ranked, at).where(
        (F.col("_i") >= F.floor("_at")) & (F.col("_i") <= F.ceil("_at"))
    )
    low, high = F.min(column), F.max(column)
    part = F.max(F.col("_at")) - F.floor(F.max("_at"))
    return near.agg((low + (high - low) * part).alias(name))


def pair_ids(
    df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], name: str = "ids", sketch_of: DataFrame | None = None,
) -> DataFrame:
    """Consecutive rows of the order share an id: 1, 1, 2, 2, ..."""
    return (
        numbered(df, keys, order, "_no", sketch_of)
        .withColumn(name, F.ceil(F.col("_no") / 2).cast("int"))
        .drop("_no")
    )


def category_rank(c: str | Column, categories: Sequence[str]) -> Column:
    """Position in a literal order list; values outside the list give null."""
    c = F.col(c) if isinstance(c, str) else c
    place = F.array_position(F.array(*[F.lit(v) for v in categories]), c)
    return F.when(place > 0, place).cast("int")
