"""Joins and totals that stay balanced when one key holds a large part of the rows.

The hot keys are found by a mergeable frequent-items sketch over the key hash.
Its result is one short array, at most ``MAX_HOT`` hashes however large the
table is. The sketch only steers the layout: a key it misses, or a cold key it
names, changes the split but never the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skyledger.session import shuffle_width

MAX_HOT = 100
SKETCH_ITEMS = 10_000
HOT_SHARE = 0.005  # a key is hot above this share of all rows


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the columns of a global aggregate on every row.

    A global aggregate has exactly one row, so its broadcast has a fixed size.
    """
    return df.join(F.broadcast(one_row), F.lit(True), "inner")


def hot_key_hashes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row, one column ``_hot``: array of the hashes of the hot keys."""
    sketch = df.select(F.xxhash64(*keys).alias("h")).agg(
        F.expr(f"approx_top_k(h, {MAX_HOT}, {SKETCH_ITEMS})").alias("top"),
        F.count(F.lit(1)).alias("n"),
    )
    hot = F.transform(
        F.filter("top", lambda e: e["count"] > F.col("n") * HOT_SHARE), lambda e: e["item"]
    )
    return sketch.select(hot.alias("_hot"))


def hot_keys(df: DataFrame, keys: Sequence[str], sketch_of: DataFrame | None = None) -> list[int]:
    """Hashes of the hot keys, at most ``MAX_HOT``, looked up now.

    ``sketch_of`` is a plainer table with some of the keys: where none of these is hot there, no key is.
    """
    if sketch_of is not None:
        some = [k for k in keys if k in sketch_of.columns]
        if some and not hot_key_hashes(sketch_of, some).first()[0]:
            return []
    return hot_key_hashes(df, keys).first()[0]


def split_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left",
    sketch_of: DataFrame | None = None,
) -> DataFrame:
    """Equi-join whose hot left keys are cut into pieces.

    Rows of a hot key are spread over ``shuffle_width`` pieces by a hash of the
    whole row (deterministic, so a recomputed task repeats it; select the columns
    in use first, as the hash reads every column of ``left``), and the matching
    right rows are repeated once per piece. Every other key keeps one piece.
    ``how`` is ``left``, ``inner``, ``left_semi`` or ``left_anti``. Where ``left``
    is itself costly, ``sketch_of`` names a plainer table with the same keys to
    look for hot keys in; this is done at once, and without hot keys the join is a plain
    one, whose layout by the keys serves the steps after it.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"split_join cannot run a {how} join")
    keys = list(keys)
    if sketch_of is not None and not hot_keys(sketch_of, keys):
        return left.join(right, keys, how)
    pieces = shuffle_width(left.sparkSession)
    hot = hot_key_hashes(left if sketch_of is None else sketch_of, keys)
    is_hot = F.coalesce(F.array_contains("_hot", F.xxhash64(*keys)), F.lit(False))
    piece = F.pmod(F.xxhash64(*left.columns), F.lit(pieces)).cast("int")
    salted_left = with_scalars(left, hot).withColumn(
        "_piece", F.when(is_hot, piece).otherwise(0)
    ).drop("_hot")
    all_pieces = F.sequence(F.lit(0), F.lit(pieces - 1))
    salted_right = with_scalars(right, hot).withColumn(
        "_piece", F.explode(F.when(is_hot, all_pieces).otherwise(F.array(F.lit(0))))
    ).drop("_hot")
    return salted_left.join(salted_right, [*keys, "_piece"], how).drop("_piece")


def attach_totals(
    df: DataFrame, keys: Sequence[str], split: bool = True, sketch_of: DataFrame | None = None, **aggregates: Column
) -> DataFrame:
    """Put group aggregates on every row of the group.

    Written as partial aggregate plus join and not as a window, because a window
    sends a whole group to one task. Rows with a null key get null totals.
    ``split=False`` leaves out the search for hot keys, for tables whose groups
    are short by nature (the years of one facility).
    """
    totals = df.groupBy(*keys).agg(*[c.alias(name) for name, c in aggregates.items()])
    return split_join(df, totals, keys, "left", sketch_of) if split else df.join(totals, list(keys), "left")


def attach_scalar(df: DataFrame, **aggregates: Column) -> DataFrame:
    """Put whole-table aggregates on every row."""
    return with_scalars(df, df.agg(*[c.alias(name) for name, c in aggregates.items()]))
