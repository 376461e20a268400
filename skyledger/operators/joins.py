"""Joins: lookups, comparisons, cascaded and ambiguous matching.

No broadcast hint is given anywhere: Spark broadcasts a side only when its
measured size is under ``spark.sql.autoBroadcastJoinThreshold`` and otherwise
runs a sort-merge join, whose oversized partitions adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from skyledger.functions.names import suffixed
from skyledger.operators.donors import nearest_value
from skyledger.operators.ranking import first_per_group
from skyledger.operators.skew import attach_totals, split_join
from skyledger.session import settle


def lookup(
    fact: DataFrame,
    dim: DataFrame,
    on: Sequence[str] | Mapping[str, str],
    columns: Sequence[str] | None = None,
    how: str = "left",
) -> DataFrame:
    """Bring dimension columns to the fact; ``on`` maps fact keys to dimension keys.

    The dimension's key columns are dropped where their names differ, and null
    keys match nothing.
    """
    pairs = dict(on) if isinstance(on, Mapping) else {k: k for k in on}
    keep = [c for c in dim.columns if c not in pairs.values()] if columns is None else list(columns)
    right = dim.select(*[F.col(d).alias(f) for f, d in pairs.items()], *keep)
    return fact.join(right, list(pairs), how)


def enrich(base: DataFrame, sources: Sequence[DataFrame], key: str) -> DataFrame:
    """Left-join one-row-per-key sources onto the base in turn."""
    return reduce(lambda df, src: df.join(src, key, "left"), sources, base)


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join in which a null key matches a null key."""
    l, r = left.alias("l"), right.alias("r")
    same = reduce(
        lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    )
    out = [F.coalesce(F.col(f"l.{k}"), F.col(f"r.{k}")).alias(k) for k in keys]
    out += [F.col(f"l.{c}") for c in left.columns if c not in keys]
    out += [F.col(f"r.{c}") for c in right.columns if c not in keys]
    return l.join(r, same, how).select(*out)


def compare_outer(
    a: DataFrame, b: DataFrame, keys: Sequence[str], suffixes: tuple[str, str] = ("_a", "_b")
) -> DataFrame:
    """Full outer join with suffixed measures and one presence flag per side."""
    left = suffixed(a, suffixes[0], keys).withColumn("in" + suffixes[0], F.lit(True))
    right = suffixed(b, suffixes[1], keys).withColumn("in" + suffixes[1], F.lit(True))
    flags = {"in" + s: F.coalesce(F.col("in" + s), F.lit(False)) for s in suffixes}
    return left.join(right, list(keys), "full_outer").withColumns(flags)


def with_base_period(
    series: DataFrame, keys: Sequence[str], period: str, base: int, measures: Mapping[str, str]
) -> DataFrame:
    """Attach each series' own values of the base period, ``{measure: new name}``."""
    picks = {
        new: F.max(F.when(F.col(period) == base, F.col(old))) for old, new in measures.items()
    }
    return attach_totals(series, keys, split=False, **picks)


def decode_columns(fact: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Replace several code columns by descriptions.

    ``tables`` maps a code column to a ``(code, description)`` table; the result
    column swaps ``_code`` for ``_val``.
    """
    for column, table in tables.items():
        right = table.select(
            F.col("code").alias(column), F.col("description").alias(column.replace("code", "val"))
        )
        fact = fact.join(right, column, "left").drop(column)
    return fact


def only_left(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is absent on the other side."""
    return left.join(right.select(*keys), list(keys), "left_anti")


def in_both(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys), list(keys), "left_semi")


def key_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys found on one side only, with the side named; empty when the sets agree."""
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    return (
        left.join(right, list(keys), "left_anti").withColumn("side", F.lit("left"))
        .unionByName(right.join(left, list(keys), "left_anti").withColumn("side", F.lit("right")))
    )


def drop_listed(df: DataFrame, key: Column, listed: Sequence[str]) -> DataFrame:
    """Remove rows whose composite key is in a literal list; a null key stays."""
    return df.where(F.coalesce(~key.isin(*listed), F.lit(True))) if listed else df


def first_of_duplicates(dim: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return first_per_group(dim, keys, [F.col(c).asc_nulls_last() for c in order])


def second_chance(
    fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, offset: int, value: str
) -> DataFrame:
    """Match on ``dim_key - offset`` and, failing that, on the raw ``dim_key``.

    ``match_rule`` tells which: ``shifted``, ``raw``, ``none``, or ``no key``.
    The dimension has one row per key.
    """
    shifted = dim.select((F.col(dim_key) - offset).alias(fact_key), F.col(value).alias("_v1"))
    raw = dim.select(F.col(dim_key).alias(fact_key), F.col(value).alias("_v2"))
    both = fact.join(shifted, fact_key, "left").join(raw, fact_key, "left")
    rule = (
        F.when(F.col(fact_key).isNull(), "no key")
        .when(F.col("_v1").isNotNull(), "shifted")
        .when(F.col("_v2").isNotNull(), "raw")
        .otherwise("none")
    )
    return both.withColumn("match_rule", rule).withColumn(
        value, F.coalesce("_v1", "_v2")
    ).drop("_v1", "_v2")


def resolve_ambiguous(
    df: DataFrame, key: str, agrees: Column, pick: str, keep_all_agreeing: bool = True
) -> DataFrame:
    """Settle keys with several candidates.

    A key with one candidate keeps it. Otherwise the candidates that agree win
    (all of them, or the one lowest in ``pick``); if none agrees, those lowest
    in ``pick`` do. ``how`` names the rule used.
    """
    yes = F.coalesce(agrees, F.lit(False))
    counted = attach_totals(
        df.withColumn("_yes", yes),
        [key],
        _n=F.count(F.lit(1)),
        _agree=F.count_if(F.col("_yes")),
        _low=F.min(pick),
        _low_yes=F.min(F.when(F.col("_yes"), F.col(pick))),
    )
    how = (
        F.when(F.col("_n") == 1, "unique")
        .when(F.col("_agree") > 0, "agrees")
        .otherwise("lowest")
    )
    agreeing = F.col("_yes")
    if not keep_all_agreeing:
        agreeing = agreeing & (F.col(pick) == F.col("_low_yes"))
    keep = (
        F.when(F.col("_n") == 1, F.lit(True))
        .when(F.col("_agree") > 0, agreeing)
        .otherwise(F.coalesce(F.col(pick) == F.col("_low"), F.lit(False)))
    )
    return counted.withColumn("how", how).where(keep).drop(
        "_n", "_agree", "_low", "_low_yes", "_yes"
    )


def priority_match(
    a: DataFrame, b: DataFrame, a_id: str, b_id: str, rules: Mapping[str, tuple[Column, Column]]
) -> DataFrame:
    """(a_id, match_id, method) of the rows of ``a`` that match by some rule, by the first rule that they match by.

    ``rules`` maps a method, in order of priority, to the key of ``a`` and the key of ``b``; a null key
    matches nothing. Every row gives all its keys with the rule's rank. The keys of ``a`` that
    ``b`` has are reduced to the best of each row before they meet the rows of ``b``,
    so a match by a later rule is never made and dropped again. Both steps join on the
    same (rank, key). Ids are unique on each side.
    """
    def keyed(side: int) -> Column:
        return F.explode(F.array(*[F.struct(F.lit(i).alias("_rank"), pair[side].cast("string").alias("_key")) for i, pair in enumerate(rules.values())]))

    left = a.select(F.col(a_id), keyed(0).alias("_k")).select(a_id, "_k.*").where(F.col("_key").isNotNull())
    right = b.select(F.col(b_id).alias("match_id"), keyed(1).alias("_k")).select("match_id", "_k.*").where(F.col("_key").isNotNull())
    best = left.join(right.select("_rank", "_key"), ["_rank", "_key"], "left_semi").groupBy(a_id).agg(F.min(F.struct("_rank", "_key")).alias("_k"))
    names = F.array(*[F.lit(n) for n in rules])
    return best.select(a_id, "_k.*").join(right, ["_rank", "_key"]).select(a_id, "match_id", F.get(names, F.col("_rank")).alias("method"))


def cascade_match(
    a: DataFrame, b: DataFrame, id_col: str, name_col: str, value_col: str, group_col: str
) -> DataFrame:
    """Match by id; the rest by name; the rest to the nearest value in the group.

    Returns ``(id, match_id, method)``. Both sides have unique ids; several ``b`` rows
    of one name are all matches, and one used by an earlier rule is not offered
    to the nearest pass.
    """
    found = settle(priority_match(a, b, id_col, id_col, {
        "id": (F.col(id_col), F.col(id_col)), "name": (F.col(name_col), F.col(name_col))}))
    columns = [id_col, group_col, value_col]
    # A name may be matched many times over: the ids are made single before they meet the sides.
    near = nearest_value(
        only_left(a, found.select(id_col).distinct(), [id_col]).select(*columns),
        only_left(b, found.select(F.col("match_id").alias(id_col)).distinct(), [id_col]).select(*columns),
        group_col, value_col, id_col, a,
    )
    by_value = near.where(F.col("donor_id").isNotNull()).select(
        id_col, F.col("donor_id").alias("match_id"), F.lit("nearest").alias("method")
    )
    return found.unionByName(by_value)
