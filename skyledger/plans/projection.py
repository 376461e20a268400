"""Projection factors: yearly multipliers against the base year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from skyledger.functions.numbers import ratio
from skyledger.operators.donors import copy_donor_rows, nearest_value
from skyledger.operators.joins import with_base_period
from skyledger.operators.reshape import extend_series, fill_gaps, over_years, with_series
from skyledger.session import settle

BASE_YEAR = 2019
FIRST_YEAR, LAST_FORECAST, LAST_YEAR = 2011, 2045, 2050


def projection_factor(
    forecast: DataFrame, base_year: int = BASE_YEAR,
    gaps: tuple[Sequence[str], int, int] | None = (("skf",), 2011, 2015),
) -> DataFrame:
    """Operations over base-year operations per facility and year.

    Years without operations are dropped; ``gaps`` = (facilities, first, last)
    gives those facilities factor 1 in missing years.
    """
    clean = forecast.select(
        F.lower(F.trim("facility_id")).alias("facility_id"), "sysyear", "t_aops"
    ).where(F.col("t_aops") >= 1)
    base = with_base_period(clean, ["facility_id"], "sysyear", base_year, {"t_aops": "_base"})
    factors = base.select("facility_id", "sysyear", ratio("t_aops", "_base").alias("proj_fac"))
    if gaps is None:
        return factors
    ids, first, last = gaps
    return fill_gaps(
        factors, ["facility_id"], "sysyear", first, last, "proj_fac", 1.0, F.col("facility_id").isin(*ids)
    )


def projection_all(
    ops: DataFrame, factors: DataFrame, observed: DataFrame, national: DataFrame,
    observed_year: int = 2020, first: int = FIRST_YEAR, end: int = LAST_FORECAST, last: int = LAST_YEAR,
) -> DataFrame:
    """Factor of every facility and year ``first``..``last``.

    Commercial facilities use their factors with the observed year replaced;
    relievers their factors; TASP facilities without factors the series of the
    nearest donor of their district; medical ones 1; military and all others the
    national series. A facility without any factor stays, as one row without year and
    factor. ``observed``: facility_id, proj_fac. ``national``: sysyear,
    mil_proj_fac, com_av_proj_fac.
    """
    group = F.col("facility_group")
    own = ops.where(group.isin("Commercial", "Reliever", "TASP")).join(factors.withColumn("_found", F.lit(True)), "facility_id", "left")
    own = own.where((group != "TASP") | F.col("_found")).drop("_found")
    better = observed.select(
        "facility_id", F.col("proj_fac").alias("_seen"), F.lit(observed_year).alias("sysyear")
    )
    own = own.join(better, ["facility_id", "sysyear"], "left").withColumn(
        "proj_fac",
        F.when(group == "Commercial", F.coalesce("_seen", "proj_fac")).otherwise(F.col("proj_fac")),
    ).drop("_seen")
    own = settle(own)

    needy = ops.where(group == "TASP").join(own.select("facility_id"), "facility_id", "left_anti")
    donors = own.where(group == "TASP").groupBy("district", "facility_id").agg(
        F.max("annual_operations").alias("annual_operations")
    )
    found = nearest_value(needy, donors, "district", "annual_operations", "facility_id")
    filled = copy_donor_rows(found, own, "facility_id", ["sysyear", "proj_fac"]).withColumnRenamed(
        "donor_id", "filled_from_facility_id"
    )
    medical = over_years(ops.where(group == "Medical"), first, last, "sysyear").withColumn("proj_fac", F.lit(1.0))
    rest = ops.where(~F.coalesce(group.isin("Commercial", "Reliever", "TASP", "Medical"), F.lit(False)))
    rest = with_series(rest, national, first, last, "sysyear").withColumn(
        "proj_fac",
        F.when(group == "Military", F.col("mil_proj_fac")).otherwise(F.col("com_av_proj_fac")),
    ).drop("mil_proj_fac", "com_av_proj_fac")
    # years after ``end`` that the series lacks are carried forward below
    rest = rest.where((F.col("sysyear") <= end) | F.col("proj_fac").isNotNull())
    everything = own
    for piece in (filled, medical, rest):
        everything = everything.unionByName(piece, allowMissingColumns=True)
    return extend_series(settle(everything), "facility_id", "sysyear", end, last)
