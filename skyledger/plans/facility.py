"""Facility master, classification and registry checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from skyledger.functions.rules import last_rule, not_in, same_flag
from skyledger.functions.text import clean_key, repair_ids
from skyledger.operators.geo import points_in_polygons
from skyledger.operators.joins import compare_outer, enrich
from skyledger.operators.reshape import conditional_pivot

# Facility ids of the two named groups.
RELIEVER_IDS = (
    "ADS", "AFW", "AXH", "CXO", "DTO", "DWH", "EFD", "FTW", "FWS", "GKY", "GLS", "GPM", "GTU",
    "HQZ", "HYI", "IWS", "LBX", "LNC", "LVJ", "RBD", "SGR", "SKF", "SSF", "T41", "TKI",
)
COMMERCIAL_IDS = (
    "ABI", "ACT", "AMA", "AUS", "BPT", "BRO", "CLL", "CRP", "DAL", "DFW", "DRT", "ELP", "GGG",
    "HOU", "HRL", "IAH", "ILE", "LBB", "LRD", "MAF", "MFE", "SAT", "SJT", "SPS", "TYR", "VCT",
)
MILITARY_OWNERS = ("MA", "MR", "MN")

# Source classes of the prior inventory and their output columns.
PRIOR_CLASSES = {
    "General Aviation, Piston": "general_aviation_piston",
    "General Aviation, Turbine": "general_aviation_turbine",
    "Air Taxi, Piston": "air_taxi_piston",
    "Air Taxi, Turbine": "air_taxi_turbine",
    "Military": "military",
    "Commercial": "commercial",
}

# Analysis class of each (group, types).
FACILITY_CLASSES = {
    "med_heli": ("Medical", ("HELIPORT",)),
    "fandr_arpt": ("Farm/Ranch", ("AIRPORT", "ULTRALIGHT")),
    "fandr_heli": ("Farm/Ranch", ("HELIPORT",)),
    "mil_arpt": ("Military", ("AIRPORT",)),
    "mil_heli": ("Military", ("HELIPORT",)),
    "opra_arpt": ("Other_PR_Airports", ("AIRPORT", "ULTRALIGHT")),
    "opra_heli": ("Other_PR_Heliports", ("HELIPORT",)),
    "opua_arpt": ("Other_PU_Airports", ("SEAPLANE BASE", "AIRPORT")),
    "opua_heli": ("Other_PU_Heliports", ("HELIPORT",)),
    "tasp_arpt": ("TASP", ("AIRPORT",)),
    "tasp_heli": ("TASP", ("HELIPORT",)),
}

OPERATIONS = (
    "operations_commuter", "operations_commercial", "operations_air_taxi",
    "operations_ga_local", "operations_ga_itin", "operations_military",
)


def prior_operations(prior: DataFrame, pollutant: str = "CO") -> DataFrame:
    """Operations (two per LTO) by facility and source class; LTOs repeat per
    pollutant, so one pollutant's rows are summed."""
    return conditional_pivot(
        prior.where(F.col("eis_pollutant_id") == pollutant),
        ["facility_id", "airport", "county"], "scc_description", PRIOR_CLASSES, "lto",
        factor=2.0, total="total_ops",
    )


def facility_base(registry: DataFrame) -> DataFrame:
    """Open facilities, one row each, with their reported operations in total."""
    whole = F.lit(0.0)
    for c in OPERATIONS:
        whole = whole + F.col(c)
    others = [c for c in registry.columns if c != "facility_id"]
    row = F.min_by(F.struct(*others), F.struct("facility_name", "facility_type"))
    return (
        registry.where(F.upper("airport_status_code") == "O")
        .groupBy("facility_id").agg(row.alias("_r"), F.sum(whole).alias("total_ops"))
        .select("facility_id", "_r.*", "total_ops")
    )


def yearly_traffic(traffic: DataFrame, years: Sequence[int], summer: str = "summer") -> DataFrame:
    """Annual and summer operations of each year, all in one pass."""
    hot = F.lower("season") == summer
    aggs = []
    for y in years:
        mine = F.col("year_id") == y
        aggs.append(F.sum(F.when(mine, F.col("total_ops"))).alias(f"traffic_{y}"))
        aggs.append(F.sum(F.when(mine & hot, F.col("total_ops"))).alias(f"traffic_summer_{y}"))
    return traffic.where(F.col("year_id").isin(*years)).groupBy("facility_id").agg(*aggs)


def mean_taxi_times(taxi: DataFrame, years: Sequence[int], summer: str = "summer") -> DataFrame:
    """Mean taxi times of each year, annual and summer, over rows with movements."""
    hot = F.lower("season") == summer
    aggs = []
    for y in years:
        mine = F.col("year") == y
        out = mine & (F.col("departures_metrics") > 0)
        into = mine & (F.col("arrivals_metrics") > 0)
        aggs += [
            F.avg(F.when(out, F.col("avg_taxi_out_time"))).alias(f"taxi_out_{y}"),
            F.avg(F.when(into, F.col("avg_taxi_in_time"))).alias(f"taxi_in_{y}"),
            F.avg(F.when(out & hot, F.col("avg_taxi_out_time"))).alias(f"taxi_out_summer_{y}"),
            F.avg(F.when(into & hot, F.col("avg_taxi_in_time"))).alias(f"taxi_in_summer_{y}"),
        ]
    return taxi.where(F.col("year").isin(*years)).groupBy("facility_id").agg(*aggs)


def facility_master(
    registry: DataFrame, forecast: DataFrame, prior: DataFrame, traffic: DataFrame,
    taxi: DataFrame, reported: DataFrame, own: DataFrame, planning: DataFrame,
    years: Sequence[int] = (2019, 2020),
) -> DataFrame:
    """One wide row per open facility; every source is reduced to one row per
    facility before it is joined."""
    fc = forecast.where(F.col("sysyear").isin(*years)).groupBy("facility_id").agg(*[
        F.max(F.when(F.col("sysyear") == y, F.col("t_aops"))).alias(f"forecast_{y}") for y in years
    ])
    prior_total = prior_operations(prior).groupBy("facility_id").agg(
        F.max("total_ops").alias("prior_ops")
    )
    rep = reported.groupBy("facility_id").agg(
        F.sum("annual_operations").alias("reported_ops"),
        F.min("operations_year").alias("reported_year"),
    )
    own_cols = [c for c in own.columns if c != "facility_id"]
    own_one = own.groupBy("facility_id").agg(*[F.max(c).alias(f"own_{c}") for c in own_cols])
    group = planning.groupBy("facility_id").agg(F.min("tx_dot").alias("tx_dot_group"))
    return enrich(
        facility_base(registry),
        [fc, prior_total, yearly_traffic(traffic, years), rep, own_one,
         mean_taxi_times(taxi, years), group],
        "facility_id",
    )


def classify_facility(
    df: DataFrame,
    reliever_ids: Sequence[str] = RELIEVER_IDS,
    commercial_ids: Sequence[str] = COMMERCIAL_IDS,
) -> DataFrame:
    """Facility group by ordered rules; the last rule that holds wins."""
    used, heli = F.upper("used"), F.upper("facility_type") == "HELIPORT"
    name, fid = F.col("facility_name"), F.upper("facility_id")
    rules = [
        ((used == "PU") & ~heli, "Other_PU_Airports"),
        ((used == "PU") & heli, "Other_PU_Heliports"),
        ((used == "PR") & ~heli, "Other_PR_Airports"),
        ((used == "PR") & heli, "Other_PR_Heliports"),
        (name.ilike("%farm%"), "Farm/Ranch"),
        (name.ilike("%ranch%"), "Farm/Ranch"),
        (F.upper("other_services") == "AGRI", "Farm/Ranch"),
        (F.upper("medical_use") == "Y", "Medical"),
        (F.upper("ownership").isin(*MILITARY_OWNERS), "Military"),
        (F.upper("tx_dot_group") == "TASP", "TASP"),
        (fid.isin(*reliever_ids), "Reliever"),
        (fid.isin(*commercial_ids), "Commercial"),
    ]
    return df.withColumn("facility_group", last_rule(rules))


def class_split(ops: DataFrame) -> DataFrame:
    """Analysis class of the facilities that are neither gliderports nor of the
    two named groups; a facility of no class keeps a null ``fac_class``."""
    kept = ops.where(
        not_in("facility_type", ["GLIDERPORT"]) & not_in("facility_group", ["Commercial", "Reliever"])
    )
    label = F.lit(None).cast("string")
    for name, (group, types) in FACILITY_CLASSES.items():
        hit = (F.col("facility_group") == group) & F.col("facility_type").isin(*types)
        label = F.when(hit, F.lit(name)).otherwise(label)
    return kept.withColumn("fac_class", label)


def facility_county_check(
    registry: DataFrame, points: DataFrame, rings: DataFrame, counties: DataFrame,
    state: str = "TX", cell: float = 1.0,
) -> DataFrame:
    """Registry against located points: county by polygon, agreement flag, presence.

    ``points``: ident, name, state, servcity, lon, lat. ``rings``: poly_id, seq,
    x, y. ``counties``: poly_id, county, district, fips.
    """
    reg = registry.select(
        clean_key("facility_id").alias("facility_id"), clean_key("facility_name").alias("facility_name"),
        "city", clean_key("county").alias("county"),
    )
    near = points.where(F.col("state") == state)
    hits = points_in_polygons(near, rings, "ident", "poly_id", cell=cell)
    named = counties.withColumn("county", clean_key("county"))
    located = near.join(hits.join(named, "poly_id"), "ident", "left").select(
        repair_ids(clean_key("ident")).alias("facility_id"), clean_key("name").alias("facility_name"),
        F.col("servcity").alias("city"), "county", "district", "fips", "lat", "lon",
    )
    both = compare_outer(reg, located, ["facility_id"], ("_reg", "_pt"))
    return both.withColumn("qc", same_flag("county_pt", "county_reg"))
