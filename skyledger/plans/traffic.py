"""Traffic tables: growth by class, engine types, aircraft master, coverage."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from skyledger.functions.numbers import ratio
from skyledger.functions.rules import first_rule
from skyledger.functions.text import MISSING_CODE, repair_text
from skyledger.operators.joins import lookup, only_left, with_base_period
from skyledger.operators.measures import distinct_values, share_of_group
from skyledger.operators.reshape import unpivot_records
from skyledger.operators.skew import split_join

CLASSES = ("air_carrier", "air_taxi", "general_aviation", "military", "total_ops")
# Display labels of the classes.
CLASS_LABELS = {
    "air_carrier": "Air Carrier", "air_taxi": "Air Taxi",
    "general_aviation": "General Aviation", "military": "Military", "total_ops": "Total",
}
# Manufacturer rules, applied in this order where nothing is known.
TURBINE_NAMES = ("Chinook", "Airbus", "Agusta", "Blackhawk Helicopter", "Eurocopter", "Sikorsky",
                 "Boeing AH-64")


def traffic_classes(forecast: DataFrame) -> DataFrame:
    """Operations and share of each aviation class per facility and year."""
    out = forecast.withColumns({
        "air_carrier": F.col("itn_ac").cast("double"),
        "air_taxi": F.col("itn_at").cast("double"),
        "general_aviation": (F.col("itn_ga") + F.col("loc_ga")).cast("double"),
        "military": (F.col("itn_mil") + F.col("loc_mil")).cast("double"),
    })
    out = out.withColumn(
        "total_ops",
        F.col("air_carrier") + F.col("air_taxi") + F.col("general_aviation") + F.col("military"),
    )
    shares = {f"{c}_pct": ratio(c, "total_ops") for c in CLASSES[:4]}
    out = out.withColumns(shares)
    total = F.col("air_carrier_pct")
    for c in CLASSES[1:4]:
        total = total + F.col(f"{c}_pct")
    return out.withColumn("total_ops_pct", total)


def traffic_growth_long(forecast: DataFrame, ops: DataFrame, base_year: int = 2019) -> DataFrame:
    """Long table facility x year x class: operations, share, growth against the
    base year, our base operations split by class, and their projection.

    ``ops``: facility_id, annual_operations (one row per facility).
    """
    wide = with_base_period(
        traffic_classes(forecast), ["facility_id"], "sysyear", base_year,
        {**{c: f"base_{c}" for c in CLASSES}, **{f"{c}_pct": f"base_{c}_pct" for c in CLASSES}},
    )
    wide = lookup(wide, ops, ["facility_id"], ["annual_operations"])
    long = unpivot_records(wide, ["facility_id", "sysyear"], "aviation_type", {
        CLASS_LABELS[c]: {
            "operations": c,
            "operations_pct": f"{c}_pct",
            "growth": ratio(c, f"base_{c}"),
            "base_ops": F.col("annual_operations") * F.col(f"base_{c}_pct"),
        }
        for c in CLASSES
    })
    return long.withColumn("projected_operations", F.col("base_ops") * F.col("growth"))


def aviation_type(user_class: str = "user_class") -> Column:
    c = F.col(user_class)
    return first_rule([
        (c.isin("Air Carrier", "Freight"), "Air Carrier"),
        (c == "General Aviation", "General Aviation"),
        (c == "Military", "Military"),
        (c == "Air Taxi", "Air Taxi"),
    ], F.lit(None).cast("string"))


def _engine_of(physical: Column) -> Column:
    kind = F.lower(physical)
    return F.when(kind.isin("jet", "turbine"), "Turbine").when(kind == "piston", "Piston")


def _usual_class(traffic: DataFrame, key: str, usable: Column, name: str) -> DataFrame:
    """Most frequent physical class of each key, then the first in the alphabet."""
    counts = traffic.where(usable & (F.col("physical_class") != "-")).groupBy(
        key, "physical_class"
    ).agg(F.count(F.lit(1)).alias("n"))
    order = F.struct((-F.col("n")).alias("n"), F.col("physical_class").alias("c"))
    return counts.groupBy(key).agg(F.min_by("physical_class", order).alias(name))


def engine_type_impute(traffic: DataFrame, strict: bool = False) -> DataFrame:
    """Add ``aviation_type`` and ``engine_type``.

    Engine type comes from the row's physical class, else from the usual class of
    its aircraft id, else of its aircraft type, else from name rules. ``strict``
    keeps a borrowed class as it is spelled instead of Turbine or Piston.
    """
    ids = _usual_class(
        traffic, "aircraft_id", F.coalesce(~F.col("aircraft_id").isin("", "#VALUE!"), F.lit(False)), "_by_id"
    )
    types = _usual_class(
        traffic, "aircraft_type",
        F.coalesce(~F.col("aircraft_type").isin("", " - unknown", "#VALUE!", "A"), F.lit(False)), "_by_type",
    )
    known = split_join(
        split_join(traffic, ids, ["aircraft_id"]), types, ["aircraft_type"], sketch_of=traffic
    )

    def borrowed(c: str) -> Column:
        return F.col(c) if strict else F.coalesce(_engine_of(F.col(c)), F.col(c))

    name = F.col("aircraft_type")
    rules = [(F.lower("weight_class") == "large jet eqpt", "Turbine")]
    rules += [(name.ilike(f"%{n}%"), "Turbine") for n in TURBINE_NAMES]
    rules += [(name.ilike("%Robinson%"), "Piston"), (name.ilike("%Bell%"), "Turbine")]
    return known.withColumns({
        "aviation_type": aviation_type(),
        "engine_type": F.coalesce(
            _engine_of(F.col("physical_class")), borrowed("_by_id"), borrowed("_by_type"),
            first_rule(rules, F.lit(None).cast("string")),
        ),
    }).drop("_by_id", "_by_type")


def aviation_type_mix(typed: DataFrame) -> DataFrame:
    """Each row's share of its facility's operations of the same aviation type."""
    usable = typed.where(F.col("aviation_type").isNotNull() & F.col("engine_type").isNotNull())
    return share_of_group(
        usable, ["facility_id", "aviation_type"], "total_ops", "aviation_type_mix", "aviation_type_ops"
    )


def aircraft_table(traffic: DataFrame) -> DataFrame:
    """Traffic by facility, aircraft and user class, with repaired names and engine type."""
    kind = F.lower(F.trim("physical_class"))
    engine = (
        F.when(kind == "piston", "Piston").when(kind.isin("jet", "turbine"), "Turbine")
        .when(kind == "-", F.lit(None)).otherwise(MISSING_CODE)
    )
    keys = ["facility_id", "facility_name", "aircraft_id", "aircraft_type_id", "aircraft_type", "user_class"]
    return (
        traffic.withColumns({
            "aircraft_id": F.coalesce("aircraft_id", F.lit(MISSING_CODE)),
            "aircraft_type_id": repair_text("aircraft_type_id", missing=["#NAME?"]),
            "aircraft_type": repair_text("aircraft_type", missing=["- unknown"]),
            "engine_type": engine,
        })
        .dropna(subset=keys).groupBy(*keys)
        .agg(F.sum("total_ops").alias("total_ops"), F.min("engine_type").alias("engine_type"))
    )


def aircraft_master(traffic: DataFrame, airframes: DataFrame) -> dict[str, DataFrame]:
    """Aircraft list against the airframe list.

    ``matched``/``unmatched`` by exact name, with the user classes and facilities
    that use the aircraft; ``candidates`` for rows without an aircraft id: the list
    of aircraft of the same facility and user class.
    """
    table = aircraft_table(traffic)
    low = lambda c: F.lower(F.trim(c))
    known = table.where((F.col("aircraft_id") != MISSING_CODE) & F.col("engine_type").isNotNull()).select(
        low("aircraft_id").alias("aircraft_id"), low("aircraft_type").alias("aircraft_type"),
        low("aircraft_type_id").alias("aircraft_type_id"), "engine_type", "user_class", "facility_name",
    )
    keys = ["aircraft_id", "aircraft_type", "engine_type"]
    # The sets hold distinct values only, so their length is bounded by the code
    # lists of user classes and facilities and not by the number of rows.
    master = known.groupBy(*keys).agg(
        F.min("aircraft_type_id").alias("aircraft_type_id"),
        F.array_sort(F.collect_set("user_class")).alias("user_classes"),
        F.array_sort(F.collect_set("facility_name")).alias("facilities"),
    ).withColumn("aircraft_id_and_type", F.concat_ws(" ", "aircraft_id", "aircraft_type"))
    frames = airframes.select(low("model").alias("aircraft_type"), "airframe_id")
    matched = master.join(frames, "aircraft_type", "inner")
    unmatched = only_left(master, frames, ["aircraft_type"])
    key = ["facility_id", "facility_name", "user_class"]
    missing = table.where(F.col("aircraft_id") == MISSING_CODE).drop("engine_type")
    fill = distinct_values(
        table.where(F.col("aircraft_id") != MISSING_CODE), key, "aircraft_id", "candidate_ids"
    )
    candidates = missing.join(fill, key, "left")
    return {"matched": matched, "unmatched": unmatched, "candidates": candidates}


def source_coverage(sources: Mapping[str, DataFrame], key: str = "facility_id") -> DataFrame:
    """One row per key with a flag for every source it occurs in, and their number."""
    tagged = None
    for name, df in sources.items():
        one = df.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_src", F.lit(name))
        tagged = one if tagged is None else tagged.unionByName(one)
    flags = [F.max(F.when(F.col("_src") == n, 1).otherwise(0)).alias(f"in_{n}") for n in sources]
    out = tagged.groupBy(key).agg(*flags, F.count(F.lit(1)).alias("n_sources"))
    return out
