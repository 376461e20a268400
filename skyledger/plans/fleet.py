"""Fleet mix: shares of aircraft at each facility, and their filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skyledger.functions.numbers import ratio
from skyledger.functions.rules import first_rule
from skyledger.functions.text import clean_key, has, repair_text, right_split
from skyledger.operators.donors import (
    clone_rows, constant_mix, copy_donor_rows, lowest_donor, nearest_value, only_donor,
)
from skyledger.operators.joins import lookup, resolve_ambiguous
from skyledger.operators.measures import (
    first_known, group_sums, loss_audit, share_of_aggregate, share_of_group, share_of_total,
)
from skyledger.operators.ranking import first_per_group
from skyledger.operators.skew import split_join, with_scalars
from skyledger.session import settle, shuffle_width

MIX = ["aircraft_id", "aircraft_type_id", "aircraft_type", "airframe_id", "airframe_type", "fleetmix"]
# The generic helicopters.
HELICOPTERS = (
    {"aircraft_id": "5238", "airframe_id": 5238, "aircraft_type": "agusta a119", "airframe_type": "agusta a119"},
    {"aircraft_id": "5177", "airframe_id": 5177, "aircraft_type": "eurocopter ec-130", "airframe_type": "eurocopter ec-130"},
    {"aircraft_id": "5331", "airframe_id": 5331, "aircraft_type": "bell 429", "airframe_type": "bell 429"},
)
# Airframe of each military helicopter.
MILITARY_HELICOPTERS = {"CH47D": 4891, "S70": 4935, "B212": 5245}
FUEL_TRUCK = '"Diesel - F750 Dukes Transportation Services DART 3000 to 6000 gallon - Fuel Truck"'
LIST_BLOCK = 1000  # entries of an equipment list in one row
GENERIC_CODE = 999900  # equipment codes above it are generic


def clean_traffic(traffic: DataFrame) -> DataFrame:
    """Operations by year, facility, airport and aircraft, rows of unknown type removed."""
    bad = F.col("aircraft_type_id").isNull() | has("aircraft_type", "unknown") | has("aircraft_type", "#VALUE!")
    clean = traffic.where(~bad).withColumns({
        "aircraft_id": F.lower(F.trim("aircraft_id")), "facility_id": F.lower(F.trim("facility_id")),
    })
    return group_sums(clean, ["year_id", "facility_id", "airport", "aircraft_id"], total_ops_by_craft="total_ops")


def fleet_mix(traffic: DataFrame, aircraft_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shares, loss audit). Shares are taken after unmapped aircraft are dropped."""
    before = clean_traffic(traffic)
    mapped = aircraft_map.where(F.col("airframe_id").isNotNull())
    after = lookup(before, mapped, ["aircraft_id"], how="inner")
    # At most one row per mapped aircraft in each group by now.
    shares = share_of_aggregate(
        after, ["year_id", "facility_id", "airport"], "total_ops_by_craft", "fleetmix", "total_ops_by_arpt"
    ).withColumns({
        "aircraft_type_id": repair_text("aircraft_type_id", missing=["#NAME?"]),
        "aircraft_type": repair_text("aircraft_type", missing=["- unknown"]),
    })
    return shares, loss_audit(before, after, ["facility_id"], "total_ops_by_craft")


def fill_constant_mix(heliports: DataFrame, mix: Sequence[dict] = HELICOPTERS) -> DataFrame:
    """Replace every heliport's mix by a literal one, one set per facility."""
    rest = heliports.drop(*MIX)
    one = first_per_group(rest, ["facility_id"], [F.col(c).asc_nulls_last() for c in rest.columns])
    return constant_mix(one, mix)


def donor_list(with_data: DataFrame, group: str) -> DataFrame:
    """Facilities that have a mix, one row each."""
    return with_data.groupBy(group, "facility_id").agg(F.max("annual_operations").alias("annual_operations"))


def fill_nearest_donor(
    needy: DataFrame, with_data: DataFrame, group: str = "district",
    extra: tuple[Column, dict] | None = None,
) -> DataFrame:
    """Needy facilities take the mix of the facility of their group with the nearest
    operations. ``extra`` = (test, changes) also offers some donors elsewhere."""
    donors = donor_list(with_data, group) if extra is None else donor_list(
        clone_rows(with_data, extra[0], extra[1]), group
    )
    found = nearest_value(needy.drop(*MIX), donors, group, "annual_operations", "facility_id")
    return copy_donor_rows(found, with_data, "facility_id", MIX).withColumnRenamed(
        "donor_id", "filled_from_facility_id"
    )


def fill_single_donor(needy: DataFrame, with_data: DataFrame) -> DataFrame:
    """The one facility with data serves all; more than one is an error."""
    found = only_donor(needy.drop(*MIX), with_data, "facility_id")
    return copy_donor_rows(found, with_data, "facility_id", MIX).withColumnRenamed(
        "donor_id", "filled_from_facility_id"
    )


def fill_min_ops_donor(needy: DataFrame, with_data: DataFrame) -> DataFrame:
    """The facility with the fewest operations (then the lowest id) serves all."""
    found = lowest_donor(needy.drop(*MIX), with_data, "facility_id", "annual_operations")
    return copy_donor_rows(found, with_data, "facility_id", MIX).withColumnRenamed(
        "donor_id", "filled_from_facility_id"
    )


def default_engine(equipment: DataFrame, airframes: DataFrame | None = None) -> DataFrame:
    """Per airframe the first known engine and ids, in engine order."""
    columns = ["engine_id", "engine_mod_id", "anp_airplane_id", "anp_helicopter_id", "bada_id", "bada4_id"]
    out = first_known(equipment.withColumn("_at", F.col("engine_id")), ["airframe_id"], ["_at"], columns)
    return out if airframes is None else out.join(airframes.select("airframe_id").distinct(), "airframe_id", "left_semi")


def fleet_mix_all(
    traffic: DataFrame, aircraft_map: DataFrame, ops: DataFrame, equipment: DataFrame,
    one_farm_donor: bool = True, extra: tuple[Column, dict] | None = None,
) -> DataFrame:
    """Mix of every facility: own data, or filled by the rule of its group.

    Heliports take the literal mix; TASP and military airports the nearest donor
    of their group and district; farms the only donor; other airports the public
    one with the fewest operations. Own rows of the rest stay as they are.
    """
    shares, _ = fleet_mix(traffic, aircraft_map)
    shares = shares.select("facility_id", *MIX)
    group = F.col("facility_group")
    is_heli = F.col("facility_type") == "HELIPORT"
    place = F.concat_ws("|", "facility_group", "district")
    airports = ops.where(~F.coalesce(is_heli, F.lit(False))).withColumn("_place", place)
    own = settle(airports.join(shares, "facility_id", "inner"))
    needy = airports.join(own.select("facility_id"), "facility_id", "left_anti")

    near_groups = group.isin("TASP", "Military")
    if extra is not None:
        test, changes = extra
        moved = F.lit("Military|" + changes["district"])
        pool = own.where(near_groups)
        copies = pool.where(test & (group == "Military")).withColumn("_place", moved)
        donors = donor_list(pool.unionByName(copies), "_place")
    else:
        donors = donor_list(own.where(near_groups), "_place")
    found = nearest_value(needy.where(near_groups), donors, "_place", "annual_operations", "facility_id")

    farm = own.where(group == "Farm/Ranch")
    farm_needy = needy.where(group == "Farm/Ranch")
    farm_found = (
        only_donor(farm_needy, farm, "facility_id") if one_farm_donor
        else lowest_donor(farm_needy, farm, "facility_id", "annual_operations")
    )
    public = own.where(group == "Other_PU_Airports")
    other = needy.where(group.isin("Other_PU_Airports", "Other_PR_Airports"))
    other_found = lowest_donor(other, public, "facility_id", "annual_operations")

    # All borrowers look up their donors' rows in one join.
    borrowers = found.unionByName(farm_found, allowMissingColumns=True).unionByName(
        other_found, allowMissingColumns=True
    )
    filled = copy_donor_rows(settle(borrowers), own, "facility_id", MIX).withColumnRenamed(
        "donor_id", "filled_from_facility_id"
    )
    heli = fill_constant_mix(ops.where(is_heli))
    left_over = needy.where(~F.coalesce(
        group.isin("TASP", "Military", "Farm/Ranch", "Other_PU_Airports", "Other_PR_Airports"), F.lit(False)
    ))
    everything = filled
    for piece in (own, heli, left_over):
        everything = everything.unionByName(piece, allowMissingColumns=True)
    return lookup(everything.drop("_place"), default_engine(equipment), ["airframe_id"])


def facility_fleet(fleet: DataFrame) -> DataFrame:
    """Shares collapsed to facility, airframe and engine, with operations."""
    keys = ["facility_id", "airframe_id", "engine_id"]
    firsts = ["annual_operations", "anp_airplane_id", "anp_helicopter_id", "aircraft_id"]
    one = first_known(fleet, keys, ["aircraft_id", "annual_operations"], firsts, fleetmix="fleetmix")
    return one.withColumns({
        "ops_fleet": F.col("annual_operations") * F.col("fleetmix"),
        "anp_id": F.coalesce("anp_airplane_id", "anp_helicopter_id"),
    })


def unit_fleet(fleet: DataFrame, stand_in: str, facility_types: Sequence[str]) -> DataFrame:
    """All equipment of a group under one stand-in facility, two operations each."""
    rows = fleet.where(F.col("facility_type").isin(*facility_types)).withColumn("facility_id", F.lit(stand_in))
    one = first_known(
        rows, ["facility_id", "airframe_id", "engine_id"], ["aircraft_id", "annual_operations"],
        ["annual_operations", "anp_airplane_id", "anp_helicopter_id"],
    )
    return one.withColumns({
        "anp_id": F.coalesce("anp_airplane_id", "anp_helicopter_id"),
        "ops_fleet": F.lit(2.0), "fleetmix": F.lit(None).cast("double"),
    })


def reported_fleet_mix(
    reported: DataFrame, annual_operations: Column, airframes: DataFrame, engines: DataFrame,
    equipment: DataFrame, facility_id: str,
) -> DataFrame:
    """Mix from reported counts by airframe and engine name."""
    counts = group_sums(reported, ["airframe", "engine"], operation_count="operation_count")
    mix = share_of_total(counts, "operation_count", "fleetmix").drop("operation_count")
    ids = first_known(
        equipment, ["airframe_id", "engine_id"], ["anp_airplane_id", "anp_helicopter_id"],
        ["anp_airplane_id", "anp_helicopter_id"],
    )
    out = lookup(mix, airframes, {"airframe": "model"}, ["airframe_id"])
    out = lookup(out, engines, {"engine": "engine_code"}, ["engine_id"])
    return lookup(out, ids, ["airframe_id", "engine_id"]).withColumns(
        {"annual_operations": annual_operations, "facility_id": F.lit(facility_id)}
    )


def spread_list(facilities: DataFrame, items: DataFrame, size: int = LIST_BLOCK) -> DataFrame:
    """Every facility with every entry of an equipment list.

    The list is cut into blocks of about ``size`` entries, one row each; a facility names
    the blocks that there are and takes their entries from the rows. However long the list,
    no row holds all of it, and however many facilities, there is a key for each block. The
    facilities are dealt over all tasks before their rows multiply.
    """
    columns = items.columns
    items = settle(items)
    facilities = facilities.repartition(shuffle_width(facilities.sparkSession), *facilities.columns)
    entry = F.struct(*columns)
    blocks = items.agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("_blocks"))
    lists = with_scalars(items, blocks).groupBy(F.pmod(F.xxhash64(*columns), F.col("_blocks")).cast("int").alias("_block")).agg(
        F.collect_list(entry).alias("_entries"))
    named = with_scalars(facilities, blocks).where("_blocks > 0").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rest = [c for c in facilities.columns if c not in columns]
    return named.join(lists, "_block").select(*rest, F.inline("_entries"))


def military_heli_fleet(rates: DataFrame, engines: DataFrame, airframes: DataFrame, facilities: DataFrame) -> DataFrame:
    """Equipment named in the rates, in shares of one third, at every facility."""
    names = rates.select("equipment_type").distinct()
    heli = F.split_part("equipment_type", F.lit("/"), F.lit(1))
    engine = F.split_part("equipment_type", F.lit("/"), F.lit(2))
    frame = first_rule([(heli == k, v) for k, v in MILITARY_HELICOPTERS.items()], F.lit(None).cast("int"))
    items = names.select(
        heli.alias("anp_helicopter_id"), engine.alias("engine_code"), frame.alias("airframe_id")
    )
    items = lookup(items, engines, ["engine_code"], ["engine_id"], "inner")
    items = lookup(items, airframes, ["airframe_id"], ["model"], "inner").withColumn("fleetmix", F.lit(1.0 / 3))
    return spread_list(facilities, items)


def farm_list(rates: DataFrame, engines: DataFrame, airframes: DataFrame) -> DataFrame:
    """Equipment named in the rates, in equal shares."""
    frame, engine = right_split("equipment_type", "/")
    names = rates.select("equipment_type").distinct().where(F.col("equipment_type") != FUEL_TRUCK)
    items = names.select(frame.alias("model"), engine.alias("engine_code"))
    items = lookup(items, engines, ["engine_code"], ["engine_id"], "inner")
    items = lookup(items, airframes, ["model"], ["airframe_id"])
    items = settle(items)
    return with_scalars(items, items.agg(ratio(F.lit(1.0), F.count(F.lit(1))).alias("fleetmix")))


def farm_fleet(rates: DataFrame, engines: DataFrame, airframes: DataFrame, facilities: DataFrame) -> DataFrame:
    """Equipment named in the rates, in equal shares, at every facility."""
    return spread_list(facilities, farm_list(rates, engines, airframes)).withColumn("label", F.col("model"))


def epa_code_map(codes: DataFrame, equipment: DataFrame, engines: DataFrame, keep_all_agreeing: bool = True) -> DataFrame:
    """Equipment code to airframe and engine; clashes settled by the code's own
    engine id, else by the lowest engine id.

    ``codes``: code, airframe_code, edms_id, engine. ``engines``: engine_id, engine.
    """
    ids = first_known(
        equipment, ["airframe_id", "engine_id"], ["anp_airplane_id", "anp_helicopter_id"],
        ["anp_airplane_id", "anp_helicopter_id"],
    )
    named = lookup(ids, engines, ["engine_id"], ["engine"])
    known = codes.where(F.col("code") <= GENERIC_CODE)
    found = known.join(
        named.withColumnRenamed("airframe_id", "airframe_code"), ["airframe_code", "engine"], "left"
    )
    return resolve_ambiguous(
        found, "code", F.col("edms_id") == F.col("engine_id"), "engine_id", keep_all_agreeing
    ).withColumnRenamed("airframe_code", "airframe_id")


def coded_fleet(ltos: DataFrame, code_map: DataFrame) -> DataFrame:
    """Fleet of each facility from LTOs by equipment code; shares are taken before
    the generic codes are set aside. ``ltos``: facility_id, code, lto."""
    sums = group_sums(ltos, ["facility_id", "code"], lto="lto")
    shares = share_of_group(sums, ["facility_id"], "lto", "fleetmix", "_all").withColumn(
        "annual_operations", F.col("_all") * 2
    ).drop("_all")
    known = shares.where(F.col("code") <= GENERIC_CODE)
    return split_join(known, code_map, ["code"], "left").withColumn("facility_id", clean_key("facility_id"))


