"""Emission rates joined to fleets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyledger.functions.numbers import ratio
from skyledger.functions.rules import first_rule
from skyledger.functions.text import joined, right_split
from skyledger.operators.joins import drop_listed, lookup
from skyledger.operators.measures import reshare
from skyledger.operators.ranking import first_per_group
from skyledger.operators.skew import attach_totals, hot_keys, split_join, with_scalars
from skyledger.plans.fleet import farm_list, military_heli_fleet, spread_list
from skyledger.session import settle

# Fixed values.
FLIGHT_MODES = ("Climb Below Mixing Height", "Descend Below Mixing Height")
GROUND_MODES = ("GSE LTO", "APU")
MODES = FLIGHT_MODES + GROUND_MODES
TAXI_MODES = MODES + ("Taxi Out", "Taxi In")
FLOAT_PLANE = "Cessna 182 Float"
# airframe_engine pairs without a profile, by class.
OMITTED = {
    "fandr_arpt": ("4784_1205", "4779_1205"),
    "mil_arpt": ("4894_1224", "4896_1270", "4911_1564", "4922_1678", "5359_1562"),
    "opra_arpt": (),
    "opua_arpt": ("4894_1224", "4922_1678"),
    "tasp_arpt": ("4894_1224", "4896_1270", "4911_1564", "4922_1678", "5175_1743"),
}
SELF_REPORTING = ("hou", "iah", "efd")
# Airframe ids missing from the equipment tables.
EXTRA_AIRFRAMES = {"A109": 5238, "EC130": 5177}
EXTRA_AIRFRAMES_2020 = {**EXTRA_AIRFRAMES, "B407": 5079}


def filter_modes(rates: DataFrame, modes: Sequence[str] = MODES) -> DataFrame:
    return rates.where(F.col("mode").isin(*modes))


def heli_emissions(fleet: DataFrame, rates: DataFrame, engines: DataFrame, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(fleet, emissions) of heliports: equipment is helicopter id / engine code.

    ``keys`` are further columns (a class) on which fleet and rates must agree.
    """
    if "engine_code" not in fleet.columns:
        fleet = lookup(fleet, engines, ["engine_id"], ["engine_code"])
    ops = F.col("annual_operations") * F.col("fleetmix")
    out = fleet.withColumns({
        "equipment_type": joined("anp_helicopter_id", "engine_code", sep="/"),
        "ops": ops, "ltos": ops / 2,
    })
    return out, split_join(out, rates.drop("num_ops"), [*keys, "equipment_type"], "left")


def airport_units(
    fleet: DataFrame, engines: DataFrame, airframes: DataFrame, omitted: Mapping[str, Sequence[str]] | Sequence[str],
) -> DataFrame:
    """The units that stay, with label and equipment: omitted airframe_engine pairs and the float plane go."""
    pair = joined("airframe_id", "engine_id", sep="_")
    if isinstance(omitted, Mapping):
        for name, pairs in omitted.items():
            if pairs:
                listed = (F.col("fac_class") == name) & pair.isin(*pairs)
                fleet = fleet.where(~F.coalesce(listed, F.lit(False)))
    else:
        fleet = drop_listed(fleet, pair, omitted)
    if "engine_code" not in fleet.columns:
        fleet = lookup(fleet, engines, ["engine_id"], ["engine_code"])
    if "model" not in fleet.columns:
        fleet = lookup(fleet, airframes, ["airframe_id"], ["model"])
    label = F.col("label") if "label" in fleet.columns else F.coalesce("anp_helicopter_id", "model")
    kept = fleet.withColumn("label", label).where(F.coalesce(F.col("model") != FLOAT_PLANE, F.lit(True)))
    return kept.withColumn("equipment_type", joined(F.lower("label"), F.lower("engine_code"), sep="/"))


def airport_fleet(
    fleet: DataFrame, engines: DataFrame, airframes: DataFrame, omitted: Mapping[str, Sequence[str]] | Sequence[str],
    filled_source: str = "donor", own_source: str = "traffic",
) -> DataFrame:
    """Fleet of airports ready for the rates.

    Omitted airframe_engine pairs and the float plane go, shares are scaled back
    to one, equipment is named by airframe model (airplanes) or helicopter id.
    ``omitted`` may be a list, or a list per ``fac_class``.
    """
    kept = airport_units(fleet, engines, airframes, omitted)
    out = reshare(kept, ["facility_id"], "fleetmix", "annual_operations", "ops")
    source = F.lit(filled_source)
    if "filled_from_facility_id" in fleet.columns:
        source = F.when(F.col("filled_from_facility_id").isNull(), own_source).otherwise(filled_source)
    return out.withColumns({"ltos": F.col("ops") / 2, "source": source})


def flight_rates(rates: DataFrame, order: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """Rates of the flight modes, one row per (departure airport, equipment, mode)."""
    flights = rates.where(~F.col("mode").isin(*GROUND_MODES)).withColumn(
        "equipment_type", F.lower("equipment_type")
    )
    return first_per_group(
        flights, [*keys, "departure_airport", "equipment_type", "mode"], order
    ).drop("num_ops")


def airport_emissions(
    fleet: DataFrame, rates: DataFrame, order: Sequence[Column], keys: Sequence[str] = ()
) -> DataFrame:
    """Rates of each fleet row; the fleet comes from ``airport_fleet``."""
    return split_join(settle(fleet), flight_rates(rates, order, keys), [*keys, "equipment_type"], "left")


def noncommercial_inventory(
    classed_ops: DataFrame, fleet: DataFrame, rates: DataFrame, engines: DataFrame, airframes: DataFrame,
    order: Sequence[Column], modes: Sequence[str] = MODES, omitted: Mapping[str, Sequence[str]] = OMITTED,
) -> tuple[DataFrame, DataFrame]:
    """(fleet, emissions) over all classes.

    ``classed_ops`` comes from ``class_split``; ``fleet`` has facility_id, ids,
    shares; ``rates`` carries ``fac_class``. One pass for all heliport classes and
    one for all airport classes, with the class in the join key.

    All farms have one list of equipment. Its units, rates and sum of shares are worked out
    on the list, and the sum of each farm on its one row; the rows of list and farms are made
    last, so that they meet no further join.
    """
    use = filter_modes(rates, modes)
    facts = classed_ops.select(
        "facility_id", "facility_name", "facility_group", "facility_type", "annual_operations", "fac_class"
    )
    drop = [c for c in ("facility_name", "facility_group", "facility_type", "annual_operations") if c in fleet.columns]
    own = settle(fleet.drop(*drop).join(facts, "facility_id", "inner"))
    is_heli = F.col("fac_class").endswith("_heli")
    of = lambda df, name: df.where(F.col("fac_class") == name)
    engine_codes = engines.select("engine_id", "engine_code")
    heli_rates = settle(use.where(is_heli))
    flights = settle(flight_rates(use.where(~is_heli), order, ["fac_class"]))
    # The two classes whose fleet comes from the rates themselves.
    military = military_heli_fleet(of(heli_rates, "mil_heli"), engines, airframes, of(facts, "mil_heli"))
    heli = settle(own.where(is_heli & (F.col("fac_class") != "mil_heli")).unionByName(military, allowMissingColumns=True))
    heli_fleet, heli_emis = heli_emissions(
        lookup(heli.drop("engine_code"), engine_codes, ["engine_id"]), heli_rates, engines, ["fac_class"]
    )
    heli_fleet = heli_fleet.withColumn("source", F.lit("generic helicopters"))
    heli_emis = heli_emis.withColumn("source", F.lit("generic helicopters"))

    port = own.where(~is_heli & (F.col("fac_class") != "fandr_arpt"))
    port = airport_units(lookup(port, engine_codes, ["engine_id"]), engines, airframes, omitted)
    items = farm_list(of(use, "fandr_arpt"), engines, airframes).drop("engine_code", "model").withColumns({
        "fac_class": F.lit("fandr_arpt"), "anp_helicopter_id": F.lit(None).cast("string")})
    items = settle(airport_units(lookup(items, engine_codes, ["engine_id"]), engines, airframes, omitted))
    farms = of(facts, "fandr_arpt")
    sums = port.select("facility_id", "fleetmix").unionByName(
        with_scalars(farms.select("facility_id"), items.agg(F.sum("fleetmix").alias("fleetmix")))
    ).groupBy("facility_id").agg(F.sum("fleetmix").alias("_whole"))
    port = split_join(port, sums, ["facility_id"], "left", own)
    farms = farms.join(sums, "facility_id", "left")

    def shared(df: DataFrame) -> DataFrame:
        """Shares of the facility's sum, and operations from them."""
        out = df.withColumn("fleetmix", ratio("fleetmix", "_whole")).drop("_whole")
        ops = F.col("fleetmix") * F.col("annual_operations")
        return out.withColumns({"ops": ops, "ltos": ops / 2, "source": F.lit("donor")})

    unit = ["fac_class", "equipment_type"]
    port_fleet = shared(port).unionByName(shared(spread_list(farms, items)), allowMissingColumns=True)
    port_emis = shared(lookup(port, flights, unit)).unionByName(
        shared(spread_list(farms, lookup(items, flights, unit))), allowMissingColumns=True)
    return (
        heli_fleet.unionByName(port_fleet, allowMissingColumns=True),
        heli_emis.unionByName(port_emis, allowMissingColumns=True),
    )


def noncommercial_coverage(
    classed_ops: DataFrame, fleet: DataFrame, emissions: DataFrame, rate: str = "co_st",
) -> DataFrame:
    """(facility_id, fac_class, covered_by, units, units_without_rates): every facility of the classes, once.

    ``fleet`` and ``emissions`` come from ``noncommercial_inventory``. ``covered_by`` is ``fleet``
    if some unit has rates, else what is missing: ``no rates``, ``no fleet`` or ``no class``.
    A facility that the inventory leaves out is a row here.
    """
    unit = ["facility_id", "equipment_type"]
    known = F.col(rate).isNotNull() & F.col("facility_id").isNotNull() & F.col("equipment_type").isNotNull()
    seen = fleet.select(*unit, F.lit(1).alias("_unit"), F.lit(0).alias("_rated")).unionByName(
        emissions.where(known).select(*unit, F.lit(0).alias("_unit"), F.lit(1).alias("_rated")))
    units = seen.groupBy(*unit).agg(F.max("_unit").alias("_unit"), F.max("_rated").alias("_rated")).where("_unit = 1").groupBy(
        "facility_id").agg(F.count(F.lit(1)).alias("units"), F.count_if(F.col("_rated") == 0).alias("units_without_rates"))
    every = classed_ops.select("facility_id", "fac_class").distinct().join(units, "facility_id", "left").fillna(0, ["units", "units_without_rates"])
    state = first_rule([
        (F.col("fac_class").isNull(), "no class"), (F.col("units") == 0, "no fleet"),
        (F.col("units") == F.col("units_without_rates"), "no rates"),
    ], F.lit("fleet"))
    return every.select("facility_id", "fac_class", state.alias("covered_by"), "units", "units_without_rates")


def equipment_lookup(
    rates: DataFrame, engines: DataFrame, airframes: DataFrame, extra: Mapping[str, int] = EXTRA_AIRFRAMES
) -> DataFrame:
    """Ids of the equipment named in the climb rows: airframe model / engine code."""
    model, engine = right_split("equipment_type", "/")
    names = rates.where(F.col("mode") == FLIGHT_MODES[0]).select("equipment_type").distinct()
    items = names.select("equipment_type", model.alias("arfm_mod"), engine.alias("engine_code"))
    items = lookup(items, engines, ["engine_code"], ["engine_id"], "inner")
    items = lookup(items, airframes, {"arfm_mod": "model"}, ["airframe_id"])
    manual = first_rule([(F.col("arfm_mod") == k, v) for k, v in extra.items()], F.col("airframe_id"))
    return items.withColumn("airframe_id", manual)


def scaled_by_joins(rows: DataFrame, order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """(fleet, emissions): LTOs scaled so that a facility's operations add up to its annual operations, also where a facility is hot."""
    rows = settle(rows)
    air = rows.where(~F.col("mode").isin(*GROUND_MODES))
    units = settle(first_per_group(air, ["facility_id", "equipment_type"], order))
    # The correction is one number per facility, taken from its units.
    factors = units.groupBy("facility_id").agg(
        F.try_divide(F.max("annual_operations"), F.sum("ltos") * 2).alias("_factor")
    )
    scaled = split_join(rows, factors, ["facility_id"], "left").withColumn(
        "ltos", F.col("ltos") * F.col("_factor")
    ).drop("_factor")
    fleet = split_join(units, factors, ["facility_id"], "left").withColumn(
        "ltos", F.col("ltos") * F.col("_factor")
    ).withColumn("ops", F.col("ltos") * 2).drop("_factor")
    fleet = fleet.withColumn("fleetmix", F.try_divide("ops", "annual_operations"))
    emissions = split_join(
        scaled, fleet.select("facility_id", "equipment_type", "fleetmix", "ops"), ["facility_id", "equipment_type"], "left", rows,
    )
    return fleet, emissions


def scaled_by_windows(rows: DataFrame, order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """The same in windows of the facility and of its equipment, for tables in which no facility is hot."""
    unit, place = Window.partitionBy("facility_id", "equipment_type"), Window.partitionBy("facility_id")
    factor = lambda annual, ltos: F.when(F.col("facility_id").isNotNull(), F.try_divide(
        F.max(annual).over(place), F.sum(ltos).over(place) * 2))
    air = ~F.col("mode").isin(*GROUND_MODES)
    order = [*order, F.col("ltos"), F.col("annual_operations")]  # both tables below take the same row as first
    units = first_per_group(rows.where(air), ["facility_id", "equipment_type"], order)
    fleet = units.withColumn("_factor", factor(F.col("annual_operations"), F.col("ltos"))).withColumn(
        "ltos", F.col("ltos") * F.col("_factor")).withColumn("ops", F.col("ltos") * 2).drop("_factor")
    fleet = fleet.withColumn("fleetmix", F.try_divide("ops", "annual_operations"))

    at = F.row_number().over(unit.orderBy(air.desc(), *order))
    marked = rows.withColumn("_first", (at == 1) & air)
    of_first = lambda c: F.when(F.col("_first"), F.col(c))
    known = F.col("facility_id").isNotNull() & F.col("equipment_type").isNotNull()
    marked = marked.withColumns({
        "_ltos": F.when(known, F.max(of_first("ltos")).over(unit)), "_annual": F.when(known, F.max(of_first("annual_operations")).over(unit))})
    marked = marked.withColumn("_factor", factor(of_first("annual_operations"), of_first("ltos")))
    emissions = marked.withColumns({"ltos": F.col("ltos") * F.col("_factor"), "ops": F.col("_ltos") * F.col("_factor") * 2})
    emissions = emissions.withColumn("fleetmix", F.try_divide("ops", "_annual"))
    return fleet, emissions.drop("_first", "_ltos", "_annual", "_factor")


def commercial_inventory(
    rates: DataFrame, scenario: DataFrame, ops: DataFrame, engines: DataFrame, airframes: DataFrame,
    order: Sequence[Column], self_reporting: Sequence[str] = SELF_REPORTING,
    extra: Mapping[str, int] = EXTRA_AIRFRAMES, modes: Sequence[str] = MODES,
) -> tuple[DataFrame, DataFrame]:
    """(fleet, emissions) of facilities with their own rate tables.

    ``rates`` holds all facilities, with ``facility_id`` (from the file name).
    Simulated facilities find their equipment by user id in ``scenario``;
    self-reporting ones by equipment name, and their annual operations are half
    of the flights they report. LTOs are then scaled so that a facility's
    operations add up to its annual operations.
    """
    reports = F.col("facility_id").isin(*self_reporting) if self_reporting else F.lit(False)
    keys = ["facility_id", "user_id"]
    inputs = scenario.withColumn("user_id", joined("op_type", "ids")).select(
        *keys, "airframe_id", "arfm_mod", "aircraft_id", "engine_id", "engine_code"
    )
    facts = ops.select("facility_id", "facility_name", "facility_group", "facility_type", "annual_operations")
    told = settle(rates.where(reports))
    flights = F.col("mode").isin(*FLIGHT_MODES)
    named = split_join(told, equipment_lookup(told, engines, airframes, extra), ["equipment_type"], "left")
    named = lookup(named, facts.drop("annual_operations"), ["facility_id"])
    named = attach_totals(
        named, ["facility_id"], annual_operations=F.sum(F.when(flights, F.col("num_ops"))) / 2
    ).withColumn("source", F.lit("reported"))

    use = filter_modes(rates.where(~reports), modes)
    even = not hot_keys(rates, ["facility_id"])
    if even:  # one layout by the facility serves all joins and windows below
        use, inputs = use.repartition("facility_id"), inputs.repartition("facility_id")
        simulated = use.join(inputs, keys, "left")
    else:
        simulated = split_join(use, inputs, keys, "left")
    simulated = lookup(simulated, facts, ["facility_id"]).withColumn("source", F.lit("traffic"))

    def stays(rows: DataFrame) -> DataFrame:
        rows = filter_modes(rows, modes).where(F.coalesce(F.col("arfm_mod") != FLOAT_PLANE, F.lit(True)))
        return rows.withColumnRenamed("num_ops", "ltos")

    # A facility is simulated or reports itself, so each of the two is scaled apart.
    scale = scaled_by_windows if even else scaled_by_joins
    (fleet, emissions), (other, others) = scale(stays(simulated), order), scale(settle(stays(named)), order)
    fleet = fleet.unionByName(other, allowMissingColumns=True)
    emissions = emissions.unionByName(others, allowMissingColumns=True)
    columns = [
        "facility_id", "facility_name", "facility_group", "facility_type", "annual_operations", "airframe_id",
        "aircraft_id", "engine_id", "engine_code", "equipment_type", "fleetmix", "ops", "ltos", "source",
    ]
    return fleet.select(*columns), emissions
