"""Performance inputs: profiles, equipment dimensions, tracks, arrival/departure split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyledger.functions.numbers import half_even
from skyledger.functions.rules import valid_on
from skyledger.operators.joins import lookup
from skyledger.operators.measures import redistribute
from skyledger.operators.ranking import first_per_group, numbered, pair_ids, tied_at_extreme
from skyledger.operators.skew import split_join
from skyledger.session import settle

APU_MINUTES = 13.0
MOST_LOST_OPS = 1000.0
BLOCK_ROWS = 1000  # operations per nested row


def _usable_profiles(profiles: DataFrame, key: str) -> DataFrame:
    """Arrival and departure profiles: the standard ones, and all profiles of
    aircraft that have no standard one."""
    moves = profiles.where(F.col("op_type").isin("A", "D")).withColumnRenamed(key, "acft_id")
    standard = moves.where(F.col("prof_id1") == "STANDARD")
    others = moves.join(standard.select("acft_id"), "acft_id", "left_anti")
    return standard.unionByName(others)


def clean_profiles(airplanes: DataFrame, helicopters: DataFrame) -> DataFrame:
    """Profiles at the longest stage of each aircraft and operation, ties kept.

    Stage ids compare as text, so ``M`` is above every digit.
    """
    planes = _usable_profiles(airplanes, "acft_id")
    helis = helicopters.where(
        F.col("op_type").isin("A", "D") & (F.col("prof_id1") == "STANDARD")
    ).withColumnRenamed("helo_id", "acft_id")

    def longest(df: DataFrame) -> DataFrame:
        return tied_at_extreme(df, ["acft_id", "op_type"], "prof_id2").select(
            "acft_id", "op_type", F.col("prof_id1").alias("profile"),
            F.col("prof_id2").alias("stage_len"), "weight",
        )

    return longest(planes).unionByName(longest(helis))


def first_profiles(profiles: DataFrame, key: str = "acft_id") -> DataFrame:
    """Older rule: the profile with the lowest profile id."""
    return first_per_group(
        _usable_profiles(profiles, key), ["acft_id", "op_type"], [F.col("profile_id"), F.col("prof_id2")]
    ).select(
        "acft_id", "op_type", F.col("prof_id1").alias("profile"), F.col("prof_id2").alias("stage_len"), "weight"
    )


def equipment_dims(engines: DataFrame, airframes: DataFrame, apu: DataFrame, apu_defaults: DataFrame) -> dict[str, DataFrame]:
    """Engine, airframe and APU dimensions, one row per key each."""
    units = lookup(apu, apu_defaults, ["apu_id"], ["apu_name"], "inner")
    return {
        "engines": engines.select("engine_id", "engine_code"),
        "airframes": airframes.select("airframe_id", F.col("model").alias("arfm_mod")),
        "apu": units.select("airframe_id", "apu_id", "apu_name", "user_defined"),
    }


def with_equipment(ops: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    out = lookup(ops, dims["engines"], ["engine_id"])
    out = lookup(out, dims["airframes"], ["airframe_id"])
    return lookup(out, dims["apu"], ["airframe_id"])


def track_layout(
    tracks: DataFrame, runway_ends: DataFrame, subtracks: DataFrame, segments: DataFrame,
    layouts: DataFrame, codes: DataFrame, mains: DataFrame, day: str = "2019-01-01", open_ended: bool = False,
) -> dict[str, DataFrame]:
    """Tracks (lowest valid id per operation and aircraft kind, with runway and
    segments) and the one airport layout valid on the day.

    ``open_ended`` leaves the expiry date out of the test.
    """
    now = valid_on(day, "eff_date", None if open_ended else "exp_date")
    first = tied_at_extreme(
        tracks.where(now).select("aircraft_type", "track_id", "rwy_end_id", "track_name", "op_type"),
        ["op_type", "aircraft_type"], "track_id", largest=False,
    )
    full = lookup(first, runway_ends, ["rwy_end_id"], ["rwy_end_name"])
    full = full.join(subtracks.select("subtrack_id", "track_id", "subtrack_num"), "track_id", "left")
    full = full.join(
        segments.select(
            "segment_id", "subtrack_id", "segment_num", "segment_type",
            F.col("param_1").alias("dist_or_rad"), F.col("param_2").alias("turn_angle"),
        ),
        "subtrack_id", "left",
    )
    preferred = codes.where(F.lower("preferred") == "y").select(F.col("apt_id"), "apt_code")
    layout = layouts.where(now).withColumnRenamed("airport_id", "apt_id")
    layout = layout.join(preferred, "apt_id").join(mains.drop("eff_date", "exp_date"), "apt_id")
    return {"track": full, "layout": only_row(layout, "layouts valid on the day")}


def only_row(df: DataFrame, what: str) -> DataFrame:
    """The one row of ``df``; none or several are an error."""
    n = F.count(F.lit(1))
    row = F.when(n == 1, F.max(F.struct(*df.columns))).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), n.cast("string"))))
    return df.agg(row.alias("_row")).select("_row.*")


def attach_profiles(
    ops: DataFrame, profiles: DataFrame, most_lost: float | None = MOST_LOST_OPS
) -> dict[str, DataFrame]:
    """Profiles of each aircraft; operations of aircraft without one go to the rest.

    More than ``most_lost`` operations lost at a facility is an error. ``marked`` is the
    written table of all operations, in which later steps may look for hot keys.
    """
    profiles = settle(profiles)  # the list of profiles is short, and its written size tells so
    have = profiles.select(F.col("acft_id").alias("anp_id"), F.lit(True).alias("_has")).distinct()
    marked = settle(ops.join(have, "anp_id", "left"))
    adjusted = redistribute(marked, ["facility_id"], F.col("_has"), "fleetmix", "ops_fleet", marked)
    if most_lost is not None:
        adjusted = adjusted.withColumn(
            "lost_ops",
            F.when(
                F.col("lost_ops") > most_lost, F.raise_error(F.lit("too many operations without a profile")).cast("double")
            ).otherwise(F.col("lost_ops")),
        )
    data = split_join(
        adjusted.drop("_has"), profiles.withColumnRenamed("acft_id", "anp_id"), ["anp_id"], "inner", marked
    )
    return {"data": data, "dropped": marked.where("_has is null").drop("_has"), "marked": marked}


def split_arr_dep(data: DataFrame, strict: bool = True, sketch_of: DataFrame | None = None) -> DataFrame:
    """LTOs of the arrival and departure row of each unit, and the pair's id.

    LTO = operations over the unit's rows, rounded half to even. ``strict`` fails
    when a unit does not have exactly two rows. ``sketch_of`` is a plainer table with
    the same facilities.
    """
    unit = ["facility_id", "airframe_id", "engine_id"]
    whole = F.col("facility_id").isNotNull() & F.col("airframe_id").isNotNull() & F.col("engine_id").isNotNull()
    counted = data.withColumn("op_counts", F.count("op_type").over(Window.partitionBy(*unit)))  # a unit has two rows
    counted = counted.withColumn("op_counts", F.when(whole, F.col("op_counts")))
    if strict:
        counted = counted.withColumn(
            "op_counts",
            F.when(F.col("op_counts") == 2, F.col("op_counts")).otherwise(
                F.raise_error(F.lit("a unit lacks an arrival or a departure")).cast("bigint")
            ),
        )
    ltos = counted.withColumn("ltos", half_even(F.try_divide("ops_fleet_adj", "op_counts")))
    return pair_ids(
        ltos if sketch_of is not None else settle(ltos), ["facility_id"],
        [("ltos", False), ("arfm_mod", True), ("engine_code", True), ("op_type", True)], sketch_of=sketch_of,
    )


def scenario_nested(
    ltos: DataFrame, tracks: DataFrame, minutes: float = APU_MINUTES, block: int = BLOCK_ROWS,
    sketch_of: DataFrame | None = None,
) -> DataFrame:
    """Per facility, aircraft kind and operation: the track and the operations.

    A long list is cut into blocks of ``block`` operations (``block_no``), so that
    no row and no task holds an unbounded list. Facilities without helicopters
    have no helicopter rows. ``sketch_of`` is a plainer table with the same facilities.
    """
    kind = F.when(F.col("anp_helicopter_id").isNotNull(), 1).otherwise(0)
    typed = ltos.withColumn("aircraft_type", kind)
    rows = numbered(
        typed if sketch_of is not None else settle(typed), ["facility_id", "aircraft_type", "op_type"],
        [("ids", True), ("airframe_id", True), ("engine_id", True)], "_no", sketch_of,
    ).withColumn("block_no", F.floor((F.col("_no") - 1) / block).cast("int"))
    track = tracks.groupBy("aircraft_type", "op_type").agg(
        F.min_by(
            F.struct("track_name", "rwy_end_name", "segment_type", "dist_or_rad"),
            F.struct("track_id", "subtrack_num", "segment_num"),
        ).alias("track")
    )
    has_apu: Column = F.col("apu_name").isNotNull()
    operation = F.struct(
        F.col("_no").alias("no"),
        F.concat(F.col("op_type"), F.col("ids").cast("string")).alias("id"),
        F.col("arfm_mod").alias("airframe_model"), "engine_code", "apu_name",
        F.when(has_apu & (F.col("op_type") == "A"), minutes).alias("arrival_apu_time"),
        F.when(has_apu & (F.col("op_type") == "D"), minutes).alias("departure_apu_time"),
        F.col("ltos").alias("num_operations"), "profile", "stage_len",
    )
    return (
        rows.groupBy("facility_id", "aircraft_type", "op_type", "block_no")
        .agg(F.array_sort(F.collect_list(operation)).alias("operations"))
        .join(track, ["aircraft_type", "op_type"], "left")
    )


# Names of the scenario's elements in its text form.
OPERATION_ELEMENTS = {
    "no": "no", "id": "id", "airframe_model": "airframeModel", "engine_code": "engineCode", "apu_name": "apuName",
    "arrival_apu_time": "arrivalApuTime", "departure_apu_time": "departureApuTime", "num_operations": "numOperations",
    "profile": "saeProfile", "stage_len": "stageLength",
}
SCENARIO_XML = (
    "optype string, aircraftType int, blockNo int, "
    "track struct<trackName: string, runwayEnd: string, segmentType: string, distOrRad: double>, "
    "operations struct<operation: array<struct<no: bigint, id: string, airframeModel: string, engineCode: string, apuName: string, "
    "arrivalApuTime: double, departureApuTime: double, numOperations: double, saeProfile: string, stageLength: string>>>"
)


def scenario_xml(nested: DataFrame) -> DataFrame:
    """(facility_id, xml): each row of ``scenario_nested`` as one ``trackOpSet`` element."""
    operations = F.transform("operations", lambda o: F.struct(*[o[c].alias(e) for c, e in OPERATION_ELEMENTS.items()]))
    track = F.struct(
        F.col("track.track_name").alias("trackName"), F.col("track.rwy_end_name").alias("runwayEnd"),
        F.col("track.segment_type").alias("segmentType"), F.col("track.dist_or_rad").cast("double").alias("distOrRad"))
    whole = F.struct(
        F.col("op_type").alias("optype"), F.col("aircraft_type").alias("aircraftType"), F.col("block_no").alias("blockNo"),
        track.alias("track"), F.struct(operations.alias("operation")).alias("operations"))
    return nested.select("facility_id", F.to_xml(whole, {"rowTag": "trackOpSet", "nullValue": ""}).alias("xml"))


def read_scenario_xml(texts: DataFrame) -> DataFrame:
    """The operations of ``scenario_xml`` texts, a row each; a text that does not fit the form is an error."""
    parsed = F.from_xml("xml", SCENARIO_XML, {"rowTag": "trackOpSet", "mode": "FAILFAST", "nullValue": ""})
    names = {e: c for c, e in OPERATION_ELEMENTS.items()}
    return texts.withColumn("_s", parsed).select(
        "facility_id", F.col("_s.optype").alias("op_type"), F.col("_s.aircraftType").alias("aircraft_type"), F.col("_s.blockNo").alias("block_no"),
        F.col("_s.track.trackName").alias("track_name"), F.explode_outer("_s.operations.operation").alias("_o"),
    ).select("facility_id", "op_type", "aircraft_type", "block_no", "track_name", *[F.col(f"_o.{e}").alias(c) for e, c in names.items()])


def stage_apu_lookup(fleet: DataFrame, profiles: DataFrame, apu: DataFrame) -> DataFrame:
    """Fleet with operations, standard profiles and APU."""
    ops = fleet.withColumn("ops_fleet", F.col("annual_operations") * F.col("fleetmix"))
    standard = profiles.where(F.col("prof_id1") == "STANDARD").withColumnRenamed("acft_id", "anp_airplane_id")
    with_stage = split_join(ops, standard, ["anp_airplane_id"], "left")
    return lookup(with_stage, apu, ["airframe_id"])
