"""Summaries and report tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skyledger.functions.names import select_existing, title_columns
from skyledger.functions.numbers import daily_from_annual
from skyledger.functions.rules import not_in
from skyledger.functions.text import degrees, recode, recode_or_null, title
from skyledger.operators.joins import lookup
from skyledger.operators.measures import group_sums, sliced_sum
from skyledger.operators.ranking import category_rank, first_per_group
from skyledger.operators.reshape import pivot_unique, two_grain

# Pollutants, source classes in report order, code changes.
SUMMARY_POLLUTANTS = ("VOC", "NOX", "CO", "PM10", "PM2.5", "SO2", "Pb")
SUMMARY_NAMES = {"NOX": "NOx"}
CLASS_ORDER = (
    "Commercial Aviation", "Air Taxi: Piston", "Air Taxi: Turbine", "General Aviation: Piston",
    "General Aviation: Turbine", "Military", "APU", "GSE: Gasoline-fueled", "GSE: Diesel-fueled",
)
PARTICLE_CODES = {"PM2.5": "PM25-PRI", "PM10": "PM10-PRI"}
LTO_POLLUTANTS = ("CO", "CO2", "VOC", "NOX", "SO2", "PM25-PRI", "PM10-PRI", "Pb")
DASHBOARD_POLLUTANTS = ("CO", "CO2", "NH3", "NOX", "PM10", "PM2.5", "Pb", "SO2", "VOC")
INVENTORY_MODES = ("Aircraft", "GSE", "APU")
SPECIES_CODES = {"108383 & 106423": "108383+106423"}
SUBSET_COUNTIES = {
    48085: "Collin", 48113: "Dallas", 48121: "Denton", 48139: "Ellis", 48143: "Erath", 48221: "Hood",
    48231: "Hunt", 48251: "Johnson", 48257: "Kaufman", 48349: "Navarro", 48363: "Palo Pinto",
    48367: "Parker", 48397: "Rockwall", 48425: "Somervell", 48439: "Tarrant", 48497: "Wise",
}
EMISSION_SUMS = {"uncontrolled": "uncontrolled_annual_emis_st", "controlled": "controlled_annual_emis_st"}


def summary_pivot(
    agg: DataFrame, keys: Sequence[str], measure: str, class_order: Sequence[str] = CLASS_ORDER,
    pollutants: Sequence[str] = SUMMARY_POLLUTANTS, names: Mapping[str, str] = SUMMARY_NAMES,
) -> DataFrame:
    """One column per pollutant; classes outside the report order lose their label."""
    wide = pivot_unique(agg, keys, "eis_pollutant_id", pollutants, measure)
    rank = category_rank("scc_description", class_order)
    return wide.withColumn("class_rank", rank).withColumn(
        "scc_description", F.when(F.col("class_rank").isNotNull(), F.col("scc_description"))
    ).withColumnsRenamed(dict(names))


def statewide_summary(
    eis: DataFrame, pollutants: Sequence[str] = SUMMARY_POLLUTANTS, class_order: Sequence[str] = CLASS_ORDER,
    left_out: Sequence[str] = ("GSE: Electric",),
) -> dict[str, DataFrame]:
    """Controlled and uncontrolled tons by source class, for the state and per county."""
    use = eis.where(
        not_in("scc_description", left_out) & F.col("eis_pollutant_id").isin(*pollutants)
    ).withColumn("county", title("county"))
    coarse = ["scc", "scc_description", "eis_pollutant_id"]
    state, county = two_grain(use, ["county", *coarse], coarse, EMISSION_SUMS)
    out = {}
    for kind in EMISSION_SUMS:
        out[f"{kind}_state"] = summary_pivot(state, coarse[:2], kind, class_order, pollutants)
        out[f"{kind}_county"] = summary_pivot(county, ["county", *coarse[:2]], kind, class_order, pollutants)
    return out


def emission_lto_summary(
    eis: DataFrame, modes: Sequence[str] = INVENTORY_MODES, pollutants: Sequence[str] = LTO_POLLUTANTS,
    codes: Mapping[str, str] = PARTICLE_CODES,
) -> DataFrame:
    """LTOs and tons by facility, mode and pollutant."""
    use = eis.where(F.col("mode").isin(*modes)).withColumn(
        "eis_pollutant_id", recode("eis_pollutant_id", codes)
    ).where(F.col("eis_pollutant_id").isin(*pollutants))
    return group_sums(
        use, ["facility_id", "facility_group", "airport", "mode", "eis_pollutant_id"],
        lto="ltos", uncontrolled="uncontrolled_annual_emis_st", controlled="controlled_annual_emis_st",
    )


def facility_ltos(eis: DataFrame, keys: Sequence[str], pollutant: str = "CO2", mode: str = "Aircraft") -> DataFrame:
    """LTOs repeat per pollutant and mode, so one pollutant and mode is summed."""
    one = (F.col("eis_pollutant_id") == pollutant) & (F.col("mode") == mode)
    return sliced_sum(eis, keys, one, "ltos", "ltos")


def species_names(df: DataFrame, species: DataFrame) -> DataFrame:
    """Pollutant names; a code without a name keeps the code."""
    names = species.select(
        recode("polcode", SPECIES_CODES).alias("eis_pollutant_id"), "pol_nm"
    ).groupBy("eis_pollutant_id").agg(F.min("pol_nm").alias("pol_nm"))
    return lookup(df, names, ["eis_pollutant_id"]).withColumn(
        "pol_nm", F.coalesce("pol_nm", "eis_pollutant_id")
    )


def locations(registry: DataFrame) -> DataFrame:
    """Decimal coordinates of each facility from degree-minute-second text."""
    return registry.select(
        F.lower("facility_id").alias("facility_id"),
        degrees("arp_latitude").alias("latitude"), degrees("arp_longitude").alias("longitude"),
    )


def dashboard_extract(
    eis: DataFrame, registry: DataFrame, species: DataFrame,
    pollutants: Sequence[str] = DASHBOARD_POLLUTANTS, lto_slice: tuple[str, str] = ("CO2", "Aircraft"),
) -> dict[str, DataFrame]:
    """Facility and county tables of yearly tons, and LTOs per facility and year.

    ``eis`` carries ``year`` (from the file name).
    """
    tail = ["scc", "scc_description", "eis_pollutant_id"]
    use = eis.where(F.col("eis_pollutant_id").isin(*pollutants)).withColumn("county", title("county"))
    sums = {k: v for k, v in EMISSION_SUMS.items()}
    facility = group_sums(
        use, ["year", "county", "fip", "facility_id", "airport", "facility_group", "facility_type", *tail], **sums
    )
    county = group_sums(use, ["year", "county", "fip", *tail], **sums)
    return {
        "facility": lookup(species_names(facility, species), locations(registry), ["facility_id"]),
        "county": species_names(county, species),
        "ltos": facility_ltos(eis, ["facility_id", "year"], *lto_slice),
    }


def county_subset_extract(
    eis: DataFrame, species: DataFrame, years: Sequence[int] = (2019, 2020),
    counties: Mapping[int, str] = SUBSET_COUNTIES, lto_slice: tuple[str, str] = ("CO", "Aircraft"),
) -> dict[str, DataFrame]:
    """LTOs with operations, and controlled tons with species names, for some counties.

    ``year``, ``fip`` and ``scc`` are partition columns of the dataset, so the
    first two predicates prune files. Only pollutants that have a name are kept.
    """
    use = eis.where(F.col("year").isin(*years) & F.col("fip").isin(*counties))
    keys = ["year", "fip", "facility_id", "airport", "scc", "scc_description"]
    name = recode_or_null("fip", counties)
    ltos = facility_ltos(use, keys, *lto_slice).withColumns(
        {"operations": F.col("ltos") * 2, "county": name}
    )
    tons = group_sums(use, [*keys, "eis_pollutant_id"], controlled="controlled_annual_emis_st")
    names = species.groupBy("eis_pollutant_id").agg(F.min("pol_nm").alias("pol_nm"))
    return {
        "ltos": ltos,
        "emissions": lookup(tons, names, ["eis_pollutant_id"], how="inner").withColumn("county", name),
    }


def imputation_report(fleet: DataFrame, ops: DataFrame, order: Sequence[Column], own_source: str = "traffic") -> DataFrame:
    """One row per facility whose fleet was borrowed, with its and the donor's district."""
    one = first_per_group(
        fleet.select("facility_id", "facility_group", "filled_from_facility_id", "ops_per_diff", "source"),
        ["facility_id"], order,
    ).where(F.coalesce(F.col("source") != own_source, F.lit(True)))
    districts = ops.select("facility_id", "district")
    out = lookup(one, districts.withColumnRenamed("district", "fac_district"), ["facility_id"])
    return lookup(
        out, districts.withColumnRenamed("district", "donor_district"),
        {"filled_from_facility_id": "facility_id"},
    )


OPS_COLUMNS = (
    "county_arpt", "city_arpt", "district_tx_boundar", "fips_tx_boundar", "facility_id", "facility_name",
    "facility_group", "facility_type", "annual_operations", "summer_daily", "tx_dot_group", "medical_use",
    "military_joint_use", "otherservices", "fuel_types", "ownership", "used",
)
FLEET_COLUMNS = (
    "facility_id", "facility_name", "facility_group", "facility_type", "annual_operations", "airframe_id",
    "tfmsc_aircraft_id", "engine_id", "fleetmix", "engine_code", "equipment_type", "ops", "ltos",
)
FACTOR_COLUMNS = ("facility_id", "facility_name", "facility_group", "facility_type", "sysyear", "proj_fac")
TITLE_FIXES = {"Boundar": "Boundary", "Tx Dot": "TxDOT", "Otherservices": "Other Services", "Tfmsc": "TFMSC"}


def report_tables(ops: DataFrame, fleet: DataFrame, factors: DataFrame) -> dict[str, DataFrame]:
    """Operations (with a mean daily figure), fleet and factors under display names."""
    daily = ops.withColumn("summer_daily", daily_from_annual("annual_operations"))
    shown = select_existing(factors, FACTOR_COLUMNS).withColumnsRenamed(
        {"sysyear": "year", "proj_fac": "projection_factor"}
    )
    return {
        "operations": title_columns(select_existing(daily, OPS_COLUMNS), TITLE_FIXES),
        "fleet": title_columns(select_existing(fleet, FLEET_COLUMNS), TITLE_FIXES),
        "factors": title_columns(shown),
    }


# Display names of the emission extracts.
EXTRACT_NAMES = {
    "state_facility_identifier": "State Facility Identifier", "airport": "Airport",
    "facility_group": "Facility Group", "facility_type": "Facility Type", "county": "County", "year": "Year",
    "fip": "FIPS", "district": "District", "scc": "SCC", "scc_description": "SCC Description",
    "airframe": "Airframe", "engine": "Engine", "mode": "Mode", "ltos": "LTOs",
    "eis_pollutant_id": "EIS Pollutant ID", "uncontrolled_annual_emis_st": "Uncontrolled Annual Emission ST",
    "controlled_annual_emis_st": "Controlled Annual Emission ST",
    "uncontrolled_daily_emis_st": "Uncontrolled Daily Emission ST",
    "controlled_daily_emis_st": "Controlled Daily Emission ST",
}


def emission_extract(eis: DataFrame) -> DataFrame:
    """Columns of the county extracts, which are written by County (and Year)."""
    return select_existing(eis, EXTRACT_NAMES).withColumnsRenamed(EXTRACT_NAMES)
