"""Comparison of inventories, code lists and registries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skyledger.functions.numbers import percent_change, ratio
from skyledger.functions.rules import first_rule
from skyledger.functions.text import clean_key, recode, recode_or_null
from skyledger.operators.geo import k_nearest
from skyledger.operators.joins import priority_match, compare_outer, lookup, only_left, second_chance
from skyledger.operators.measures import group_sums, unit_sum, weighted_totals
from skyledger.operators.ranking import first_per_group
from skyledger.operators.reshape import unpivot
from skyledger.operators.skew import split_join, with_scalars
from skyledger.session import settle

# Output pollutant of each rate column; code changes of the other inventory.
RATE_POLLUTANTS = {
    "CO": "co_st", "CO2": "co2_st", "VOC": "voc_st", "NOX": "nox_st", "sox": "sox_st",
    "pm25": "pm25_st", "pm10": "pm10_st",
}
PARTICLE_CODES = {"PM10-PRI": "pm10", "PM25-PRI": "pm25"}
COMPARED_POLLUTANTS = ("CO", "CO2", "VOC", "NOX", "PM25-PRI", "PM10-PRI")
OWN_POLLUTANTS = {"CO": "CO", "NOX": "NOx", "PM10-PRI": "PM10", "PM25-PRI": "PM25", "SO2": "SOx", "VOC": "VOC"}
GENERIC_CODE = 999900
# Speciation profiles; source classification codes.
GAS_PROFILES = ("Aircraft: Piston", "Aircraft: Turbine and APU", "GSE: Diesel", "GSE: Gasoline, LPG and CNG")
SOURCE_CODES = {
    2275020000: "Commercial Aviation",
    2275060011: "Air taxis: Piston Driven",
    2275060012: "Air taxis: Turbine Driven",
    2275050011: "General Aviation: Piston Driven",
    2275050012: "General Aviation: Turbine Driven",
    2275001000: "Military",
    2275070000: "Auxiliary Power Units (APUs)",
    2268008005: "Ground Support Equipment (GSE): Compressed natural gas (CNG)-fueled",
    2270008005: "GSE: Diesel-fueled",
    2265008005: "GSE: Gasoline-fueled",
    2267008005: "GSE: Liquefied petroleum gas (LPG)-fueled",
}
BASE_POLLUTANTS = ("CO", "CH4", "CO2", "NOX", "PM10", "PM25", "SO2", "VOC")
# Points of facilities missing from the point layer (lon, lat).
POINT_FIXES = {"0ta7": (-103.900948, 30.149786), "ta27": (-97.950298, 30.837960), "xs10": (-98.350527, 29.553092)}


def mode_class(mode: str = "mode") -> Column:
    m = F.col(mode)
    return first_rule([
        (m.isin("Climb Below Mixing Height", "Descend Below Mixing Height"), "Aircraft"),
        (m == "GSE LTO", "GSE LTO"), (m == "APU", "APU"),
    ], F.lit(None).cast("string"))


def own_intensity(
    emissions: DataFrame, order: Sequence[Column], rates: Mapping[str, str] = RATE_POLLUTANTS,
    factor: DataFrame | None = None, scale_intensity: bool = False, detail: Sequence[str] = (), scaled_name: str | None = None,
) -> DataFrame:
    """Tons, LTOs and tons per LTO by facility, mode class and pollutant.

    LTOs repeat per row of an equipment, so each equipment counts once. ``factor``
    (facility_id, proj_fac) scales tons and LTOs to another year; the ratio scales
    only with ``scale_intensity``; ``scaled_name`` adds the scaled ratio as a column of its own.
    ``detail`` adds key columns such as equipment.

    Where the keys hold the equipment, tons and LTOs come from one pass over the rows.
    """
    keys = ["facility_id", "mode", *detail]
    unit = list(dict.fromkeys([*keys, "equipment_type"]))
    use = emissions.withColumn("mode", mode_class()).where(F.col("mode").isNotNull())
    if unit == keys:
        first = F.min_by(F.col("ltos"), F.struct(*[x for i, c in enumerate(order) for x in (c.isNotNull(), c.alias(f"_o{i}"))]))
        sums = {"lto": first, **{n: F.sum(F.col(r) * F.col("ltos")) for n, r in rates.items()}}
        units = use.dropna(subset=keys).groupBy(*keys).agg(*[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in sums.items()])
        out = unpivot(units, [*keys, "lto"], list(rates), "eis_pollutant_id", "emis_tons")
    else:
        tons = weighted_totals(use, keys, rates, "ltos")
        long = unpivot(tons, keys, list(rates), "eis_pollutant_id", "emis_tons")
        out = long.join(unit_sum(use, keys, unit, order, "ltos", "lto"), keys, "inner")
    out = out.withColumn("emis_per_lto", ratio("emis_tons", "lto"))
    if factor is None:
        return out
    scaled = lookup(out, factor, ["facility_id"], ["proj_fac"]).withColumns(
        {c: F.col(c) * F.col("proj_fac") for c in ("lto", "emis_tons")}
    )
    if scaled_name is not None:
        scaled = scaled.withColumn(scaled_name, F.col("emis_per_lto") * F.col("proj_fac"))
    if scale_intensity:
        scaled = scaled.withColumn("emis_per_lto", F.col("emis_per_lto") * F.col("proj_fac"))
    return scaled.drop("proj_fac")


def prior_intensity(
    prior: DataFrame, pollutants: Sequence[str] = COMPARED_POLLUTANTS, codes: Mapping[str, str] = PARTICLE_CODES,
    no_lto_modes: Sequence[str] = ("GSE LTO", "APU"),
) -> DataFrame:
    """The same measures of the other inventory; some modes state no LTOs."""
    use = prior.where(F.col("eis_pollutant_id").isin(*pollutants)).withColumns({
        "facility_id": F.lower("facility_id"),
        "lto": F.when(~F.col("mode").isin(*no_lto_modes), F.col("lto")),
        "eis_pollutant_id": recode("eis_pollutant_id", codes),
    })
    sums = group_sums(
        use, ["facility_id", "mode", "eis_pollutant_id"], lto="lto", emis_tons="uncontrolled_annual_emis_st"
    )
    return sums.withColumn("emis_per_lto", ratio("emis_tons", "lto"))


def inventory_compare(own: DataFrame, other: DataFrame) -> DataFrame:
    """Outer join of two intensity tables with difference and percent."""
    both = compare_outer(own, other, ["facility_id", "mode", "eis_pollutant_id"], ("_own", "_other"))
    return both.withColumns({
        "diff": F.col("emis_per_lto_own") - F.col("emis_per_lto_other"),
        "per_diff": percent_change("emis_per_lto_own", "emis_per_lto_other"),
    })


def known_unknown_rollup(
    ltos: DataFrame, unknown_factors: DataFrame, known: DataFrame, order: Sequence[Column],
    own: DataFrame, pollutants: Mapping[str, str], own_codes: Mapping[str, str] = OWN_POLLUTANTS,
) -> DataFrame:
    """Tons of generic codes (default factors) plus the modelled rest, against ours.

    ``ltos``: facility_id, code, lto. ``unknown_factors``: code, unit, a column per
    pollutant. ``known``: facility_id, equipment_type, mode, num_ops and rates,
    ``pollutants`` mapping name to rate column. ``own``: facility_id,
    eis_pollutant_id, tons.
    """
    generic = group_sums(ltos, ["facility_id", "code"], lto="lto").where(F.col("code") > GENERIC_CODE)
    names = [c for c in unknown_factors.columns if c not in ("code", "unit")]
    factors = unpivot(unknown_factors.where(F.col("unit") == "ST"), ["code"], names, "pollutant", "rate")
    unknown = split_join(generic, factors, ["code"], "inner").withColumn("emis", F.col("rate") * F.col("lto"))
    unknown = group_sums(unknown, ["facility_id", "pollutant"], emis="emis", ltos="lto")

    modelled = known.withColumn("mode_class", mode_class()).where(F.col("mode_class").isNotNull())
    tons = weighted_totals(modelled, ["facility_id"], pollutants, "num_ops")
    tons = unpivot(tons, ["facility_id"], list(pollutants), "pollutant", "emis")
    units = unit_sum(
        modelled.where(F.col("mode_class") == "Aircraft"), ["facility_id"], ["facility_id", "equipment_type"],
        order, "num_ops", "ltos",
    )
    total = group_sums(
        unknown.unionByName(tons.join(units, "facility_id")), ["facility_id", "pollutant"],
        other_tons="emis", ltos="ltos",
    ).drop("ltos")
    ours = group_sums(
        own.withColumn("pollutant", recode_or_null("eis_pollutant_id", own_codes)),
        ["facility_id", "pollutant"], own_tons="tons",
    )
    return total.join(ours, ["facility_id", "pollutant"], "inner").withColumns({
        "diff": F.col("own_tons") - F.col("other_tons"),
        "per_diff": ratio(F.col("own_tons") - F.col("other_tons"), "other_tons"),
    })


def scc_lookup_gap(ltos: DataFrame, codes: DataFrame) -> dict[str, DataFrame]:
    """Rows whose (scc, code) is unknown: counts by what the code alone would give,
    and their share of the LTOs. ``codes``: code, scc, faa_type, scc_description.
    """
    positive = ltos.where(F.col("lto") > 0)
    missing = only_left(positive, codes, ["scc", "code"])
    by_code = missing.select("airport", "process", "code").join(
        codes.select("code", "faa_type", "scc_description"), "code", "inner"
    )
    counts = by_code.dropna(subset=["airport", "faa_type", "process", "scc_description"]).groupBy(
        "airport", "faa_type", "process", "scc_description"
    ).agg(F.count("code").alias("n"))
    sums = with_scalars(missing.agg(F.sum("lto").alias("missing")), positive.agg(F.sum("lto").alias("whole")))
    share = sums.select(F.coalesce(ratio("missing", "whole"), F.lit(0.0)).alias("share"))
    return {"missing": missing, "counts": counts, "share": share}


def unit_id_match(units: DataFrame, codes: DataFrame, offset: int = 200000, generic_above: int = 300000) -> DataFrame:
    """Units against the code list, first by shifted code and then by the raw one.

    ``match_class``: shifted, raw, none, generic (codes above the limit), no key.
    """
    found = second_chance(units, codes, "aetc", "code", offset, "description")
    generic = (F.col("aetc") > generic_above) & (F.col("match_rule") != "shifted")
    return found.withColumn(
        "match_class", F.when(generic, "generic").otherwise(F.col("match_rule"))
    ).drop("match_rule")


def facility_match(own: DataFrame, other: DataFrame, k: int = 3, fixes: Mapping[str, tuple[float, float]] = POINT_FIXES) -> DataFrame:
    """Facilities of two registries by id, then name, then the ``k`` nearest.

    Both: facility_id, facility_name, lat, lon. Returns facility_id, match_id,
    method, dist_mi, rank.
    """
    def clean(df: DataFrame) -> DataFrame:
        return df.withColumns({"facility_id": clean_key("facility_id"), "facility_name": clean_key("facility_name")})

    ours, theirs = clean(own), clean(other)
    for i, axis in enumerate(("lon", "lat")):
        moved = first_rule([(F.col("facility_id") == f, xy[i]) for f, xy in fixes.items()], F.col(axis))
        ours = ours.withColumn(axis, moved)
    key, name = F.col("facility_id"), F.col("facility_name")
    found = settle(priority_match(ours, theirs, "facility_id", "facility_id", {"id": (key, key), "name": (name, name)}))
    near = k_nearest(
        only_left(ours, found.select("facility_id").distinct(), ["facility_id"]).select("facility_id", "lat", "lon"),
        only_left(theirs, found.select(F.col("match_id").alias("facility_id")).distinct(), ["facility_id"]).select(
            F.col("facility_id").alias("match_id"), "lat", "lon"),
        "facility_id", "match_id", k,
    ).withColumn("method", F.lit("nearest"))
    return found.unionByName(near, allowMissingColumns=True)


def pollutant_crosswalk(lists: Mapping[str, DataFrame], code: str = "polcode", left_out: Sequence[str] = BASE_POLLUTANTS, spare: Sequence[str] = ()) -> DataFrame:
    """Which list names which pollutant code: one row per code, one flag and name
    per list. ``left_out`` codes are removed from all lists but those in ``spare``.
    """
    out = None
    for name, df in lists.items():
        keep = df if name in spare else df.where(~F.col(code).isin(*left_out))
        named = F.min("polname") if "polname" in df.columns else F.lit(None).cast("string")
        one = keep.where(F.col(code).isNotNull()).groupBy(code).agg(
            F.first(F.lit(1)).alias(f"in_{name}"), named.alias(f"name_{name}")
        )
        out = one if out is None else out.join(one, code, "full_outer")
    return out.fillna(0, [f"in_{n}" for n in lists])


def speciation_factors(massfrac: DataFrame, profiles: DataFrame, species: DataFrame, names: Sequence[str] = GAS_PROFILES) -> DataFrame:
    """Mass fractions of the chosen profiles with pollutant attributes."""
    chosen = profiles.where(F.col("name").isin(*names)).select("prof_id", F.col("name").alias("prof_nm"))
    attributes = species.withColumnsRenamed({"name": "pol_nm", "cas_num": "polcode"})
    return massfrac.join(chosen, "prof_id").join(attributes, "pol_id")


def aircraft_species(
    profiles: DataFrame, species: DataFrame, properties: DataFrame,
    word: str = "aircraft", regions: Sequence[str] = ("United States", "California"),
) -> DataFrame:
    """Species of the profiles whose name holds a word, of some regions."""
    chosen = profiles.where(F.col("profile_name").ilike(f"%{word}%") & F.col("region").isin(*regions))
    return chosen.join(species, "profile_code", "left").join(properties, "species_id", "left")


def nei_extract(points: DataFrame, order: Sequence[Column], state: str = "TX", codes: Sequence[int] = tuple(SOURCE_CODES)) -> dict[str, DataFrame]:
    """National inventory rows of a state and of the aviation codes, the facility
    id map, and one description per pollutant code."""
    use = points.where((F.col("state") == state) & F.col("scc").isin(*codes))
    described = [
        "pollutant_code", "pollutant_desc", "pollutant_type", "calc_method_code", "calculation_method",
        "emission_comment", "source_data_set", "data_tagged", "data_set",
    ]
    have = [c for c in described if c in points.columns]
    return {
        "rows": use,
        "facilities": use.select("eis_facility_id", "agency_facility_id").distinct(),
        "pollutants": first_per_group(use, ["pollutant_code"], order).select(*have),
    }
