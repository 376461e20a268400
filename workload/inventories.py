"""Emission, report and comparison queries."""

from pyspark.sql import functions as F

import workload.roles  # noqa: F401
from skyledger.plans import compare, emissions, facility, fleet, reports
from workload.facilities import CLASS_SPLIT, rounded
from workload.registry import query

MODES = "('Climb Below Mixing Height', 'Descend Below Mixing Height', 'GSE LTO', 'APU')"


@query("filter_modes", f"SELECT event_no, mode, co_st FROM {{rates}} WHERE mode IN {MODES[:-1]}, 'Taxi Out', 'Taxi In')")
def _(t):
    return emissions.filter_modes(t.rates, emissions.TAXI_MODES).select("event_no", "mode", "co_st")


MIL_SQL = """mi AS (SELECT DISTINCT split_part(equipment_type, '/', 1) AS he, split_part(equipment_type, '/', 2) AS engine_code FROM {class_rates} WHERE fac_class = 'mil_heli'),
mq AS (SELECT he, engine_code, engine_id, CASE he WHEN 'CH47D' THEN 4891 WHEN 'S70' THEN 4935 WHEN 'B212' THEN 5245 END AS airframe_id FROM mi JOIN {engines} USING (engine_code))"""


@query("military_heli_fleet", "WITH " + MIL_SQL + """
SELECT facility_id, he AS anp_helicopter_id, engine_code, engine_id, airframe_id, model, round(CAST(1.0 AS DOUBLE) / 3, 8) AS fleetmix FROM {facilities}, mq JOIN {airframes} USING (airframe_id)
WHERE facility_type = 'HELIPORT' AND facility_group = 'Military'""")
def _(t):
    posts = t.facilities.where("facility_type = 'HELIPORT' and facility_group = 'Military'").select("facility_id")
    out = fleet.military_heli_fleet(t.class_rates.where("fac_class = 'mil_heli'"), t.engines, t.airframes, posts)
    return rounded(out, 8, "fleetmix")


FARM_SQL = """fi AS (SELECT DISTINCT split_part(equipment_type, '/', 1) AS model, split_part(equipment_type, '/', 2) AS engine_code FROM {class_rates} WHERE fac_class = 'fandr_arpt'),
fq AS (SELECT model, engine_code, engine_id, airframe_id, 1.0 / CAST(count(*) OVER () AS DOUBLE) AS mix FROM fi JOIN {engines} USING (engine_code) LEFT JOIN {airframes} USING (model))"""


@query("farm_fleet", "WITH " + FARM_SQL + """
SELECT facility_id, model, engine_code, engine_id, airframe_id, model AS label, round(mix, 10) AS fleetmix FROM {facilities}, fq WHERE facility_type = 'AIRPORT' AND facility_group = 'Farm/Ranch'""")
def _(t):
    farms = t.facilities.where("facility_type = 'AIRPORT' and facility_group = 'Farm/Ranch'").select("facility_id")
    out = fleet.farm_fleet(t.class_rates.where("fac_class = 'fandr_arpt'"), t.engines, t.airframes, farms)
    return rounded(out, 10, "fleetmix")


@query("heli_emissions", f"""
WITH r AS (SELECT * FROM {{class_rates}} WHERE fac_class = 'tasp_heli' AND mode IN {MODES})
SELECT facility_id, aircraft_id, airframe_id, f.engine_id, anp_helicopter_id || '/' || engine_code AS equipment_type, round(annual_operations * fleetmix, 6) AS ops,
  round(annual_operations * fleetmix / 2, 6) AS ltos, mode, co_st FROM {{fleet_input}} f LEFT JOIN {{engines}} USING (engine_id)
LEFT JOIN r ON r.equipment_type = anp_helicopter_id || '/' || engine_code WHERE facility_group = 'TASP' AND facility_type = 'HELIPORT'""")
def _(t):
    own = t.fleet_input.where("facility_group = 'TASP' and facility_type = 'HELIPORT'")
    rates = emissions.filter_modes(t.class_rates.where("fac_class = 'tasp_heli'"))
    _, out = emissions.heli_emissions(own, rates, t.engines)
    return rounded(out, 6, "ops", "ltos").select(
        "facility_id", "aircraft_id", "airframe_id", "engine_id", "equipment_type", "ops", "ltos", "mode", "co_st"
    )


AIRPORT_SQL = f"""fr AS (SELECT fac_class, lower(equipment_type) AS eq, mode, co_st FROM (SELECT *, row_number() OVER (PARTITION BY fac_class, departure_airport, lower(equipment_type), mode ORDER BY event_no) AS rn
  FROM {{class_rates}} WHERE mode IN {MODES} AND mode NOT IN ('GSE LTO', 'APU')) WHERE rn = 1)"""


@query("airport_emissions", "WITH " + AIRPORT_SQL + """,
k AS (SELECT f.*, coalesce(anp_helicopter_id, model) AS label, 'E' || CAST(engine_id AS VARCHAR) AS engine_code, fleetmix / sum(fleetmix) OVER (PARTITION BY facility_id) AS mix
  FROM {fleet_input} f JOIN {airframes} USING (airframe_id) WHERE facility_group = 'Military' AND facility_type = 'AIRPORT' AND CAST(airframe_id AS VARCHAR) || '_' || CAST(engine_id AS VARCHAR) NOT IN ('1_28', '1_7', '3_4', '0_11'))
SELECT facility_id, aircraft_id, airframe_id, engine_id, lower(label) || '/' || lower(engine_code) AS equipment_type, round(mix, 8) AS fleetmix, round(mix * annual_operations / 2, 6) AS ltos, mode, co_st
FROM k LEFT JOIN (SELECT * FROM fr WHERE fac_class = 'mil_arpt') r ON eq = lower(label) || '/' || lower(engine_code)""")
def _(t):
    own = t.fleet_input.where("facility_group = 'Military' and facility_type = 'AIRPORT'")
    ready = emissions.airport_fleet(own, t.engines, t.airframes, ["1_28", "1_7", "3_4", "0_11"])
    rates = emissions.filter_modes(t.class_rates.where("fac_class = 'mil_arpt'"))
    out = emissions.airport_emissions(ready, rates, [F.col("event_no")])
    return rounded(rounded(out, 8, "fleetmix"), 6, "ltos").select(
        "facility_id", "aircraft_id", "airframe_id", "engine_id", "equipment_type", "fleetmix", "ltos", "mode", "co_st"
    )


INVENTORY_SQL = "WITH " + MIL_SQL + ", " + FARM_SQL + ", " + AIRPORT_SQL + f""",
cl AS (SELECT facility_id, annual_operations, {CLASS_SPLIT} AS fac_class FROM {{facilities}} WHERE facility_group <> 'Commercial'),
fi2 AS (SELECT f.facility_id, f.airframe_id, f.engine_id, f.aircraft_id, f.fleetmix, f.anp_helicopter_id, cl.annual_operations, fac_class FROM {{fleet_input}} f JOIN cl USING (facility_id)),
hf AS (SELECT facility_id, fac_class, anp_helicopter_id || '/E' || CAST(engine_id AS VARCHAR) AS eq, annual_operations * fleetmix AS ops FROM fi2 WHERE fac_class LIKE '%_heli' AND fac_class <> 'mil_heli' UNION ALL
  SELECT facility_id, fac_class, he || '/' || engine_code, annual_operations * (CAST(1.0 AS DOUBLE) / 3) FROM cl, mq JOIN {{airframes}} USING (airframe_id) WHERE fac_class = 'mil_heli'),
pa AS (SELECT facility_id, fac_class, coalesce(anp_helicopter_id, model) AS label, engine_id, fleetmix, annual_operations FROM fi2 JOIN {{airframes}} USING (airframe_id) WHERE fac_class LIKE '%_arpt' AND fac_class <> 'fandr_arpt' UNION ALL
  SELECT facility_id, fac_class, model, engine_id, mix, annual_operations FROM cl, fq WHERE fac_class = 'fandr_arpt'),
pf AS (SELECT *, fleetmix / sum(fleetmix) OVER (PARTITION BY facility_id) * annual_operations AS ops FROM pa)"""


def _noncommercial(t):
    own = t.fleet_input.select("facility_id", "airframe_id", "engine_id", "aircraft_id", "fleetmix", "anp_airplane_id", "anp_helicopter_id")
    return emissions.noncommercial_inventory(
        facility.class_split(t.facilities), own, t.class_rates, t.engines, t.airframes, [F.col("event_no")]
    )


@query("noncommercial_fleet", INVENTORY_SQL + """
SELECT facility_id, fac_class, eq AS equipment_type, CAST(count(*) AS BIGINT) AS n, round(sum(ops) + 1e-6, 4) AS ops FROM (SELECT facility_id, fac_class, eq, ops FROM hf UNION ALL
  SELECT facility_id, fac_class, lower(label) || '/e' || CAST(engine_id AS VARCHAR), ops FROM pf) GROUP BY 1, 2, 3""")
def _(t):
    out, _emis = _noncommercial(t)
    return out.groupBy("facility_id", "fac_class", "equipment_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("ops") + 1e-6, 4).alias("ops"))


@query("noncommercial_emissions", INVENTORY_SQL + f""",
al AS (SELECT facility_id, hf.fac_class, mode, ops, co_st FROM hf LEFT JOIN (SELECT * FROM {{class_rates}} WHERE mode IN {MODES}) r ON r.fac_class = hf.fac_class AND r.equipment_type = hf.eq UNION ALL
  SELECT facility_id, pf.fac_class, mode, ops, co_st FROM pf LEFT JOIN fr ON fr.fac_class = pf.fac_class AND fr.eq = lower(label) || '/e' || CAST(engine_id AS VARCHAR))
SELECT facility_id, fac_class, mode, CAST(count(*) AS BIGINT) AS n, round(sum(ops / 2 * co_st) + 1.7e-5, 2) AS co FROM al GROUP BY 1, 2, 3""")
def _(t):
    _fleet, out = _noncommercial(t)
    return out.groupBy("facility_id", "fac_class", "mode").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("ltos") * F.col("co_st")) + 1.7e-5, 2).alias("co")
    )


@query("noncommercial_coverage", INVENTORY_SQL + f""",
ac AS (SELECT facility_id, {CLASS_SPLIT} AS fac_class FROM {{facilities}} WHERE facility_group <> 'Commercial' AND facility_type <> 'GLIDERPORT'),
un AS (SELECT facility_id, fac_class, eq FROM hf UNION SELECT facility_id, fac_class, lower(label) || '/e' || CAST(engine_id AS VARCHAR) FROM pf),
ra AS (SELECT DISTINCT fac_class, equipment_type AS eq FROM {{class_rates}} WHERE mode IN {MODES} AND fac_class LIKE '%_heli' AND co_st IS NOT NULL UNION SELECT fac_class, eq FROM fr WHERE co_st IS NOT NULL),
nu AS (SELECT facility_id, count(*) AS units, count(*) FILTER (ra.eq IS NULL) AS bare FROM un LEFT JOIN ra USING (fac_class, eq) GROUP BY 1)
SELECT facility_id, fac_class, CASE WHEN fac_class IS NULL THEN 'no class' WHEN coalesce(units, 0) = 0 THEN 'no fleet' WHEN units = bare THEN 'no rates' ELSE 'fleet' END AS covered_by,
  coalesce(units, 0) AS units, coalesce(bare, 0) AS units_without_rates FROM ac LEFT JOIN nu USING (facility_id)""")
def _(t):
    """Facilities without a fleet row or without a class stay in the list, with what they lack."""
    made, out = _noncommercial(t)
    return emissions.noncommercial_coverage(facility.class_split(t.facilities), made, out)


OWN_SQL = f"""WITH rr AS (SELECT r.*, CASE WHEN facility_id IN ('f1', 'f2', 'f7') THEN sum(CASE WHEN mode IN {MODES[:-1].replace(", 'GSE LTO', 'APU'", "")}) THEN num_ops END) OVER (PARTITION BY facility_id) / 2 ELSE annual_operations END AS annual
  FROM {{own_rates}} r JOIN (SELECT facility_id, annual_operations FROM {{facilities}}) f USING (facility_id)),
ro AS (SELECT * FROM rr WHERE mode IN {MODES}),
fl AS (SELECT facility_id, equipment_type, num_ops, annual FROM ro WHERE mode = 'Climb Below Mixing Height'),
fa AS (SELECT facility_id, max(annual) / nullif(sum(num_ops * 2), 0) AS k FROM fl GROUP BY 1)"""


def _commercial(t):
    return emissions.commercial_inventory(
        t.own_rates, t.own_scenario, t.facilities, t.engines, t.airframes, [F.col("mode_no"), F.col("user_id")],
        self_reporting=("f1", "f2", "f7"),
    )


@query("commercial_fleet", OWN_SQL + """
SELECT facility_id, equipment_type, num_ops * k AS ltos, num_ops * k * 2 AS ops, num_ops * k * 2 / nullif(annual, 0) AS fleetmix,
  CASE WHEN facility_id IN ('f1', 'f2', 'f7') THEN 'reported' ELSE 'traffic' END AS source FROM fl JOIN fa USING (facility_id)""")
def _(t):
    out, _emis = _commercial(t)
    return out.select("facility_id", "equipment_type", "ltos", "ops", "fleetmix", "source")


@query("commercial_fleet_2020", """
WITH named AS (SELECT facility_id, equipment_type, mode, num_ops FROM {own_rates} WHERE facility_id IN ('f1', 'f2', 'f7')),
other AS (SELECT facility_id, CASE WHEN equipment_type LIKE '%Brand#1/%' THEN 'A109/' || split_part(equipment_type, '/', 2) WHEN equipment_type LIKE '%Brand#2/%' THEN 'B407/' || split_part(equipment_type, '/', 2) ELSE equipment_type END AS eq, mode, num_ops FROM named)
SELECT facility_id, eq AS equipment_type, CASE split_part(eq, '/', 1) WHEN 'A109' THEN 5238 WHEN 'B407' THEN 5079 ELSE airframe_id END AS airframe_id, CAST(engine_id AS INT) AS engine_id
FROM (SELECT DISTINCT facility_id, eq FROM other WHERE mode = 'Climb Below Mixing Height') LEFT JOIN {airframes} ON model = split_part(eq, '/', 1) LEFT JOIN {engines} ON engine_code = split_part(eq, '/', 2)""")
def _(t):
    """The 2020 edition's list of airframes that the equipment tables lack, for facilities that report themselves."""
    frame, engine = F.split_part("equipment_type", F.lit("/"), F.lit(1)), F.split_part("equipment_type", F.lit("/"), F.lit(2))
    named = F.when(frame.endswith("Brand#1"), "A109").when(frame.endswith("Brand#2"), "B407").otherwise(frame)
    rates = t.own_rates.withColumn("equipment_type", F.concat_ws("/", named, engine))
    out, _emis = emissions.commercial_inventory(
        rates, t.own_scenario, t.facilities, t.engines, t.airframes, [F.col("mode_no"), F.col("user_id")],
        self_reporting=("f1", "f2", "f7"), extra=emissions.EXTRA_AIRFRAMES_2020,
    )
    return out.where("source = 'reported'").select("facility_id", "equipment_type", F.col("airframe_id").cast("int"), F.col("engine_id").cast("int"))


@query("commercial_emissions", OWN_SQL + """
SELECT ro.facility_id, ro.equipment_type, ro.mode, ro.num_ops * k AS ltos, fl.num_ops * k * 2 AS ops, co_st FROM ro JOIN fa USING (facility_id) LEFT JOIN fl USING (facility_id, equipment_type)""")
def _(t):
    _fleet, out = _commercial(t)
    return out.select("facility_id", "equipment_type", "mode", "ltos", "ops", "co_st")


POLLUTANTS = ("CO", "NOX", "PM10")
ORDER = ("Commercial", "Military", "Air Taxi, Turbine")


def _county(name="county"):
    return f"upper(substr({name}, 1, 1)) || substr({name}, 2)"


@query("statewide_summary", f"""
WITH d AS (SELECT {_county()} AS county, scc, scc_description AS sd, eis_pollutant_id AS p, uncontrolled_annual_emis_st AS u, controlled_annual_emis_st AS c FROM {{inventory}} WHERE scc_description <> 'Electric'),
g AS (SELECT 'state' AS grain, NULL AS county, scc, sd, p, sum(u) AS u, sum(c) AS c FROM d GROUP BY scc, sd, p UNION ALL SELECT 'county', county, scc, sd, p, sum(u), sum(c) FROM d GROUP BY county, scc, sd, p),
l AS (SELECT 'uncontrolled' AS kind, grain, county, scc, sd, p, u AS v FROM g UNION ALL SELECT 'controlled', grain, county, scc, sd, p, c FROM g)
SELECT kind, grain, county, scc, CASE WHEN sd IN ('Commercial', 'Military', 'Air Taxi, Turbine') THEN sd END AS scc_description, CAST(list_position(['Commercial', 'Military', 'Air Taxi, Turbine'], sd) AS INT) AS class_rank,
  round(max(CASE WHEN p = 'CO' THEN v END), 4) AS "CO", round(max(CASE WHEN p = 'NOX' THEN v END), 4) AS "NOx", round(max(CASE WHEN p = 'PM10' THEN v END), 4) AS "PM10" FROM l GROUP BY kind, grain, county, scc, sd""")
def _(t):
    tables = reports.statewide_summary(t.inventory, POLLUTANTS, ORDER, ("Electric",))
    out = None
    for name, df in tables.items():
        kind, grain = name.split("_")
        one = df.withColumns({"kind": F.lit(kind), "grain": F.lit(grain)})
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return rounded(out, 4, "CO", "NOx", "PM10")


@query("emission_lto_summary", """
SELECT facility_id, facility_group, airport, mode, CASE eis_pollutant_id WHEN 'PM10' THEN 'PM10-PRI' ELSE eis_pollutant_id END AS eis_pollutant_id, sum(ltos) AS lto,
  round(sum(uncontrolled_annual_emis_st), 2) AS uncontrolled, round(sum(controlled_annual_emis_st), 4) AS controlled FROM {inventory} WHERE mode IN ('Aircraft', 'APU') AND eis_pollutant_id <> 'NOX' GROUP BY ALL""")
def _(t):
    out = reports.emission_lto_summary(t.inventory, ("Aircraft", "APU"), ("CO", "PM10-PRI"))
    return rounded(rounded(out, 2, "uncontrolled"), 4, "controlled")


SPECIES = "(SELECT 'CO' AS polcode, 'Carbon monoxide' AS pol_nm UNION ALL SELECT 'PM10', 'Coarse' UNION ALL SELECT '108383 & 106423', 'Xylenes')"


def _species(t):
    from skyledger.sources.readers import literal_table
    rows = [("CO", "Carbon monoxide"), ("PM10", "Coarse"), ("108383 & 106423", "Xylenes")]
    return literal_table(t.inventory.sparkSession, rows, "polcode string, pol_nm string")


def _registry(t):
    number = lambda c: c.cast("string")
    k = F.col("c_custkey")
    text = lambda deg, hemi: F.concat_ws("-", number(deg), number(k % 60), F.concat(number(k % 50), F.lit(".5"), F.lit(hemi)))
    return t.customer.select(
        F.concat(F.lit("F"), number(k)).alias("facility_id"), text(F.col("c_nationkey") + 10, "N").alias("arp_latitude"),
        text(F.col("c_nationkey") + 90, "W").alias("arp_longitude"),
    )


DASH_SQL = f"""SELECT year, {_county("county")} AS county, fip, facility_id, airport, facility_group, facility_type, scc, scc_description, eis_pollutant_id, round(sum(uncontrolled_annual_emis_st), 2) AS uncontrolled,
  round(sum(controlled_annual_emis_st), 4) AS controlled FROM {{inventory}} WHERE eis_pollutant_id IN ('CO', 'NOX') GROUP BY ALL"""


@query("dashboard_facility", "WITH d AS (" + DASH_SQL + """), c AS (SELECT 'f' || CAST(c_custkey AS VARCHAR) AS facility_id, c_nationkey + 10 + (c_custkey % 60) / 60.0 + (c_custkey % 50 + 0.5) / 3600.0 AS lat,
  -(c_nationkey + 90 + (c_custkey % 60) / 60.0 + (c_custkey % 50 + 0.5) / 3600.0) AS lon FROM {customer})
SELECT d.*, CASE eis_pollutant_id WHEN 'CO' THEN 'Carbon monoxide' ELSE eis_pollutant_id END AS pol_nm, round(lat, 6) AS latitude, round(lon, 6) AS longitude FROM d JOIN c USING (facility_id)""")
def _(t):
    out = reports.dashboard_extract(t.inventory, _registry(t), _species(t), ("CO", "NOX"))["facility"]
    return rounded(rounded(rounded(out, 2, "uncontrolled"), 4, "controlled"), 6, "latitude", "longitude")


@query("dashboard_county", f"""SELECT year, {_county()} AS county, fip, scc, scc_description, eis_pollutant_id, round(sum(uncontrolled_annual_emis_st), 2) AS uncontrolled, round(sum(controlled_annual_emis_st), 4) AS controlled,
  CASE eis_pollutant_id WHEN 'CO' THEN 'Carbon monoxide' ELSE eis_pollutant_id END AS pol_nm FROM {{inventory}} WHERE eis_pollutant_id IN ('CO', 'NOX') GROUP BY ALL""")
def _(t):
    out = reports.dashboard_extract(t.inventory, _registry(t), _species(t), ("CO", "NOX"))["county"]
    return rounded(rounded(out, 2, "uncontrolled"), 4, "controlled")


@query("dashboard_ltos", "SELECT facility_id, year, sum(ltos) AS ltos FROM {inventory} WHERE eis_pollutant_id = 'CO' AND mode = 'Aircraft' GROUP BY 1, 2")
def _(t):
    return reports.dashboard_extract(t.inventory, _registry(t), _species(t), lto_slice=("CO", "Aircraft"))["ltos"]


@query("county_subset_ltos", """
SELECT year, fip, facility_id, airport, scc, scc_description, sum(ltos) AS ltos, sum(ltos) * 2 AS operations, CASE fip WHEN 48001 THEN 'One' WHEN 48004 THEN 'Four' ELSE 'Nine' END AS county
FROM {inventory} WHERE eis_pollutant_id = 'CO' AND mode = 'Aircraft' AND year IN (1998, 1999) AND fip IN (48001, 48004, 48009) GROUP BY ALL""")
def _(t):
    return _subset(t)["ltos"]


def _subset(t):
    names = _species(t).withColumnRenamed("polcode", "eis_pollutant_id")
    return reports.county_subset_extract(t.inventory, names, (1998, 1999), {48001: "One", 48004: "Four", 48009: "Nine"})


@query("county_subset_emissions", """
SELECT year, fip, facility_id, airport, scc, scc_description, eis_pollutant_id, round(sum(controlled_annual_emis_st), 4) AS controlled, CASE fip WHEN 48001 THEN 'One' WHEN 48004 THEN 'Four' ELSE 'Nine' END AS county,
  CASE eis_pollutant_id WHEN 'CO' THEN 'Carbon monoxide' ELSE 'Coarse' END AS pol_nm FROM {inventory} WHERE year IN (1998, 1999) AND fip IN (48001, 48004, 48009) AND eis_pollutant_id IN ('CO', 'PM10') GROUP BY ALL""")
def _(t):
    return rounded(_subset(t)["emissions"], 4, "controlled")


@query("inventory_compare", f"""
WITH m AS (SELECT facility_id, CASE WHEN mode IN ('GSE LTO', 'APU') THEN mode ELSE 'Aircraft' END AS mode, mode_no, user_id, equipment_type, num_ops AS ltos, co_st, nox_st FROM {{own_rates}} WHERE mode IN {MODES}),
e AS (SELECT facility_id, mode, sum(co_st * ltos) AS co, sum(nox_st * ltos) AS nox FROM m GROUP BY 1, 2),
u AS (SELECT facility_id, mode, sum(ltos) AS lto FROM (SELECT facility_id, mode, equipment_type, arg_min(ltos, (mode_no, user_id)) AS ltos FROM m GROUP BY 1, 2, 3) GROUP BY 1, 2),
a AS (SELECT facility_id, mode, 'CO' AS p, co AS t, lto FROM e JOIN u USING (facility_id, mode) UNION ALL SELECT facility_id, mode, 'NOX', nox, lto FROM e JOIN u USING (facility_id, mode)),
b AS (SELECT facility_id, mode, CASE eis_pollutant_id WHEN 'PM10' THEN 'pm10' ELSE eis_pollutant_id END AS p, sum(uncontrolled_annual_emis_st) AS t, coalesce(sum(CASE WHEN mode NOT IN ('GSE LTO', 'APU') THEN lto END), 0) AS lto FROM {{inventory}} GROUP BY 1, 2, 3)
SELECT facility_id, mode, p AS eis_pollutant_id, a.lto AS lto_own, round(a.t, 2) AS emis_tons_own, b.lto AS lto_other, round(b.t, 2) AS emis_tons_other,
  round(a.t / nullif(a.lto, 0) - b.t / nullif(b.lto, 0), 8) AS diff, round((a.t / nullif(a.lto, 0) - b.t / nullif(b.lto, 0)) * 100 / nullif(b.t / nullif(b.lto, 0), 0), 8) AS per_diff
FROM a FULL JOIN b USING (facility_id, mode, p)""")
def _(t):
    order = [F.col("mode_no"), F.col("user_id")]
    own = compare.own_intensity(t.own_rates.withColumnRenamed("num_ops", "ltos").withColumn("mode_no", F.col("mode_no")), order, {"CO": "co_st", "NOX": "nox_st"})
    other = compare.prior_intensity(t.inventory, ("CO", "NOX", "PM10"), {"PM10": "pm10"})
    out = compare.inventory_compare(own, other)
    return rounded(rounded(out, 2, "emis_tons_own", "emis_tons_other"), 8, "diff", "per_diff").select(
        "facility_id", "mode", "eis_pollutant_id", "lto_own", "emis_tons_own", "lto_other", "emis_tons_other", "diff", "per_diff"
    )


FACTOR_SQL = """pf AS (SELECT facility_id, sum(CASE WHEN sysyear = 2000 THEN t_aops END) * 1.0 / nullif(sum(CASE WHEN sysyear = 1998 THEN t_aops END), 0) AS proj_fac FROM {forecast} GROUP BY 1)"""


@query("scaled_intensity", f"""
WITH m AS (SELECT facility_id, CASE WHEN mode IN ('GSE LTO', 'APU') THEN mode ELSE 'Aircraft' END AS mode, mode_no, user_id, equipment_type, num_ops AS ltos, co_st, nox_st FROM {{own_rates}} WHERE mode IN {MODES}),
e AS (SELECT facility_id, mode, equipment_type, sum(co_st * ltos) AS co, sum(nox_st * ltos) AS nox, arg_min(ltos, (mode_no, user_id)) AS lto FROM m GROUP BY 1, 2, 3),
a AS (SELECT facility_id, mode, equipment_type, 'CO' AS p, co AS t, lto FROM e UNION ALL SELECT facility_id, mode, equipment_type, 'NOX', nox, lto FROM e),
{FACTOR_SQL}
SELECT facility_id, mode, equipment_type, p AS eis_pollutant_id, round(lto * proj_fac, 6) AS lto, round(t * proj_fac, 4) AS emis_tons,
  round(t / nullif(lto, 0), 6) AS per_lto, round(t / nullif(lto, 0) * proj_fac, 6) AS scaled_per_lto FROM a LEFT JOIN pf USING (facility_id)""")
def _(t):
    """Tons and LTOs of another year by the projection factor, per equipment, with and without the scaled ratio."""
    year = lambda y: F.sum(F.when(F.col("sysyear") == y, F.col("t_aops")))
    factor = t.forecast.groupBy("facility_id").agg(F.try_divide(year(2000) * F.lit(1.0), year(1998)).alias("proj_fac"))
    rows, order = t.own_rates.withColumnRenamed("num_ops", "ltos"), [F.col("mode_no"), F.col("user_id")]
    made = compare.own_intensity(rows, order, {"CO": "co_st", "NOX": "nox_st"}, factor, False, ["equipment_type"], "scaled_per_lto")
    keys = ["facility_id", "mode", "equipment_type", "eis_pollutant_id"]
    both = made.withColumnRenamed("emis_per_lto", "per_lto")
    return rounded(rounded(both, 4, "emis_tons"), 6, "lto", "per_lto", "scaled_per_lto").select(*keys, "lto", "emis_tons", "per_lto", "scaled_per_lto")


@query("known_unknown_rollup", f"""
WITH g AS (SELECT facility_id, code, sum(lto) AS lto FROM {{coded_ltos}} WHERE code > 999900 GROUP BY 1, 2),
f AS (SELECT DISTINCT CAST(999901 + l_linenumber AS INT) AS code, l_linenumber AS n FROM {{lineitem}} WHERE l_linenumber < 7),
u AS (SELECT facility_id, 'CO' AS pollutant, sum(lto * n * 0.5) AS emis FROM g JOIN f USING (code) GROUP BY 1 UNION ALL SELECT facility_id, 'NOx', sum(lto * n * 2.0) FROM g JOIN f USING (code) GROUP BY 1),
m AS (SELECT '1-URGENT' AS facility_id, 'CO' AS pollutant, sum(co_st * num_ops) AS emis FROM {{rates}} WHERE mode IN {MODES} UNION ALL SELECT '1-URGENT', 'NOx', sum(nox_st * num_ops) FROM {{rates}} WHERE mode IN {MODES}),
o AS (SELECT facility_id, pollutant, sum(emis) AS other FROM (SELECT * FROM u UNION ALL SELECT * FROM m) GROUP BY 1, 2),
w AS (SELECT o_orderpriority AS facility_id, CASE l_returnflag WHEN 'A' THEN 'CO' ELSE 'NOx' END AS pollutant, sum(l_extendedprice) AS own FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R' GROUP BY 1, 2)
SELECT facility_id, pollutant, round(other, 2) AS other_tons, round(own, 2) AS own_tons, round(own - other, 2) AS diff, round((own - other) / nullif(other, 0), 6) AS per_diff FROM o JOIN w USING (facility_id, pollutant)""")
def _(t):
    n = F.col("l_linenumber")
    factors = t.lineitem.where(n < 7).select((n + 999901).alias("code"), F.lit("ST").alias("unit"), (n * 0.5).alias("CO"), (n * 2.0).alias("NOx")).distinct()
    known = t.rates.withColumn("facility_id", F.lit("1-URGENT"))
    code = F.when(F.col("l_returnflag") == "A", "CO").when(F.col("l_returnflag") == "N", "NOX").otherwise("other")
    own = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderpriority").alias("facility_id"), code.alias("eis_pollutant_id"), F.col("l_extendedprice").alias("tons")
    )
    out = compare.known_unknown_rollup(t.coded_ltos, factors, known, [F.col("event_no"), F.col("mode_no")], own, {"CO": "co_st", "NOx": "nox_st"})
    return rounded(rounded(out, 2, "other_tons", "own_tons", "diff"), 6, "per_diff")


GAP_SQL = """WITH ms AS (SELECT * FROM {coded_ltos} c WHERE lto > 0 AND NOT EXISTS (SELECT 1 FROM {codes} k WHERE k.code = c.code AND k.scc = c.scc))"""


@query("lookup_gap", GAP_SQL + """
SELECT airport, process, faa_type, scc_description, count(*) AS n FROM ms JOIN (SELECT code, faa_type, scc_description FROM {codes}) k USING (code) GROUP BY ALL""")
def _(t):
    return compare.scc_lookup_gap(t.coded_ltos, t.codes)["counts"]


@query("lookup_gap_share", GAP_SQL + " SELECT round((SELECT sum(lto) FROM ms) / (SELECT sum(lto) FROM {coded_ltos} WHERE lto > 0), 8) AS share")
def _(t):
    return rounded(compare.scc_lookup_gap(t.coded_ltos, t.codes)["share"], 8, "share")


@query("unit_id_match", """
WITH k AS (SELECT p_partkey * 2 + 500 AS code, p_name AS description FROM {part}),
f AS (SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN l_quantity > 2 THEN l_partkey END AS aetc FROM {lineitem})
SELECT f.*, coalesce(s.description, r.description) AS description, CASE WHEN aetc IS NULL THEN 'no key' WHEN s.code IS NOT NULL THEN 'shifted' WHEN aetc > 1900 THEN 'generic' WHEN r.code IS NOT NULL THEN 'raw' ELSE 'none' END AS match_class
FROM f LEFT JOIN k s ON s.code - 500 = aetc LEFT JOIN k r ON r.code = aetc""")
def _(t):
    units = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", F.when(F.col("l_quantity") > 2, F.col("l_partkey")).alias("aetc"))
    codes = t.part.select((F.col("p_partkey") * 2 + 500).alias("code"), F.col("p_name").alias("description"))
    return compare.unit_id_match(units, codes, 500, 1900)


HAVERSINE = """2 * 3958.7613 * asin(sqrt(least(1.0, power(sin(radians(s.lat - f.lat) / 2), 2) + cos(radians(f.lat)) * cos(radians(s.lat)) * power(sin(radians(s.lon - f.lon) / 2), 2))))"""


@query("facility_match", f"""
WITH f AS (SELECT facility_id, facility_name, lat, lon FROM {{points}}),
s AS (SELECT 'f' || CAST(s_suppkey * 20 AS VARCHAR) AS match_id, CASE WHEN s_nationkey < 5 THEN 'customer#' || lpad(CAST(s_suppkey * 3 + 1 AS VARCHAR), 9, '0') ELSE 'none' END AS nm, lat, lon FROM {{supplier}} JOIN {{sites}} ON 'g' || CAST(s_suppkey AS VARCHAR) = match_id),
m1 AS (SELECT facility_id, facility_id AS match_id FROM f WHERE facility_id IN (SELECT match_id FROM s)),
m2 AS (SELECT facility_id, match_id FROM f JOIN s ON nm = lower(facility_name) WHERE facility_id NOT IN (SELECT match_id FROM s)),
r AS (SELECT * FROM f WHERE facility_id NOT IN (SELECT facility_id FROM m1) AND facility_id NOT IN (SELECT facility_id FROM m2)),
q AS (SELECT * FROM s WHERE match_id NOT IN (SELECT match_id FROM m1) AND match_id NOT IN (SELECT match_id FROM m2)),
d AS (SELECT r.facility_id, q.match_id, {HAVERSINE.replace("s.", "q.").replace("f.", "r.")} AS d FROM r, q)
SELECT facility_id, match_id, 'id' AS method, CAST(NULL AS DOUBLE) AS dist_mi, CAST(NULL AS INT) AS rank FROM m1 UNION ALL SELECT facility_id, match_id, 'name', NULL, NULL FROM m2 UNION ALL
SELECT facility_id, match_id, 'nearest', round(d, 4), CAST(rn AS INT) FROM (SELECT *, row_number() OVER (PARTITION BY facility_id ORDER BY d, match_id) AS rn FROM d) WHERE rn <= 3""")
def _(t):
    name = F.when(F.col("s_nationkey") < 5, F.concat(F.lit("Customer#"), F.lpad((F.col("s_suppkey") * 3 + 1).cast("string"), 9, "0"))).otherwise("none")
    sites = t.sites.withColumn("s_suppkey", F.expr("substring(match_id, 2)").cast("bigint"))
    other = t.supplier.join(sites, "s_suppkey").select(
        F.concat(F.lit("'F"), (F.col("s_suppkey") * 20).cast("string")).alias("facility_id"), name.alias("facility_name"), "lat", "lon"
    )
    out = compare.facility_match(t.points.select("facility_id", "facility_name", "lat", "lon"), other)
    return out.withColumn("dist_mi", F.round("dist_mi", 4))


@query("crosswalk_presence", """
WITH a AS (SELECT DISTINCT p_brand AS polcode FROM {part} WHERE p_size > 45 AND p_type = 'PROMO'), b AS (SELECT p_brand AS polcode, min(p_name) AS polname FROM {part} WHERE p_retailprice < 920 AND p_brand NOT IN ('Brand#3', 'Brand#5') GROUP BY 1),
c AS (SELECT DISTINCT p_brand AS polcode FROM {part} WHERE p_size = 1 AND p_brand NOT IN ('Brand#3', 'Brand#5'))
SELECT polcode, CAST(a.polcode IS NOT NULL AS INT) AS in_first, CAST(b.polcode IS NOT NULL AS INT) AS in_second, CAST(c.polcode IS NOT NULL AS INT) AS in_third, polname AS name_second
FROM a FULL JOIN b USING (polcode) FULL JOIN c USING (polcode)""")
def _(t):
    code = F.col("p_brand").alias("polcode")
    lists = {
        "first": t.part.where("p_size > 45 and p_type = 'PROMO'").select(code),
        "second": t.part.where("p_retailprice < 920").select(code, F.col("p_name").alias("polname")),
        "third": t.part.where("p_size = 1").select(code),
    }
    out = compare.pollutant_crosswalk(lists, left_out=("Brand#3", "Brand#5"), spare=("first",))
    return out.select("polcode", "in_first", "in_second", "in_third", "name_second")


@query("speciation_factors", """
SELECT c_custkey AS prof_id, p_partkey AS pol_id, l_quantity AS massfrac, c_mktsegment AS prof_nm, p_name AS pol_nm, p_brand AS polcode, l_orderkey, l_extendedprice
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {part} ON l_partkey = p_partkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def _(t):
    mass = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("prof_id"), F.col("l_partkey").alias("pol_id"), F.col("l_quantity").alias("massfrac"), "l_orderkey", "l_extendedprice"
    )
    profiles = t.customer.select(F.col("c_custkey").alias("prof_id"), F.col("c_mktsegment").alias("name"))
    species = t.part.select(F.col("p_partkey").alias("pol_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("cas_num"))
    return compare.speciation_factors(mass, profiles, species, ("BUILDING", "MACHINERY"))


@query("aircraft_species", """
SELECT n_nationkey AS profile_code, n_name AS profile_name, s_suppkey AS species_id, p_name AS spec_nm FROM {nation} LEFT JOIN {supplier} ON s_nationkey = n_nationkey LEFT JOIN {part} ON p_partkey = s_suppkey
WHERE n_name ILIKE '%nation_2%' AND n_regionkey IN (0, 2)""")
def _(t):
    profiles = t.nation.select(F.col("n_nationkey").alias("profile_code"), F.col("n_name").alias("profile_name"), F.col("n_regionkey").alias("region"))
    species = t.supplier.select(F.col("s_nationkey").alias("profile_code"), F.col("s_suppkey").alias("species_id"))
    props = t.part.select(F.col("p_partkey").alias("species_id"), F.col("p_name").alias("spec_nm"))
    return compare.aircraft_species(profiles, species, props, "Nation_2", (0, 2)).drop("region")


NEI_SQL = "(SELECT c_mktsegment AS state, CAST(l_linenumber AS BIGINT) AS scc, o_custkey AS eis_facility_id, c_nationkey AS agency_facility_id, p_brand AS pollutant_code, p_name AS pollutant_desc, l_orderkey, l_partkey, l_extendedprice FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {part} ON l_partkey = p_partkey)"


def _nei(t):
    points = (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("c_mktsegment").alias("state"), F.col("l_linenumber").cast("bigint").alias("scc"), F.col("o_custkey").alias("eis_facility_id"),
            F.col("c_nationkey").alias("agency_facility_id"), F.col("p_brand").alias("pollutant_code"), F.col("p_name").alias("pollutant_desc"),
            "l_orderkey", "l_partkey", "l_extendedprice",
        )
    )
    order = [F.col(c) for c in ("l_orderkey", "l_partkey", "l_extendedprice", "pollutant_desc")]
    return compare.nei_extract(points, order, "BUILDING", (1, 3, 5))


@query("nei_facilities", f"SELECT DISTINCT eis_facility_id, agency_facility_id FROM {NEI_SQL} WHERE state = 'BUILDING' AND scc IN (1, 3, 5)")
def _(t):
    return _nei(t)["facilities"]


@query("nei_pollutants", f"""SELECT pollutant_code, arg_min(pollutant_desc, (l_orderkey, l_partkey, l_extendedprice, pollutant_desc)) AS pollutant_desc FROM {NEI_SQL} WHERE state = 'BUILDING' AND scc IN (1, 3, 5) GROUP BY 1""")
def _(t):
    return _nei(t)["pollutants"]


@query("imputation_report", """
WITH a AS (SELECT facility_id, min(filled_from) AS filled FROM (SELECT 'f' || CAST(o_custkey AS VARCHAR) AS facility_id, CASE WHEN o_orderstatus = 'P' THEN 'f' || CAST(o_orderkey % 100 AS VARCHAR) END AS filled_from, o_orderkey,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM {orders}) WHERE rn = 1 GROUP BY 1)
SELECT a.facility_id, filled AS filled_from_facility_id, o.district AS fac_district, d.district AS donor_district FROM a JOIN {facilities} o USING (facility_id) LEFT JOIN {facilities} d ON d.facility_id = filled WHERE filled IS NOT NULL""")
def _(t):
    fleet_rows = t.orders.select(
        F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("facility_id"), F.lit("g").alias("facility_group"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("f"), (F.col("o_orderkey") % 100).cast("string"))).alias("filled_from_facility_id"),
        F.col("o_orderkey").alias("ops_per_diff"), F.when(F.col("o_orderstatus") == "P", "donor").otherwise("traffic").alias("source"),
    )
    out = reports.imputation_report(fleet_rows, t.facilities, [F.col("ops_per_diff")])
    return out.select("facility_id", "filled_from_facility_id", "fac_district", "donor_district")


@query("report_operations", """SELECT facility_id AS "Facility", facility_name AS "Facility Name", facility_group AS "Facility Group", facility_type AS "Facility Type", annual_operations AS "Annual Operations",
  round(annual_operations / 365, 8) AS "Summer Daily" FROM {facilities}""")
def _(t):
    out = reports.report_tables(t.facilities, t.fleet_input, t.forecast)["operations"]
    return out.withColumn("Summer Daily", F.round("Summer Daily", 8))


@query("report_fleet", """SELECT facility_id AS "Facility", facility_name AS "Facility Name", facility_group AS "Facility Group", facility_type AS "Facility Type", annual_operations AS "Annual Operations",
  airframe_id AS "Airframe", engine_id AS "Engine", round(fleetmix, 8) AS "Fleetmix" FROM {fleet_input}""")
def _(t):
    out = reports.report_tables(t.facilities, t.fleet_input, t.forecast)["fleet"]
    return out.withColumn("Fleetmix", F.round("Fleetmix", 8))


@query("report_factors", """SELECT facility_id AS "Facility", facility_name AS "Facility Name", facility_group AS "Facility Group", facility_type AS "Facility Type", sysyear AS "Year",
  round(t_aops / annual_operations, 8) AS "Projection Factor" FROM {forecast} JOIN {facilities} USING (facility_id)""")
def _(t):
    factors = t.forecast.join(t.facilities, "facility_id").withColumn("proj_fac", F.try_divide("t_aops", "annual_operations"))
    out = reports.report_tables(t.facilities, t.fleet_input, factors)["factors"]
    return out.withColumn("Projection Factor", F.round("Projection Factor", 8))


@query("report_extract", """SELECT airport AS "Airport", facility_group AS "Facility Group", county AS "County", year AS "Year", mode AS "Mode", CAST(count(*) AS BIGINT) AS n, sum(ltos) AS "LTOs" FROM {inventory} GROUP BY ALL""")
def _(t):
    out = reports.emission_extract(t.inventory)
    return out.groupBy("Airport", "Facility Group", "County", "Year", "Mode").agg(F.count(F.lit(1)).alias("n"), F.sum("LTOs").alias("LTOs"))
