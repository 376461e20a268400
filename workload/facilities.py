"""Facility master, operations, traffic and projection queries."""

from pyspark.sql import functions as F

import workload.roles  # noqa: F401
from skyledger.operators import joins, measures
from skyledger.plans import facility, operations, projection, traffic
from workload.registry import query
from workload.relational import POLYGON_SQL


def rounded(df, places=6, *columns):
    return df.withColumns({c: F.round(c, places) for c in columns})


@query("prior_operations", """
SELECT facility_id, airport, county, sum(CASE WHEN scc_description = 'General Aviation, Piston' THEN lto ELSE 0 END) * 2 AS general_aviation_piston,
  sum(CASE WHEN scc_description = 'General Aviation, Turbine' THEN lto ELSE 0 END) * 2 AS general_aviation_turbine,
  sum(CASE WHEN scc_description = 'Air Taxi, Piston' THEN lto ELSE 0 END) * 2 AS air_taxi_piston,
  sum(CASE WHEN scc_description = 'Air Taxi, Turbine' THEN lto ELSE 0 END) * 2 AS air_taxi_turbine,
  sum(CASE WHEN scc_description = 'Military' THEN lto ELSE 0 END) * 2 AS military,
  sum(CASE WHEN scc_description = 'Commercial' THEN lto ELSE 0 END) * 2 AS commercial,
  sum(CASE WHEN scc_description IN ('General Aviation, Piston', 'General Aviation, Turbine', 'Air Taxi, Piston', 'Air Taxi, Turbine', 'Military', 'Commercial') THEN lto ELSE 0 END) * 2 AS total_ops
FROM {inventory} WHERE eis_pollutant_id = 'CO' GROUP BY 1, 2, 3""")
def _(t):
    return facility.prior_operations(t.inventory)


MASTER_SQL = """WITH base AS (SELECT facility_id, min(facility_name) AS facility_name, round(sum(operations_commuter + operations_commercial + operations_air_taxi + operations_ga_local + operations_ga_itin + operations_military), 4) AS total_ops
  FROM {registry} WHERE airport_status_code = 'O' GROUP BY 1),
fc AS (SELECT facility_id, max(CASE WHEN sysyear = 1998 THEN t_aops END) AS forecast_1998, max(CASE WHEN sysyear = 1999 THEN t_aops END) AS forecast_1999 FROM {forecast} GROUP BY 1),
pr AS (SELECT facility_id, sum(CASE WHEN scc_description <> 'Electric' THEN lto ELSE 0 END) * 2 AS prior_ops FROM {inventory} WHERE eis_pollutant_id = 'CO' GROUP BY 1),
tr AS (SELECT facility_id, sum(CASE WHEN year_id = 1998 THEN total_ops END) AS traffic_1998, sum(CASE WHEN year_id = 1998 AND season = 'Summer' THEN total_ops END) AS traffic_summer_1998,
  sum(CASE WHEN year_id = 1999 THEN total_ops END) AS traffic_1999, sum(CASE WHEN year_id = 1999 AND season = 'Summer' THEN total_ops END) AS traffic_summer_1999 FROM {traffic} GROUP BY 1),
rp AS (SELECT facility_id, round(sum(annual_operations), 2) AS reported_ops, min(operations_year) AS reported_year FROM {reported} GROUP BY 1),
ow AS (SELECT facility_id, round(ops_1998, 2) AS own_ops_1998, round(ops_1999, 2) AS own_ops_1999 FROM {own_ops}),
tx AS (SELECT facility_id, round(avg(CASE WHEN departures_metrics > 0 THEN avg_taxi_out_time END), 6) AS taxi_out_1998,
  round(avg(CASE WHEN arrivals_metrics > 0 THEN avg_taxi_in_time END), 6) AS taxi_in_1998,
  round(avg(CASE WHEN departures_metrics > 0 AND season = 'Summer' THEN avg_taxi_out_time END), 6) AS taxi_out_summer_1998,
  round(avg(CASE WHEN arrivals_metrics > 0 AND season = 'Summer' THEN avg_taxi_in_time END), 6) AS taxi_in_summer_1998 FROM {taxi} WHERE year = 1998 GROUP BY 1)
SELECT base.*, forecast_1998, forecast_1999, prior_ops, traffic_1998, traffic_summer_1998, traffic_1999, traffic_summer_1999,
  reported_ops, reported_year, own_ops_1998, own_ops_1999, taxi_out_1998, taxi_in_1998, taxi_out_summer_1998, taxi_in_summer_1998, tx_dot AS tx_dot_group
FROM base LEFT JOIN fc USING (facility_id) LEFT JOIN pr USING (facility_id) LEFT JOIN tr USING (facility_id) LEFT JOIN rp USING (facility_id)
LEFT JOIN ow USING (facility_id) LEFT JOIN tx USING (facility_id) LEFT JOIN {planning} USING (facility_id)"""


@query("facility_master", MASTER_SQL)
def _(t):
    out = facility.facility_master(
        t.registry, t.forecast, t.inventory, t.traffic, t.taxi, t.reported, t.own_ops, t.planning, years=(1998, 1999)
    )
    out = rounded(out, 6, "taxi_out_1998", "taxi_in_1998", "taxi_out_summer_1998", "taxi_in_summer_1998")
    out = rounded(out, 2, "reported_ops", "own_ops_1998", "own_ops_1999")
    return rounded(out, 4, "total_ops").select(
        "facility_id", "facility_name", "total_ops", "forecast_1998", "forecast_1999", "prior_ops", "traffic_1998", "traffic_summer_1998",
        "traffic_1999", "traffic_summer_1999", "reported_ops", "reported_year", "own_ops_1998", "own_ops_1999", "taxi_out_1998", "taxi_in_1998",
        "taxi_out_summer_1998", "taxi_in_summer_1998", "tx_dot_group",
    )


CLASSIFY_SQL = """SELECT facility_id, CASE
  WHEN upper(facility_id) IN ('F3', 'F10') THEN 'Commercial' WHEN upper(facility_id) IN ('F4', 'F10') THEN 'Reliever'
  WHEN tx_dot = 'TASP' THEN 'TASP' WHEN ownership IN ('MA', 'MR', 'MN') THEN 'Military' WHEN medical_use = 'Y' THEN 'Medical'
  WHEN other_services = 'AGRI' OR facility_name ILIKE '%ranch%' OR facility_name ILIKE '%farm%' THEN 'Farm/Ranch'
  WHEN used = 'PR' AND facility_type = 'HELIPORT' THEN 'Other_PR_Heliports' WHEN used = 'PR' THEN 'Other_PR_Airports'
  WHEN used = 'PU' AND facility_type = 'HELIPORT' THEN 'Other_PU_Heliports' WHEN used = 'PU' THEN 'Other_PU_Airports' END AS facility_group
FROM {registry} LEFT JOIN {planning} USING (facility_id)"""


def _classified(t):
    base = joins.lookup(t.registry, t.planning.withColumnRenamed("tx_dot", "tx_dot_group"), ["facility_id"])
    return facility.classify_facility(base, reliever_ids=["F4", "F10"], commercial_ids=["F3", "F10"])


@query("classify_cascade", CLASSIFY_SQL)
def _(t):
    return _classified(t).select("facility_id", "facility_group")


CLASS_SPLIT = """CASE WHEN facility_group = 'Farm/Ranch' AND facility_type = 'AIRPORT' THEN 'fandr_arpt' WHEN facility_group = 'Farm/Ranch' THEN 'fandr_heli'
  WHEN facility_group = 'Military' AND facility_type = 'AIRPORT' THEN 'mil_arpt' WHEN facility_group = 'Military' THEN 'mil_heli'
  WHEN facility_group = 'TASP' AND facility_type = 'AIRPORT' THEN 'tasp_arpt' WHEN facility_group = 'TASP' THEN 'tasp_heli'
  WHEN facility_group = 'Other_PU_Airports' AND facility_type = 'AIRPORT' THEN 'opua_arpt' END"""


@query("class_split", f"SELECT facility_id, {CLASS_SPLIT} AS fac_class FROM {{facilities}} WHERE facility_group <> 'Commercial'")
def _(t):
    return facility.class_split(t.facilities).select("facility_id", "fac_class")


@query("facility_county_check", POLYGON_SQL + """,
reg AS (SELECT facility_id, county FROM {registry} WHERE used = 'PU'),
loc AS (SELECT facility_id, lower(n_name) AS county, poly_id FROM {points} LEFT JOIN hits USING (facility_id) LEFT JOIN {nation} ON poly_id = n_nationkey WHERE nationkey < 20)
SELECT facility_id, lower(reg.county) AS county_reg, loc.county AS county_pt, loc.poly_id + 48000 AS fips_pt, reg.facility_id IS NOT NULL AS in_reg, loc.facility_id IS NOT NULL AS in_pt,
  CAST(coalesce(lower(reg.county) = loc.county, false) AS INT) AS qc
FROM reg FULL JOIN loc USING (facility_id)""")
def _(t):
    points = t.points.select(
        F.upper("facility_id").alias("ident"), F.col("facility_name").alias("name"),
        F.when(F.col("nationkey") < 20, "TX").otherwise("OK").alias("state"), F.col("county").alias("servcity"), "lon", "lat",
    )
    counties = t.nation.select(
        F.col("n_nationkey").alias("poly_id"), F.col("n_name").alias("county"), F.col("n_regionkey").alias("district"),
        (F.col("n_nationkey") + 48000).alias("fips"),
    )
    out = facility.facility_county_check(t.registry.where("used = 'PU'"), points, t.rings, counties, cell=10.0)
    return out.select("facility_id", "county_reg", "county_pt", "fips_pt", "in_reg", "in_pt", "qc")


@query("impute_rules", """
WITH o AS (SELECT 'f' || CAST(o_custkey AS VARCHAR) AS facility_id, CASE WHEN count(*) = 1 THEN 0.0 ELSE CAST(count(*) AS DOUBLE) END AS n, count(*) / 100.0 AS daily
  FROM {orders} WHERE year(o_orderdate) = 1998 GROUP BY o_custkey),
p AS (SELECT 'f' || CAST(o_custkey AS VARCHAR) AS facility_id, CAST(count(*) AS DOUBLE) AS prior_ops FROM {orders} WHERE year(o_orderdate) = 1995 GROUP BY o_custkey),
g AS (""" + CLASSIFY_SQL.replace("{planning}", "{planning}") + """),
j AS (SELECT r.facility_id, r.facility_type, g.facility_group, n, daily, CASE
    WHEN g.facility_group IN ('Other_PU_Airports', 'Other_PR_Airports') THEN 110.0 WHEN g.facility_group = 'Farm/Ranch' THEN 2.0
    WHEN facility_type = 'HELIPORT' AND g.facility_group = 'Medical' THEN 156.0 WHEN facility_type = 'HELIPORT' AND prior_ops IS NULL THEN 110.0 ELSE prior_ops END AS imp
  FROM {registry} r JOIN g USING (facility_id) LEFT JOIN o USING (facility_id) LEFT JOIN p USING (facility_id))
SELECT facility_id, coalesce(n, imp) AS annual_operations,
  round(CASE WHEN n IS NOT NULL THEN daily WHEN facility_group IN ('Medical', 'Other_PR_Airports', 'Farm/Ranch', 'Other_PR_Heliports', 'Other_PU_Airports') THEN imp * 0.217264143 END, 6) AS summer_daily,
  n IS NULL AND imp IS NOT NULL AS imputed, 'NATION_' || CAST(c_nationkey AS VARCHAR) AS county_arpt
FROM j JOIN {customer} ON facility_id = 'f' || CAST(c_custkey AS VARCHAR)""")
def _(t):
    fid = F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("facility_id")
    per_year = lambda y: t.orders.where(F.year("o_orderdate") == y).groupBy(fid).agg(F.count(F.lit(1)).alias("n"))
    ops = per_year(1998).select(
        "facility_id", F.when(F.col("n") == 1, "-").otherwise(F.col("n").cast("string")).alias("annual_operations"),
        (F.col("n") / 100).cast("string").alias("summer_daily"),
    )
    prior = per_year(1995).select("facility_id", F.col("n").alias("prior_ops"))
    facs = joins.lookup(_classified(t).select("facility_id", "facility_type", "facility_group"), prior, ["facility_id"])
    counties = t.customer.select(
        F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("facility_id"),
        F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("county_arpt"),
    )
    out = operations.ops_with_metadata(facs, ops, counties)
    return rounded(out, 6, "summer_daily").select("facility_id", "annual_operations", "summer_daily", "imputed", "county_arpt")


@query("traffic_growth_long", """
WITH w AS (SELECT facility_id, sysyear, CAST(itn_ac AS DOUBLE) AS ac, CAST(itn_at AS DOUBLE) AS ta, CAST(itn_ga + loc_ga AS DOUBLE) AS ga, CAST(itn_mil + loc_mil AS DOUBLE) AS mil FROM {forecast}),
l AS (SELECT facility_id, sysyear, u.aviation_type, u.v AS operations, CASE WHEN u.aviation_type = 'Total' THEN 1.0 ELSE u.v / nullif(ac + ta + ga + mil, 0) END AS pct FROM w,
  LATERAL (SELECT unnest(['Air Carrier', 'Air Taxi', 'General Aviation', 'Military', 'Total']) AS aviation_type, unnest([ac, ta, ga, mil, ac + ta + ga + mil]) AS v) u),
b AS (SELECT facility_id, aviation_type, operations AS bop, pct AS bpct FROM l WHERE sysyear = 1998)
SELECT l.facility_id, l.sysyear, l.aviation_type, operations, round(pct, 8) AS operations_pct, round(operations / nullif(bop, 0), 8) AS growth,
  round(annual_operations * bpct, 6) AS base_ops, round(annual_operations * bpct * operations / nullif(bop, 0), 6) AS projected_operations
FROM l LEFT JOIN b USING (facility_id, aviation_type) LEFT JOIN {facilities} USING (facility_id)""")
def _(t):
    out = traffic.traffic_growth_long(t.forecast, t.facilities.select("facility_id", "annual_operations"), 1998)
    return rounded(rounded(out, 8, "operations_pct", "growth"), 6, "base_ops", "projected_operations")


ENGINE_SQL = """WITH i AS (SELECT aircraft_id, arg_min(physical_class, (-n, physical_class)) AS c FROM (SELECT aircraft_id, physical_class, count(*) AS n FROM {traffic}
    WHERE physical_class <> '-' AND aircraft_id NOT IN ('', '#VALUE!') GROUP BY 1, 2) GROUP BY 1),
ty AS (SELECT aircraft_type, arg_min(physical_class, (-n, physical_class)) AS c FROM (SELECT aircraft_type, physical_class, count(*) AS n FROM {traffic}
    WHERE physical_class <> '-' AND aircraft_type NOT IN ('', ' - unknown', '#VALUE!', 'A') GROUP BY 1, 2) GROUP BY 1),
e AS (SELECT t.*, CASE WHEN user_class IN ('Air Carrier', 'Freight') THEN 'Air Carrier' ELSE user_class END AS aviation_type,
  coalesce(CASE WHEN physical_class IN ('Jet', 'Turbine') THEN 'Turbine' WHEN physical_class = 'Piston' THEN 'Piston' END,
    CASE i.c WHEN 'Jet' THEN 'Turbine' ELSE i.c END, CASE ty.c WHEN 'Jet' THEN 'Turbine' ELSE ty.c END,
    CASE WHEN weight_class = 'Large Jet Eqpt' OR t.aircraft_type LIKE '%Bell%' THEN 'Turbine' END) AS engine_type
  FROM {traffic} t LEFT JOIN i ON t.aircraft_id = i.aircraft_id LEFT JOIN ty ON t.aircraft_type = ty.aircraft_type)"""


@query("engine_type_impute", ENGINE_SQL + " SELECT facility_id, aviation_type, engine_type, CAST(count(*) AS BIGINT) AS n, sum(total_ops) AS ops FROM e GROUP BY 1, 2, 3")
def _(t):
    used = ["facility_id", "user_class", "physical_class", "weight_class", "aircraft_id", "aircraft_type", "total_ops"]
    typed = traffic.engine_type_impute(t.traffic.select(*used))
    return typed.groupBy("facility_id", "aviation_type", "engine_type").agg(F.count(F.lit(1)).alias("n"), F.sum("total_ops").alias("ops"))


@query("aviation_type_mix", ENGINE_SQL + """
SELECT facility_id, airport, year_id, season, aircraft_id, aircraft_type, total_ops, aviation_type, sum(total_ops) OVER w AS aviation_type_ops,
  round(total_ops / sum(total_ops) OVER w, 10) AS aviation_type_mix FROM e WHERE engine_type IS NOT NULL WINDOW w AS (PARTITION BY facility_id, aviation_type)""")
def _(t):
    rows = t.traffic.drop("facility_name", "aircraft_type_id")
    out = traffic.aviation_type_mix(traffic.engine_type_impute(rows))
    return rounded(out, 10, "aviation_type_mix").select(
        "facility_id", "airport", "year_id", "season", "aircraft_id", "aircraft_type", "total_ops", "aviation_type", "aviation_type_ops", "aviation_type_mix"
    )


AIRCRAFT_SQL = """WITH d AS (SELECT facility_id, facility_name, coalesce(aircraft_id, '-999') AS aircraft_id, aircraft_type_id,
  CASE WHEN aircraft_type LIKE '%- unknown%' THEN '-999' ELSE aircraft_type END AS aircraft_type, user_class, total_ops,
  CASE physical_class WHEN 'Piston' THEN 'Piston' WHEN '-' THEN NULL ELSE 'Turbine' END AS engine FROM {traffic} WHERE aircraft_type_id IS NOT NULL),
g AS (SELECT facility_id, facility_name, aircraft_id, aircraft_type_id, aircraft_type, user_class, sum(total_ops) AS total_ops, min(engine) AS engine_type FROM d GROUP BY ALL),
m AS (SELECT lower(aircraft_id) AS aircraft_id, lower(aircraft_type) AS aircraft_type, engine_type, lower(min(aircraft_type_id)) AS aircraft_type_id,
  string_agg(DISTINCT user_class, ',' ORDER BY user_class) AS user_classes, count(DISTINCT facility_name) AS n_facilities
  FROM g WHERE aircraft_id <> '-999' AND engine_type IS NOT NULL GROUP BY 1, 2, 3)"""
FRAMES_SQL = "(SELECT p_name AS model, CAST(min(p_partkey) AS INT) AS airframe_id FROM {part} WHERE p_name LIKE 'red%' GROUP BY p_name)"


def _master(t):
    frames = t.part.where("p_name like 'red%'").groupBy(F.upper("p_name").alias("model")).agg(F.min("p_partkey").cast("int").alias("airframe_id"))
    return traffic.aircraft_master(t.traffic, frames)


@query("aircraft_master", AIRCRAFT_SQL + f" SELECT m.*, airframe_id FROM m LEFT JOIN {FRAMES_SQL} f ON model = aircraft_type")
def _(t):
    parts = _master(t)
    out = parts["matched"].unionByName(parts["unmatched"], allowMissingColumns=True)
    return out.select(
        "aircraft_id", "aircraft_type", "engine_type", "aircraft_type_id", F.array_join("user_classes", ",").alias("user_classes"),
        F.size("facilities").cast("bigint").alias("n_facilities"), "airframe_id",
    )


@query("aircraft_candidates", AIRCRAFT_SQL + """,
c AS (SELECT facility_id, facility_name, user_class, string_agg(DISTINCT aircraft_id, ',' ORDER BY aircraft_id) AS ids FROM g WHERE aircraft_id <> '-999' GROUP BY 1, 2, 3)
SELECT g.facility_id, g.user_class, g.aircraft_type_id, g.aircraft_type, g.total_ops, ids FROM g LEFT JOIN c USING (facility_id, facility_name, user_class) WHERE aircraft_id = '-999'""")
def _(t):
    return _master(t)["candidates"].select(
        "facility_id", "user_class", "aircraft_type_id", "aircraft_type", "total_ops", F.array_join("candidate_ids", ",").alias("ids")
    )


@query("source_coverage", """
WITH s AS (SELECT DISTINCT facility_id, 'r' AS src FROM {registry} WHERE airport_status_code = 'O' UNION ALL SELECT DISTINCT facility_id, 't' FROM {traffic} WHERE year_id = 1998 UNION ALL
  SELECT DISTINCT facility_id, 'f' FROM {forecast} WHERE t_aops > 1 UNION ALL SELECT DISTINCT facility_id, 'a' FROM {reported})
SELECT facility_id, CAST(max(CAST(src = 'r' AS INT)) AS INT) AS in_registry, max(CAST(src = 't' AS INT)) AS in_traffic, max(CAST(src = 'f' AS INT)) AS in_forecast,
  max(CAST(src = 'a' AS INT)) AS in_reported, count(*) AS n_sources FROM s GROUP BY 1""")
def _(t):
    return traffic.source_coverage({
        "registry": t.registry.where("airport_status_code = 'O'"), "traffic": t.base_traffic,
        "forecast": t.forecast.where("t_aops > 1"), "reported": t.reported,
    })


FACTOR_SQL = """WITH pf AS (SELECT facility_id, sysyear, t_aops / nullif(max(CASE WHEN sysyear = 1998 THEN t_aops END) OVER (PARTITION BY facility_id), 0) AS v FROM {forecast} WHERE t_aops >= 1)"""


@query("projection_factor", FACTOR_SQL + """
SELECT facility_id, sysyear, round(v, 8) AS proj_fac FROM pf UNION ALL
SELECT facility_id, CAST(y AS INT), 1.0 FROM (VALUES ('f5'), ('f8'), ('f11')) k(facility_id), generate_series(1995, 2001) g(y)
WHERE (facility_id, y) NOT IN (SELECT facility_id, sysyear FROM pf)""")
def _(t):
    return rounded(projection.projection_factor(t.forecast, 1998, (("f5", "f8", "f11"), 1995, 2001)), 8, "proj_fac")


@query("projection_all", FACTOR_SQL + """,
fa AS (SELECT facility_id, facility_group, district, annual_operations FROM {facilities}),
kn AS (SELECT * FROM pf WHERE v IS NOT NULL),
obs AS (SELECT facility_id, max(annual_operations) / 100000 AS v FROM {reported} GROUP BY 1),
own AS (SELECT fa.*, sysyear, CASE WHEN facility_group = 'Commercial' AND sysyear = 1999 THEN coalesce(obs.v, kn.v) ELSE kn.v END AS v, NULL AS src FROM fa LEFT JOIN kn USING (facility_id) LEFT JOIN obs USING (facility_id) WHERE facility_group = 'Commercial' OR (facility_group = 'TASP' AND kn.facility_id IS NOT NULL)),
need AS (SELECT * FROM fa WHERE facility_group = 'TASP' AND facility_id NOT IN (SELECT facility_id FROM kn)),
dn AS (SELECT DISTINCT facility_id, district, annual_operations FROM own WHERE facility_group = 'TASP'),
pick AS (SELECT facility_id, donor FROM (SELECT n.facility_id, d.facility_id AS donor, row_number() OVER (PARTITION BY n.facility_id ORDER BY abs(n.annual_operations - d.annual_operations), d.facility_id) AS rn
  FROM need n LEFT JOIN dn d USING (district)) WHERE rn = 1),
filled AS (SELECT need.*, o.sysyear, o.v, donor AS src FROM need JOIN pick USING (facility_id) LEFT JOIN own o ON o.facility_id = donor),
nat AS (SELECT sysyear, sum(CASE WHEN facility_id <> '' THEN itn_mil END) / 1000.0 AS mil, sum(t_aops) / 1000.0 AS com FROM {forecast} GROUP BY 1),
rest AS (SELECT fa.*, sysyear, CASE WHEN facility_group = 'Military' THEN mil ELSE com END AS v, NULL AS src FROM fa CROSS JOIN (SELECT unnest(generate_series(1995, 2001)) AS sysyear) LEFT JOIN nat USING (sysyear) WHERE facility_group NOT IN ('Commercial', 'TASP')),
al AS (SELECT * FROM own UNION ALL SELECT * FROM filled UNION ALL SELECT * FROM rest),
x AS (SELECT al.*, max(sysyear) OVER (PARTITION BY facility_id) AS last FROM al)
SELECT facility_id, facility_group, CAST(sysyear AS INT) AS sysyear, round(v, 8) AS proj_fac, src AS filled_from_facility_id FROM x UNION ALL
SELECT facility_id, facility_group, CAST(y AS INT), round(v, 8), src FROM x, generate_series(2002, 2005) g(y) WHERE sysyear = 2001""")
def _(t):
    factors = projection.projection_factor(t.forecast, 1998, None).where("proj_fac is not null")
    observed = t.reported.groupBy("facility_id").agg((F.max("annual_operations") / 100000).alias("proj_fac"))
    national = t.forecast.groupBy("sysyear").agg(
        (F.sum("itn_mil") / 1000).alias("mil_proj_fac"), (F.sum("t_aops") / 1000).alias("com_av_proj_fac")
    )
    ops = t.facilities.select("facility_id", "facility_group", "district", "annual_operations")
    out = projection.projection_all(ops, factors, observed, national, observed_year=1999, first=1995, end=2001, last=2005)
    return rounded(out, 8, "proj_fac").select("facility_id", "facility_group", "sysyear", "proj_fac", "filled_from_facility_id")
