"""Fleet mix, performance and quality queries."""

from pyspark.sql import functions as F

import workload.roles  # noqa: F401
from skyledger.operators import joins, measures, quality
from skyledger.plans import fleet, performance
from workload.facilities import rounded
from workload.registry import query


@query("fleet_mix", """
WITH s AS (SELECT l_suppkey, p_type, sum(l_quantity) AS qty FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT l_suppkey, p_type, qty, sum(qty) OVER (PARTITION BY l_suppkey) AS total_qty, round(qty / sum(qty) OVER (PARTITION BY l_suppkey), 8) AS fleetmix FROM s""")
def _(t):
    lines = joins.lookup(t.lineitem, t.part, {"l_partkey": "p_partkey"}, ["p_type"], "inner")
    sums = measures.group_sums(lines, ["l_suppkey", "p_type"], qty="l_quantity")
    # One row per part type and supplier by now: a window holds as many rows as there are types.
    out = measures.share_of_aggregate(sums, ["l_suppkey"], "qty", "fleetmix", "total_qty")
    return rounded(out, 8, "fleetmix")


MIX_SQL = """WITH b AS (SELECT year_id, facility_id, airport, lower(trim(aircraft_id)) AS aircraft_id, sum(total_ops) AS ops FROM {%s}
  WHERE aircraft_type_id IS NOT NULL AND aircraft_type NOT LIKE '%%unknown%%' AND aircraft_type NOT LIKE '%%#VALUE!%%' AND aircraft_id IS NOT NULL GROUP BY ALL),
a AS (SELECT b.*, m.aircraft_type, m.aircraft_type_id, m.airframe_id, m.airframe_type FROM b JOIN {aircraft_map} m USING (aircraft_id) WHERE airframe_id IS NOT NULL),
s AS (SELECT *, sum(ops) OVER w AS total, ops / sum(ops) OVER w AS mix FROM a WINDOW w AS (PARTITION BY year_id, facility_id, airport))"""


@query("fleet_mix_traffic", MIX_SQL % "traffic" + """
SELECT year_id, facility_id, airport, aircraft_id, airframe_id, ops AS total_ops_by_craft, total AS total_ops_by_arpt, round(mix, 8) AS fleetmix FROM s""")
def _(t):
    shares, _ = fleet.fleet_mix(t.traffic, t.aircraft_map)
    return rounded(shares, 8, "fleetmix").select(
        "year_id", "facility_id", "airport", "aircraft_id", "airframe_id", "total_ops_by_craft", "total_ops_by_arpt", "fleetmix"
    )


@query("fleet_mix_audit", MIX_SQL % "traffic" + """
SELECT facility_id, x.before, y.after, x.before - y.after AS lost, round((x.before - y.after) * 100 / nullif(x.before, 0), 6) AS percent_lost
FROM (SELECT facility_id, sum(ops) AS before FROM b GROUP BY 1) x FULL JOIN (SELECT facility_id, sum(ops) AS after FROM a GROUP BY 1) y USING (facility_id)""")
def _(t):
    return rounded(fleet.fleet_mix(t.traffic, t.aircraft_map)[1], 6, "percent_lost")


FILL_SQL = MIX_SQL % "base_traffic" + """,
ar AS (SELECT facility_id, facility_group, facility_type, county, district, annual_operations FROM {facilities} WHERE facility_type <> 'HELIPORT'),
own AS (SELECT ar.*, aircraft_id, airframe_id, mix FROM ar JOIN s USING (facility_id)),
need AS (SELECT * FROM ar WHERE facility_id NOT IN (SELECT facility_id FROM s)),
dn AS (SELECT DISTINCT facility_id, facility_group, district, annual_operations FROM own),
moved AS (SELECT facility_id, facility_group, district, annual_operations FROM dn UNION ALL SELECT facility_id, facility_group, 'ASIA', annual_operations FROM dn WHERE facility_group = 'Military' AND district = 'EUROPE'),
near AS (SELECT facility_id, donor, gap FROM (SELECT n.facility_id, d.facility_id AS donor, abs(n.annual_operations - d.annual_operations) AS gap,
    row_number() OVER (PARTITION BY n.facility_id ORDER BY abs(n.annual_operations - d.annual_operations), d.facility_id) AS rn
  FROM need n LEFT JOIN moved d ON n.facility_group = d.facility_group AND n.district = d.district WHERE n.facility_group IN ('TASP', 'Military')) WHERE rn = 1),
farm AS (SELECT facility_id AS donor FROM dn WHERE facility_group = 'Farm/Ranch' ORDER BY annual_operations, facility_id LIMIT 1),
pub AS (SELECT facility_id AS donor FROM dn WHERE facility_group = 'Other_PU_Airports' ORDER BY annual_operations, facility_id LIMIT 1)"""


@query("fleet_mix_all", FILL_SQL + """,
bo AS (SELECT facility_id, donor FROM near UNION ALL SELECT facility_id, (SELECT donor FROM farm) FROM need WHERE facility_group = 'Farm/Ranch'
  UNION ALL SELECT facility_id, (SELECT donor FROM pub) FROM need WHERE facility_group = 'Other_PU_Airports'),
al AS (SELECT facility_id, aircraft_id, airframe_id, mix, NULL AS donor FROM own UNION ALL
  SELECT bo.facility_id, o.aircraft_id, o.airframe_id, o.mix, donor FROM bo LEFT JOIN own o ON o.facility_id = donor UNION ALL
  SELECT facility_id, CAST(h AS VARCHAR), h, CAST(1.0 AS DOUBLE) / 3, NULL FROM {facilities}, (SELECT unnest([5238, 5177, 5331]) AS h) WHERE facility_type = 'HELIPORT' UNION ALL
  SELECT facility_id, NULL, NULL, NULL, NULL FROM need WHERE facility_group = 'Commercial'),
en AS (SELECT airframe_id, min(engine_id) AS engine_id, arg_min(engine_mod_id, engine_id) FILTER (WHERE engine_mod_id IS NOT NULL) AS engine_mod_id FROM {equipment} GROUP BY 1)
SELECT facility_id, aircraft_id, al.airframe_id, round(mix, 8) AS fleetmix, donor AS filled_from_facility_id, engine_id, engine_mod_id FROM al LEFT JOIN en USING (airframe_id)""")
def _(t):
    out = fleet.fleet_mix_all(
        t.base_traffic, t.aircraft_map, t.facilities, t.equipment, one_farm_donor=False,
        extra=(F.col("district") == "EUROPE", {"district": "ASIA"}),
    )
    return rounded(out, 8, "fleetmix").select(
        "facility_id", "aircraft_id", "airframe_id", "fleetmix", "filled_from_facility_id", "engine_id", "engine_mod_id"
    )


def _own_and_needy(t):
    shares = fleet.fleet_mix(t.base_traffic, t.aircraft_map)[0].select("facility_id", *fleet.MIX)
    ports = t.facilities.where("facility_type <> 'HELIPORT'")
    return ports.join(shares, "facility_id"), ports.join(shares.select("facility_id"), "facility_id", "left_anti")


@query("fill_nearest_donor", FILL_SQL + """
SELECT n.facility_id, donor AS filled_from_facility_id, round(gap, 4) AS ops_diff, o.aircraft_id, round(o.mix, 8) AS fleetmix
FROM near n JOIN ar USING (facility_id) LEFT JOIN own o ON o.facility_id = donor WHERE ar.facility_group = 'Military'""")
def _(t):
    own, needy = _own_and_needy(t)
    military = F.col("facility_group") == "Military"
    out = fleet.fill_nearest_donor(
        needy.where(military), own.where(military), extra=(F.col("district") == "EUROPE", {"district": "ASIA"})
    )
    return rounded(rounded(out, 8, "fleetmix"), 4, "ops_diff").select(
        "facility_id", "filled_from_facility_id", "ops_diff", "aircraft_id", "fleetmix"
    )


@query("fill_single_donor", FILL_SQL + """
SELECT n.facility_id, (SELECT donor FROM farm) AS filled_from_facility_id, o.aircraft_id, round(o.mix, 8) AS fleetmix
FROM need n JOIN own o ON o.facility_id = (SELECT donor FROM farm) WHERE n.facility_group = 'Farm/Ranch'""")
def _(t):
    own, needy = _own_and_needy(t)
    farm = F.col("facility_group") == "Farm/Ranch"
    low = own.where(farm).agg(F.min_by("facility_id", F.struct("annual_operations", "facility_id")).alias("facility_id"))
    out = fleet.fill_single_donor(needy.where(farm), own.where(farm).join(low, "facility_id", "left_semi"))
    return rounded(out, 8, "fleetmix").select("facility_id", "filled_from_facility_id", "aircraft_id", "fleetmix")


@query("fill_min_ops_donor", FILL_SQL + """
SELECT n.facility_id, (SELECT donor FROM pub) AS filled_from_facility_id, o.aircraft_id, round(o.mix, 8) AS fleetmix
FROM need n JOIN own o ON o.facility_id = (SELECT donor FROM pub) WHERE n.facility_group = 'Other_PU_Airports'""")
def _(t):
    own, needy = _own_and_needy(t)
    public = F.col("facility_group") == "Other_PU_Airports"
    out = fleet.fill_min_ops_donor(needy.where(public), own.where(public))
    return rounded(out, 8, "fleetmix").select("facility_id", "filled_from_facility_id", "aircraft_id", "fleetmix")


@query("heliport_mix", """
SELECT facility_id, h AS airframe_id, round(CAST(1.0 AS DOUBLE) / 3, 8) AS fleetmix FROM {facilities}, (SELECT unnest([5238, 5177, 5331]) AS h) WHERE facility_type = 'HELIPORT'""")
def _(t):
    out = fleet.fill_constant_mix(t.facilities.where("facility_type = 'HELIPORT'"))
    return rounded(out, 8, "fleetmix").select("facility_id", "airframe_id", "fleetmix")


@query("default_engine", """
SELECT airframe_id, min(engine_id) AS engine_id, arg_min(engine_mod_id, engine_id) FILTER (WHERE engine_mod_id IS NOT NULL) AS engine_mod_id,
  arg_min(anp_airplane_id, engine_id) FILTER (WHERE anp_airplane_id IS NOT NULL) AS anp_airplane_id,
  arg_min(anp_helicopter_id, engine_id) FILTER (WHERE anp_helicopter_id IS NOT NULL) AS anp_helicopter_id,
  arg_min(bada_id, engine_id) FILTER (WHERE bada_id IS NOT NULL) AS bada_id FROM {equipment} GROUP BY 1""")
def _(t):
    return fleet.default_engine(t.equipment, t.aircraft_map.unionByName(t.airframes, allowMissingColumns=True)).drop("bada4_id")


COLLAPSED = """fo AS (SELECT facility_id, airframe_id, engine_id, min(annual_operations) AS annual_operations, min(anp_airplane_id) AS ap, min(anp_helicopter_id) AS he, min(aircraft_id) AS aircraft_id, sum(fleetmix) AS mix
  FROM {fleet_input} GROUP BY 1, 2, 3)"""


@query("facility_fleet", "WITH " + COLLAPSED + """
SELECT facility_id, airframe_id, engine_id, annual_operations, aircraft_id, coalesce(ap, he) AS anp_id, round(mix, 8) AS fleetmix, round(annual_operations * mix, 6) AS ops_fleet FROM fo""")
def _(t):
    out = fleet.facility_fleet(t.fleet_input)
    return rounded(rounded(out, 8, "fleetmix"), 6, "ops_fleet").select(
        "facility_id", "airframe_id", "engine_id", "annual_operations", "aircraft_id", "anp_id", "fleetmix", "ops_fleet"
    )


@query("unit_fleet", """
SELECT 'stand' AS facility_id, airframe_id, engine_id, coalesce(min(anp_airplane_id), min(anp_helicopter_id)) AS anp_id, CAST(2.0 AS DOUBLE) AS ops_fleet FROM {fleet_input}
WHERE facility_group = 'Military' AND facility_type = 'AIRPORT' GROUP BY airframe_id, engine_id""")
def _(t):
    return fleet.unit_fleet(t.fleet_input.where("facility_group = 'Military'"), "stand", ["AIRPORT"]).select(
        "facility_id", "airframe_id", "engine_id", "anp_id", "ops_fleet"
    )


@query("reported_fleet_mix", """
WITH c AS (SELECT 'frame ' || p_brand AS airframe, 'E' || CAST(p_size + 1 AS VARCHAR) AS engine, sum(l_quantity) AS n FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT airframe, engine, airframe_id, g.engine_id, anp_airplane_id, anp_helicopter_id, round(n / sum(n) OVER (), 10) AS fleetmix, 'dfw' AS facility_id, CAST(1000.0 AS DOUBLE) AS annual_operations
FROM c LEFT JOIN {airframes} f ON f.model = airframe LEFT JOIN {engines} g ON g.engine_code = engine LEFT JOIN {equipment} e USING (airframe_id, engine_id)""")
def _(t):
    lines = joins.lookup(t.lineitem, t.part, {"l_partkey": "p_partkey"}, ["p_brand", "p_size"], "inner")
    reported = lines.select(
        F.concat(F.lit("frame "), "p_brand").alias("airframe"), F.concat(F.lit("E"), (F.col("p_size") + 1).cast("string")).alias("engine"),
        F.col("l_quantity").alias("operation_count"),
    )
    out = fleet.reported_fleet_mix(reported, F.lit(1000.0), t.airframes, t.engines, t.equipment, "dfw")
    return rounded(out, 10, "fleetmix")


CODE_MAP = """x AS (SELECT c.*, e.engine_id, anp_airplane_id, anp_helicopter_id FROM {codes} c LEFT JOIN (SELECT e.*, n.engine AS nm FROM {equipment} e JOIN {engine_names} n USING (engine_id)) e
  ON e.airframe_id = airframe_code AND nm = engine),
y AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (WHERE edms_id = engine_id) OVER w AS na, min(engine_id) OVER w AS lo FROM x WINDOW w AS (PARTITION BY code)),
mp AS (SELECT *, CASE WHEN n = 1 THEN 'unique' WHEN na > 0 THEN 'agrees' ELSE 'lowest' END AS how FROM y WHERE n = 1 OR (na > 0 AND edms_id = engine_id) OR (na = 0 AND engine_id = lo))"""


@query("epa_code_map", "WITH " + CODE_MAP + " SELECT code, airframe_code AS airframe_id, engine_id, edms_id, engine, anp_airplane_id, how FROM mp")
def _(t):
    return fleet.epa_code_map(t.codes, t.equipment, t.engine_names).select(
        "code", "airframe_id", "engine_id", "edms_id", "engine", "anp_airplane_id", "how"
    )


@query("coded_fleet", "WITH " + CODE_MAP + """,
l AS (SELECT facility_id, code, sum(lto) AS lto FROM {coded_ltos} GROUP BY 1, 2), s AS (SELECT *, lto / sum(lto) OVER (PARTITION BY facility_id) AS mix, sum(lto) OVER (PARTITION BY facility_id) * 2 AS annual FROM l)
SELECT lower(facility_id) AS facility_id, s.code, airframe_code AS airframe_id, engine_id, round(mix, 10) AS fleetmix, annual AS annual_operations FROM s LEFT JOIN mp ON mp.code = s.code WHERE s.code <= 999900""")
def _(t):
    out = fleet.coded_fleet(t.coded_ltos, fleet.epa_code_map(t.codes, t.equipment, t.engine_names))
    return rounded(out, 10, "fleetmix").select("facility_id", "code", "airframe_id", "engine_id", "fleetmix", "annual_operations")


PROFILE_SQL = """st AS (SELECT * FROM {profiles} WHERE op_type IN ('A', 'D') AND prof_id1 = 'STANDARD'),
us AS (SELECT * FROM st UNION ALL SELECT * FROM {profiles} WHERE op_type IN ('A', 'D') AND acft_id NOT IN (SELECT acft_id FROM st)),
pr AS (SELECT acft_id, op_type, prof_id1 AS profile, prof_id2 AS stage_len, weight FROM (SELECT *, rank() OVER (PARTITION BY acft_id, op_type ORDER BY prof_id2 DESC) AS r FROM us) WHERE r = 1)"""


@query("clean_profiles", "WITH " + PROFILE_SQL + """
SELECT * FROM pr UNION ALL SELECT helo_id, op_type, prof_id1, prof_id2, weight FROM (SELECT *, rank() OVER (PARTITION BY helo_id, op_type ORDER BY prof_id2 DESC) AS r FROM {heli_profiles} WHERE op_type IN ('A', 'D')) WHERE r = 1""")
def _(t):
    return performance.clean_profiles(t.profiles, t.heli_profiles)


@query("first_profiles", "WITH " + PROFILE_SQL + """
SELECT acft_id, op_type, prof_id1 AS profile, prof_id2 AS stage_len, weight FROM (SELECT *, row_number() OVER (PARTITION BY acft_id, op_type ORDER BY profile_id, prof_id2) AS r FROM us) WHERE r = 1""")
def _(t):
    return performance.first_profiles(t.profiles)


@query("equipment_dims", """
SELECT e.airframe_id, e.engine_id, engine_code, model AS arfm_mod, a.apu_id, apu_name FROM {equipment} e LEFT JOIN {engines} g USING (engine_id) LEFT JOIN {airframes} f USING (airframe_id)
LEFT JOIN (SELECT * FROM {apu} JOIN {apu_defaults} USING (apu_id)) a USING (airframe_id)""")
def _(t):
    dims = performance.equipment_dims(t.engines, t.airframes, t.apu, t.apu_defaults)
    return performance.with_equipment(t.equipment.select("airframe_id", "engine_id"), dims).drop("user_defined")


TRACK_SQL = """SELECT CAST(o_custkey % 2 AS INT) AS aircraft_type, CASE WHEN o_orderstatus = 'F' THEN 'A' ELSE 'D' END AS op_type, CAST(o_orderkey AS INT) AS track_id, CAST(o_custkey AS INT) AS rwy_end_id,
  o_orderpriority AS track_name, o_orderdate AS eff_date, o_orderdate + INTERVAL 300 DAY AS exp_date FROM {orders}"""


def _tracks(t):
    from skyledger.sources.readers import query_source
    return query_source(t.orders.sparkSession, TRACK_SQL.replace("VARCHAR", "STRING"), orders=t.orders)


@query("track_layout", "WITH tk AS (" + TRACK_SQL + """), v AS (SELECT * FROM tk WHERE eff_date < TIMESTAMP '1999-01-01' AND exp_date > TIMESTAMP '1999-01-01'),
f AS (SELECT aircraft_type, op_type, min(track_id) AS track_id FROM v GROUP BY 1, 2)
SELECT f.aircraft_type, f.op_type, f.track_id, v.track_name, c_name AS rwy_end_name, l_linenumber AS subtrack_num, l_partkey AS segment_id, l_quantity AS dist_or_rad
FROM f JOIN v USING (track_id) LEFT JOIN {customer} ON c_custkey = rwy_end_id LEFT JOIN {lineitem} ON l_orderkey = f.track_id""")
def _(t):
    ends = t.customer.select(F.col("c_custkey").cast("int").alias("rwy_end_id"), F.col("c_name").alias("rwy_end_name"))
    lines = t.lineitem.withColumn("sub", F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount")]))
    subs = lines.select(F.col("sub").alias("subtrack_id"), F.col("l_orderkey").cast("int").alias("track_id"), F.col("l_linenumber").alias("subtrack_num"))
    segs = lines.select(
        F.col("l_partkey").alias("segment_id"), F.col("sub").alias("subtrack_id"), F.lit(1).alias("segment_num"), F.lit("V").alias("segment_type"),
        F.col("l_quantity").alias("param_1"), F.lit(0.0).alias("param_2"),
    )
    layouts = t.nation.select(F.col("n_nationkey").alias("airport_id"), F.lit("1990-01-01").cast("timestamp").alias("eff_date"), F.lit("2030-01-01").cast("timestamp").alias("exp_date"))
    codes = t.nation.select(F.col("n_nationkey").alias("apt_id"), F.col("n_name").alias("apt_code"), F.lit("Y").alias("preferred"))
    out = performance.track_layout(_tracks(t), ends, subs, segs, layouts, codes, t.nation.select(F.col("n_nationkey").alias("apt_id")), "1999-01-01")["track"]
    return out.select("aircraft_type", "op_type", "track_id", "track_name", "rwy_end_name", "subtrack_num", "segment_id", "dist_or_rad")


@query("airport_layout", """
SELECT n_nationkey AS apt_id, 'layout ' || n_name AS layout_name, n_name AS apt_code, r_name AS main_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
WHERE n_nationkey = (SELECT max(n_nationkey) FROM {nation})""")
def _(t):
    """Only the layout of the last nation is valid on the day; the others begin or end before or after it."""
    key = F.col("n_nationkey")
    begin = F.when(key % 2 == 0, "1990-01-01").otherwise("2001-01-01")
    end = F.when(key % 2 == 0, "1998-01-01").otherwise("2030-01-01")
    last = key == t.nation.agg(F.max("n_nationkey")).scalar()
    layouts = t.nation.select(
        key.alias("airport_id"), F.concat(F.lit("layout "), "n_name").alias("layout_name"),
        F.when(last, "1990-01-01").otherwise(begin).cast("timestamp").alias("eff_date"), F.when(last, "2030-01-01").otherwise(end).cast("timestamp").alias("exp_date"))
    codes = t.nation.select(key.alias("apt_id"), F.col("n_name").alias("apt_code"), F.lit("Y").alias("preferred"))
    mains = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(key.alias("apt_id"), F.col("r_name").alias("main_name"))
    ends = t.customer.select(F.col("c_custkey").cast("int").alias("rwy_end_id"), F.col("c_name").alias("rwy_end_name"))
    subs = t.lineitem.select(F.col("l_partkey").alias("subtrack_id"), F.col("l_orderkey").cast("int").alias("track_id"), F.col("l_linenumber").alias("subtrack_num"))
    segs = t.part.select(F.col("p_partkey").alias("segment_id"), F.col("p_partkey").alias("subtrack_id"), F.lit(1).alias("segment_num"), F.lit("V").alias("segment_type"),
                         F.col("p_size").alias("param_1"), F.lit(0.0).alias("param_2"))
    out = performance.track_layout(_tracks(t), ends, subs, segs, layouts, codes, mains, "1999-01-01")["layout"]
    return out.select("apt_id", "layout_name", "apt_code", "main_name")


ATTACHED = "WITH " + PROFILE_SQL + ", " + COLLAPSED + """,
mk AS (SELECT *, coalesce(ap, he) AS anp_id, annual_operations * mix AS ops_fleet, coalesce(coalesce(ap, he) IN (SELECT acft_id FROM pr), false) AS has FROM fo),
ad AS (SELECT *, mix * coalesce(sum(CASE WHEN NOT has THEN ops_fleet END) OVER (PARTITION BY facility_id), 0) + ops_fleet AS adj FROM mk),
kp AS (SELECT *, adj / sum(adj) OVER (PARTITION BY facility_id) AS adj_mix FROM ad WHERE has),
da AS (SELECT kp.*, op_type, profile, stage_len FROM kp JOIN pr ON acft_id = anp_id),
lt AS (SELECT da.*, model AS arfm_mod, 'E' || CAST(engine_id AS VARCHAR) AS engine_code, CAST(round_even(round(adj / 2, 6), 0) AS DOUBLE) AS ltos FROM da JOIN {airframes} USING (airframe_id)),
sp AS (SELECT *, CAST(ceil(row_number() OVER (PARTITION BY facility_id ORDER BY ltos DESC, arfm_mod, engine_code, op_type) / 2) AS INT) AS ids FROM lt)"""


def _attached(t):
    own = fleet.facility_fleet(t.fleet_input)
    dims = performance.equipment_dims(t.engines, t.airframes, t.apu, t.apu_defaults)
    return performance.attach_profiles(
        performance.with_equipment(own, dims), performance.clean_profiles(t.profiles, t.heli_profiles), most_lost=1e12
    )


@query("attach_profiles", ATTACHED + """
SELECT facility_id, airframe_id, engine_id, op_type, stage_len, round(adj, 6) AS ops_fleet_adj, round(adj_mix + 1e-10, 8) AS fleetmix_adj FROM da""")
def _(t):
    out = _attached(t)["data"]
    out = out.withColumn("fleetmix_adj", F.round(F.col("fleetmix_adj") + 1e-10, 8))
    return rounded(out, 6, "ops_fleet_adj").select(
        "facility_id", "airframe_id", "engine_id", "op_type", "stage_len", "ops_fleet_adj", "fleetmix_adj"
    )


@query("dropped_profiles", ATTACHED + " SELECT facility_id, airframe_id, engine_id, anp_id, round(ops_fleet, 6) AS ops_fleet FROM mk WHERE NOT has")
def _(t):
    return rounded(_attached(t)["dropped"], 6, "ops_fleet").select("facility_id", "airframe_id", "engine_id", "anp_id", "ops_fleet")


def _split(t):
    """(ltos, a written table of the same facilities)"""
    made = _attached(t)
    data = made["data"].withColumn("ops_fleet_adj", F.round("ops_fleet_adj", 6))
    return performance.split_arr_dep(data, sketch_of=made["marked"]), made["marked"]


@query("split_arr_dep", ATTACHED.replace("round(adj / 2, 6)", "round(adj, 6) / 2") + " SELECT facility_id, airframe_id, engine_id, op_type, ltos, ids FROM sp")
def _(t):
    return _split(t)[0].select("facility_id", "airframe_id", "engine_id", "op_type", "ltos", "ids")


@query("scenario_nested", ATTACHED.replace("round(adj / 2, 6)", "round(adj, 6) / 2") + """,
k AS (SELECT *, CASE WHEN he IS NOT NULL THEN 1 ELSE 0 END AS aircraft_type FROM sp),
nb AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY facility_id, aircraft_type, op_type ORDER BY ids, airframe_id, engine_id) - 1) / 20) AS INT) AS block_no FROM k)
SELECT facility_id, aircraft_type, op_type, block_no, count(*) AS n, string_agg(op_type || CAST(ids AS VARCHAR), ',' ORDER BY ids, airframe_id, engine_id) AS ids, sum(ltos) AS ltos FROM nb GROUP BY 1, 2, 3, 4""")
def _(t):
    tracks = _tracks(t).groupBy("aircraft_type", "op_type").agg(F.min("track_id").alias("track_id"), F.min("track_name").alias("track_name")).withColumns({
        "rwy_end_name": F.lit("1"), "segment_type": F.lit("V"), "dist_or_rad": F.lit(1.0), "subtrack_num": F.lit(1), "segment_num": F.lit(1),
    })
    ops = "operations"
    ltos, marked = _split(t)
    return performance.scenario_nested(ltos, tracks, block=20, sketch_of=marked).select(
        "facility_id", "aircraft_type", "op_type", "block_no", F.size(ops).cast("bigint").alias("n"),
        F.array_join(F.transform(ops, lambda o: o["id"]), ",").alias("ids"),
        F.aggregate(F.transform(ops, lambda o: o["num_operations"]), F.lit(0.0), lambda a, b: a + b).alias("ltos"),
    )


@query("scenario_xml", ATTACHED.replace("round(adj / 2, 6)", "round(adj, 6) / 2") + """,
k AS (SELECT *, CASE WHEN he IS NOT NULL THEN 1 ELSE 0 END AS aircraft_type FROM sp),
nb AS (SELECT *, row_number() OVER (PARTITION BY facility_id, aircraft_type, op_type ORDER BY ids, airframe_id, engine_id) AS no FROM k)
SELECT facility_id, aircraft_type, op_type, CAST(floor((no - 1) / 20) AS INT) AS block_no, no, op_type || CAST(ids AS VARCHAR) AS id, arfm_mod AS airframe_model,
  engine_code, apu_name, CASE WHEN apu_name IS NOT NULL AND op_type = 'A' THEN 13.0 END AS arrival_apu_time,
  CASE WHEN apu_name IS NOT NULL AND op_type = 'D' THEN 13.0 END AS departure_apu_time, ltos AS num_operations, profile, stage_len
FROM nb LEFT JOIN (SELECT * FROM {apu} JOIN {apu_defaults} USING (apu_id)) a USING (airframe_id)""")
def _(t):
    """The nested rows as XML texts, read back to one row for each operation."""
    tracks = _tracks(t).groupBy("aircraft_type", "op_type").agg(F.min("track_id").alias("track_id"), F.min("track_name").alias("track_name")).withColumns({
        "rwy_end_name": F.lit("1"), "segment_type": F.lit("V"), "dist_or_rad": F.lit(1.0), "subtrack_num": F.lit(1), "segment_num": F.lit(1),
    })
    ltos, marked = _split(t)
    nested = performance.scenario_nested(ltos, tracks, block=20, sketch_of=marked)
    return performance.read_scenario_xml(performance.scenario_xml(nested)).drop("track_name")


@query("collect_nested", """
WITH n AS (SELECT *, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1) AS i FROM {lineitem})
SELECT l_orderkey, CAST(floor(i / 50) AS INT) AS block_no, string_agg(CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR), ',' ORDER BY i) AS lines, sum(l_quantity) AS qty FROM n GROUP BY 1, 2""")
def _(t):
    from skyledger.operators.ranking import numbered
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    rows = numbered(lines, ["l_orderkey"], [("l_linenumber", True), ("l_partkey", True), ("l_extendedprice", True)], "i")
    item = F.struct("i", F.concat_ws(":", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("v"))
    return rows.groupBy("l_orderkey", F.floor((F.col("i") - 1) / 50).cast("int").alias("block_no")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["v"]), ",").alias("lines"), F.sum("l_quantity").alias("qty")
    )


@query("stage_apu_lookup", """
SELECT f.facility_id, f.airframe_id, f.engine_id, f.aircraft_id, round(f.annual_operations * fleetmix, 6) AS ops_fleet, op_type, prof_id2, apu_name
FROM {fleet_input} f LEFT JOIN (SELECT * FROM {profiles} WHERE prof_id1 = 'STANDARD') p ON p.acft_id = anp_airplane_id LEFT JOIN (SELECT * FROM {apu} JOIN {apu_defaults} USING (apu_id)) a USING (airframe_id)
WHERE facility_group = 'Commercial'""")
def _(t):
    apu = performance.equipment_dims(t.engines, t.airframes, t.apu, t.apu_defaults)["apu"]
    out = performance.stage_apu_lookup(t.fleet_input.where("facility_group = 'Commercial'"), t.profiles, apu)
    return rounded(out, 6, "ops_fleet").select("facility_id", "airframe_id", "engine_id", "aircraft_id", "ops_fleet", "op_type", "prof_id2", "apu_name")


@query("quality_report", """
WITH mapped AS (SELECT year_id, facility_id, m.airframe_id, sum(total_ops) AS ops FROM {traffic} t JOIN {aircraft_map} m ON lower(t.aircraft_id) = m.aircraft_id
  WHERE m.airframe_id IS NOT NULL AND t.aircraft_type_id IS NOT NULL AND t.aircraft_type NOT LIKE '%unknown%' AND t.aircraft_type NOT LIKE '%#VALUE!%' GROUP BY ALL),
shares AS (SELECT year_id, facility_id, ops / sum(ops) OVER (PARTITION BY year_id, facility_id) AS share FROM mapped)
SELECT 'shares sum to one' AS check, count(*) = 0 AS passed, count(*) AS violations FROM (SELECT year_id, facility_id FROM shares GROUP BY 1, 2 HAVING abs(sum(share) - 1) > 1e-6) UNION ALL
SELECT 'facilities covered', count(*) = 0, count(*) FROM (SELECT facility_id FROM {facilities} EXCEPT SELECT facility_id FROM {base_traffic}) UNION ALL
SELECT 'no nulls', count(*) = 0, count(*) FROM {traffic} WHERE aircraft_id IS NULL OR aircraft_type_id IS NULL UNION ALL
SELECT 'unique lines', count(*) = 0, count(*) FROM (SELECT l_orderkey, l_linenumber FROM {lineitem} GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL
SELECT 'join keeps rows', count(*) = (SELECT count(*) FROM {orders}), abs(count(*) - (SELECT count(*) FROM {orders})) FROM {orders} LEFT JOIN {customer} ON o_custkey = c_custkey UNION ALL
SELECT 'positive', count(*) = 0, count(*) FROM {customer} WHERE NOT c_acctbal > 0 UNION ALL
SELECT 'seven years', count(*) = 0, count(*) FROM (SELECT facility_id FROM {forecast} GROUP BY 1 HAVING count(*) <> 7) UNION ALL
SELECT 'five segments', count(DISTINCT c_mktsegment) = 5, abs(count(DISTINCT c_mktsegment) - 5) FROM {customer} UNION ALL
SELECT 'totals agree', count(*) = 0, count(*) FROM (SELECT o_orderkey FROM {orders} LEFT JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY 1 HAVING coalesce(abs(max(o_totalprice) - sum(l_extendedprice)) > 1e-8 + 0.5 * sum(l_extendedprice), true)) UNION ALL
SELECT 'same keys', count(*) = 0, count(*) FROM ((SELECT c_nationkey FROM {customer} EXCEPT SELECT s_nationkey FROM {supplier}) UNION ALL (SELECT s_nationkey FROM {supplier} EXCEPT SELECT c_nationkey FROM {customer}))
UNION ALL SELECT 'no bad status', count(*) = 0, count(*) FROM {orders} WHERE o_orderstatus NOT IN ('F', 'O')""")
def _(t):
    shares, _ = fleet.fleet_mix(t.traffic, t.aircraft_map)
    named = joins.lookup(t.orders, t.customer, {"o_custkey": "c_custkey"}, ["c_name"])
    return quality.report(
        quality.sums_to_one(shares, ["year_id", "facility_id"], "fleetmix", "shares sum to one"),
        quality.covers(t.base_traffic, t.facilities, ["facility_id"], "facilities covered"),
        quality.not_null(t.traffic, ["aircraft_id", "aircraft_type_id"], "no nulls"),
        quality.unique(t.lineitem, ["l_orderkey", "l_linenumber"], "unique lines"),
        quality.same_row_count(t.orders, named, "join keeps rows"),
        quality.row_checks(t.customer, {"positive": F.col("c_acctbal") > 0}, {"five segments": ("c_mktsegment", 5)}),
        quality.group_size(t.forecast, ["facility_id"], 7, "seven years"),
        quality.totals_agree(
            t.orders.withColumnRenamed("o_orderkey", "k"), t.lineitem.withColumnRenamed("l_orderkey", "k"), ["k"],
            "o_totalprice", "l_extendedprice", "totals agree", rtol=0.5,
        ),
        quality.same_keys(
            t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k")), ["k"], "same keys"
        ),
        quality.empty(t.orders.where(~F.col("o_orderstatus").isin("F", "O")), "no bad status"),
    )
