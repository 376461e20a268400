"""Role tables: the domain's inputs, cut from the given tables.

facility = customer, district = region, aircraft = part brand, traffic row =
line item, forecast year = order year (base 1998), pollutant = return flag,
mode = line status.
"""

from workload.registry import role

role("facilities", """
SELECT 'f' || CAST(c_custkey AS STRING) AS facility_id, c_name AS facility_name,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'TASP' WHEN 'AUTOMOBILE' THEN 'Military'
    WHEN 'MACHINERY' THEN 'Farm/Ranch' WHEN 'HOUSEHOLD' THEN 'Other_PU_Airports'
    ELSE 'Commercial' END AS facility_group,
  CASE WHEN c_acctbal < 0 THEN 'HELIPORT' ELSE 'AIRPORT' END AS facility_type,
  n_name AS county, r_name AS district, c_acctbal + 1100 AS annual_operations
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
JOIN {region} ON n_regionkey = r_regionkey""")

role("traffic", """
SELECT 'f' || CAST(o_custkey AS STRING) AS facility_id, 'A' || CAST(o_custkey AS STRING) AS airport,
  'name ' || CAST(o_custkey AS STRING) AS facility_name,
  CAST(year(o_orderdate) AS INT) AS year_id,
  CASE WHEN month(o_orderdate) IN (6, 7, 8) THEN 'Summer' ELSE 'Other' END AS season,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Air Carrier' WHEN '2-HIGH' THEN 'Freight'
    WHEN '3-MEDIUM' THEN 'General Aviation' WHEN '4-NOT SPECIFIED' THEN 'Military'
    ELSE 'Air Taxi' END AS user_class,
  CASE p_type WHEN 'ECONOMY' THEN 'Jet' WHEN 'SMALL' THEN 'Turbine' WHEN 'MEDIUM' THEN 'Piston'
    ELSE '-' END AS physical_class,
  CASE WHEN p_size > 40 THEN 'Large Jet Eqpt' ELSE 'Small' END AS weight_class,
  CASE WHEN p_size = 47 THEN NULL ELSE p_brand END AS aircraft_id,
  CASE WHEN p_size = 50 THEN 'x - unknown' WHEN p_size = 49 THEN '#VALUE!' WHEN p_size = 46 THEN 'Bell 4'
    ELSE p_name END AS aircraft_type,
  CASE WHEN p_size = 48 THEN NULL ELSE p_type END AS aircraft_type_id, l_quantity AS total_ops
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey""")

role("base_traffic", "SELECT * FROM {traffic} WHERE year_id = 1998")

role("brands", """
SELECT p_brand AS brand, CAST(min(p_partkey) AS INT) AS airframe_id, min(p_name) AS model_name,
  min(p_type) AS kind, CAST(substr(p_brand, 7) AS INT) AS brand_no
FROM {part} GROUP BY p_brand""", settled=True)

role("aircraft_map", """
SELECT lower(brand) AS aircraft_id, model_name AS aircraft_type, kind AS aircraft_type_id,
  CASE WHEN brand_no <= 22 THEN airframe_id END AS airframe_id, 'frame ' || brand AS airframe_type
FROM {brands}""")

role("equipment", """
SELECT airframe_id, p_size AS engine_id,
  min(CASE WHEN p_size >= 3 THEN p_size * 10 END) AS engine_mod_id,
  min(CASE WHEN p_size >= 2 AND brand_no > 4 THEN p_type END) AS anp_airplane_id,
  min(CASE WHEN brand_no <= 4 THEN p_type END) AS anp_helicopter_id,
  min(CASE WHEN p_retailprice > 950 THEN p_name END) AS bada_id,
  CAST(NULL AS STRING) AS bada4_id
FROM {part} JOIN {brands} ON p_brand = brand GROUP BY airframe_id, p_size""", settled=True)

role("engines", "SELECT DISTINCT p_size AS engine_id, 'E' || CAST(p_size AS STRING) AS engine_code FROM {part}", settled=True)
role("airframes", """
SELECT airframe_id, 'frame ' || brand AS model FROM {brands} UNION ALL SELECT 4891, 'CH-47' UNION ALL
SELECT 4935, 'UH-60' UNION ALL SELECT 5245, 'AH-64'""", settled=True)

role("forecast", """
SELECT 'f' || CAST(o_custkey AS STRING) AS facility_id, CAST(year(o_orderdate) AS INT) AS sysyear,
  CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS INT) AS itn_ac,
  CAST(sum(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) AS INT) AS itn_at,
  CAST(sum(CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END) AS INT) AS itn_ga,
  CAST(sum(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS INT) AS loc_ga,
  CAST(sum(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 1 ELSE 0 END) AS INT) AS itn_mil,
  0 AS loc_mil, CAST(count(*) AS INT) AS t_aops
FROM {orders} GROUP BY o_custkey, year(o_orderdate)""")

role("registry", """
SELECT 'f' || CAST(c_custkey AS STRING) AS facility_id,
  CASE WHEN c_mktsegment = 'FURNITURE' AND c_acctbal > 7000 THEN c_name || ' Ranch'
    WHEN c_mktsegment = 'HOUSEHOLD' AND c_acctbal > 8000 THEN c_name || ' farm' ELSE c_name END AS facility_name,
  n_name AS city, n_name AS county,
  CASE WHEN c_acctbal < 500 THEN 'HELIPORT' ELSE 'AIRPORT' END AS facility_type,
  CASE WHEN c_acctbal > 9700 THEN 'C' ELSE 'O' END AS airport_status_code,
  CASE WHEN c_mktsegment = 'MACHINERY' AND c_acctbal < 0 THEN 'MA' ELSE 'PU' END AS ownership,
  CASE WHEN c_acctbal < 5000 THEN 'PU' ELSE 'PR' END AS used,
  CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal < 1000 THEN 'Y' ELSE 'N' END AS medical_use,
  CASE WHEN c_mktsegment = 'AUTOMOBILE' AND c_acctbal > 9000 THEN 'AGRI' ELSE 'CARGO,INSTR' END AS other_services,
  c_acctbal + 1000 AS operations_commercial, c_acctbal + 2000 AS operations_commuter,
  CASE WHEN c_acctbal < 2500 THEN NULL ELSE c_acctbal END AS operations_air_taxi,
  CAST(10.0 AS DOUBLE) AS operations_ga_local, CAST(20.0 AS DOUBLE) AS operations_ga_itin,
  CAST(5.0 AS DOUBLE) AS operations_military
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""")

role("planning", """
SELECT 'f' || CAST(c_custkey AS STRING) AS facility_id,
  CASE WHEN c_acctbal > 6000 THEN 'TASP' ELSE 'NONE' END AS tx_dot
FROM {customer} WHERE c_mktsegment <> 'BUILDING'""")

role("taxi", """
SELECT 'f' || CAST(user_id AS STRING) AS facility_id, CAST(year(ts) - 26 AS INT) AS year,
  CASE WHEN day(ts) <= 15 THEN 'Summer' ELSE 'Other' END AS season,
  CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS departures_metrics,
  CASE WHEN event_type = 'signup' THEN 0 ELSE 1 END AS arrivals_metrics,
  value AS avg_taxi_out_time, value * 2 AS avg_taxi_in_time
FROM {events}""")

role("reported", """
SELECT 'f' || CAST(o_custkey AS STRING) AS facility_id, o_totalprice AS annual_operations,
  CAST(year(o_orderdate) AS INT) AS operations_year
FROM {orders} WHERE o_orderstatus = 'P'""")

role("own_ops", """
SELECT 'f' || CAST(o_custkey AS STRING) AS facility_id,
  sum(CASE WHEN year(o_orderdate) = 1998 THEN o_totalprice END) AS ops_1998,
  sum(CASE WHEN year(o_orderdate) = 1999 THEN o_totalprice END) AS ops_1999
FROM {orders} WHERE o_orderstatus = 'F' GROUP BY o_custkey""")

role("inventory", """
SELECT 'f' || CAST(c_custkey AS STRING) AS facility_id, c_name AS airport, c_mktsegment AS facility_group,
  CASE WHEN c_acctbal < 0 THEN 'HELIPORT' ELSE 'AIRPORT' END AS facility_type,
  lower(n_name) AS county, n_nationkey + 48000 AS fip, r_name AS district,
  CAST(year(o_orderdate) AS INT) AS year,
  CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3
    WHEN '4-NOT SPECIFIED' THEN 4 ELSE 5 END AS scc,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Commercial' WHEN '2-HIGH' THEN 'General Aviation, Piston'
    WHEN '3-MEDIUM' THEN 'Air Taxi, Turbine' WHEN '4-NOT SPECIFIED' THEN 'Military'
    ELSE 'Electric' END AS scc_description,
  CASE l_returnflag WHEN 'A' THEN 'CO' WHEN 'N' THEN 'NOX' ELSE 'PM10' END AS eis_pollutant_id,
  CASE WHEN l_linestatus = 'F' THEN 'Aircraft' WHEN l_tax < 0.04 THEN 'GSE LTO' ELSE 'APU' END AS mode,
  p_brand AS airframe, l_quantity AS ltos, l_quantity AS lto,
  l_extendedprice AS uncontrolled_annual_emis_st,
  l_extendedprice * (1 - l_discount) AS controlled_annual_emis_st
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
JOIN {part} ON l_partkey = p_partkey""")

role("modes", """
SELECT 'Climb Below Mixing Height' AS mode, 1 AS mode_no UNION ALL
SELECT 'Descend Below Mixing Height', 2 UNION ALL SELECT 'GSE LTO', 3 UNION ALL
SELECT 'Taxi Out', 4 UNION ALL SELECT 'Cruise', 5""")

# One rate row per part and mode; several parts of a brand and size name the same equipment.
role("rates", """
SELECT p_partkey AS event_no, 'D' || CAST(p_size % 3 AS STRING) AS departure_airport, mode, mode_no, brand_no,
  CASE WHEN brand_no <= 4 THEN p_type ELSE 'frame ' || brand END || '/E' || CAST(p_size AS STRING) AS equipment_type,
  CAST(p_size AS DOUBLE) AS num_ops, p_retailprice * mode_no AS co_st, p_retailprice / mode_no AS nox_st,
  p_size * CAST(1.5 AS DOUBLE) AS voc_st
FROM {part} JOIN {brands} ON p_brand = brand JOIN {modes} ON mode_no > 0""")

role("classes", """
SELECT 'tasp_arpt' AS fac_class, 0 AS heli UNION ALL SELECT 'mil_arpt', 0 UNION ALL SELECT 'fandr_arpt', 0 UNION ALL
SELECT 'opua_arpt', 0 UNION ALL SELECT 'tasp_heli', 1 UNION ALL SELECT 'fandr_heli', 1 UNION ALL SELECT 'mil_heli', 1""")

role("class_rates", """
SELECT fac_class, departure_airport, mode, mode_no, event_no, num_ops, equipment_type, co_st, nox_st, voc_st
FROM {rates} JOIN {classes} ON heli = 0 WHERE brand_no > 4 UNION ALL
SELECT fac_class, departure_airport, mode, mode_no, min(event_no), min(num_ops), name, min(co_st), min(nox_st), min(voc_st)
FROM (SELECT fac_class, departure_airport, mode, mode_no, event_no, num_ops, co_st, nox_st, voc_st,
  CASE WHEN fac_class <> 'mil_heli' THEN equipment_type WHEN equipment_type LIKE 'ECONOMY%' THEN replace(equipment_type, 'ECONOMY', 'CH47D')
    WHEN equipment_type LIKE 'SMALL%' THEN replace(equipment_type, 'SMALL', 'S70')
    ELSE replace(replace(replace(replace(equipment_type, 'PROMO', 'B212'), 'MEDIUM', 'B212'), 'LARGE', 'B212'), 'STANDARD', 'B212') END AS name
  FROM {rates} JOIN {classes} ON heli = 1 WHERE brand_no <= 4) x
GROUP BY fac_class, departure_airport, mode, mode_no, name""")

role("points", """
SELECT 'f' || CAST(c_custkey AS STRING) AS facility_id, c_name AS facility_name,
  CAST(c_custkey * 7919 % 36000 AS DOUBLE) / 100 - 180 AS lon, CAST(c_custkey * 104729 % 17000 AS DOUBLE) / 100 - 85 AS lat,
  n_name AS county, c_nationkey AS nationkey
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""")

role("sites", """
SELECT 'g' || CAST(s_suppkey AS STRING) AS match_id,
  CAST(s_suppkey * 6101 % 36000 AS DOUBLE) / 100 - 180 AS lon, CAST(s_suppkey * 15013 % 17000 AS DOUBLE) / 100 - 85 AS lat
FROM {supplier}""")

# Rings of each nation, vertices numbered in order: a triangle or quadrilateral, a hole in it for every
# second nation (numbered from 5 in steps of 2) and an island for every third.
role("corners", """
SELECT n_nationkey AS poly_id, 1 AS ring, 1 AS seq, n_nationkey * 14.0 - 180.0 AS x, -60.0 AS y FROM {nation} UNION ALL
SELECT n_nationkey, 1, 2, n_nationkey * 14.0 - 168.0, -50.0 + n_nationkey FROM {nation} UNION ALL
SELECT n_nationkey, 1, 3, n_nationkey * 14.0 - 174.0, 40.0 + n_nationkey FROM {nation} UNION ALL
SELECT n_nationkey, 1, 4, n_nationkey * 14.0 - 181.0, 10.0 FROM {nation} WHERE n_regionkey > 1 UNION ALL
SELECT n_nationkey, 2, 5, n_nationkey * 14.0 - 175.0, -25.0 FROM {nation} WHERE n_nationkey % 2 = 0 UNION ALL
SELECT n_nationkey, 2, 7, n_nationkey * 14.0 - 171.5, -22.0 FROM {nation} WHERE n_nationkey % 2 = 0 UNION ALL
SELECT n_nationkey, 2, 9, n_nationkey * 14.0 - 174.0, 5.0 FROM {nation} WHERE n_nationkey % 2 = 0 UNION ALL
SELECT n_nationkey, 3, 1, n_nationkey * 14.0 - 180.0, 68.0 FROM {nation} WHERE n_nationkey % 3 = 0 UNION ALL
SELECT n_nationkey, 3, 2, n_nationkey * 14.0 - 170.0, 70.0 FROM {nation} WHERE n_nationkey % 3 = 0 UNION ALL
SELECT n_nationkey, 3, 3, n_nationkey * 14.0 - 171.0, 84.0 FROM {nation} WHERE n_nationkey % 3 = 0""")

role("rings", """
SELECT CAST(poly_id AS INT) AS poly_id, ring, seq, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM {corners}""")

# Fleet of a facility: shares of each part type, brand and size in its quantity.
role("fleet_counts", """
SELECT 'f' || CAST(o_custkey AS STRING) AS facility_id, airframe_id, p_size AS engine_id, p_type AS aircraft_id,
  sum(l_quantity) AS qty, sum(sum(l_quantity)) OVER (PARTITION BY o_custkey) AS annual_operations
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey
JOIN {brands} ON p_brand = brand GROUP BY o_custkey, airframe_id, p_size, p_type""")

role("fleet_input", """
SELECT c.facility_id, facility_name, facility_group, facility_type, c.airframe_id, c.engine_id, aircraft_id,
  qty / c.annual_operations AS fleetmix, c.annual_operations, anp_airplane_id, anp_helicopter_id
FROM {fleet_counts} c JOIN {equipment} e ON c.airframe_id = e.airframe_id AND c.engine_id = e.engine_id
JOIN {facilities} f ON c.facility_id = f.facility_id""")

role("profiles", """
SELECT p_type AS acft_id, CASE WHEN l_linestatus = 'F' THEN 'A' ELSE 'D' END AS op_type,
  CASE WHEN p_size <= 30 AND p_type <> 'PROMO' THEN 'STANDARD' ELSE 'NOISEMAP' END AS prof_id1,
  CASE WHEN p_size % 9 = 8 THEN 'M' ELSE CAST(p_size % 9 + 1 AS STRING) END AS prof_id2,
  max(p_retailprice) AS weight, min(p_partkey) AS profile_id
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey WHERE p_type <> 'LARGE' GROUP BY 1, 2, 3, 4""", settled=True)

role("heli_profiles", """
SELECT 'H' || p_brand AS helo_id, CASE WHEN p_size < 25 THEN 'A' WHEN p_size < 48 THEN 'D' ELSE 'X' END AS op_type,
  'STANDARD' AS prof_id1, CAST(p_size % 9 AS STRING) AS prof_id2, p_retailprice AS weight
FROM {part} JOIN {brands} ON p_brand = brand WHERE brand_no <= 4""")

role("apu", "SELECT airframe_id, brand_no % 5 AS apu_id, 0 AS user_defined FROM {brands} WHERE brand_no > 6", settled=True)
role("apu_defaults", "SELECT DISTINCT n_regionkey AS apu_id, 'APU ' || CAST(n_regionkey AS STRING) AS apu_name FROM {nation}", settled=True)

# Rate tables of facilities with their own model runs.
role("own_units", """
SELECT c.facility_id, airframe_id, engine_id, 'frame ' || brand AS arfm_mod, 'E' || CAST(engine_id AS STRING) AS engine_code,
  CAST(airframe_id * 100 + engine_id AS INT) AS ids, sum(qty) AS qty
FROM {fleet_counts} c JOIN {brands} b USING (airframe_id) GROUP BY c.facility_id, airframe_id, engine_id, brand""", settled=True)

role("own_scenario", """
SELECT facility_id, op_type, ids, airframe_id, arfm_mod, 'x' AS aircraft_id, engine_id, engine_code
FROM {own_units} JOIN (SELECT 'A' AS op_type UNION ALL SELECT 'D') m ON ids >= 0""")

role("own_rates", """
SELECT facility_id, CASE WHEN mode_no = 2 THEN 'A' ELSE 'D' END || CAST(ids AS STRING) AS user_id,
  arfm_mod || '/' || engine_code AS equipment_type, mode, mode_no, CAST(floor(qty / 2) AS DOUBLE) AS num_ops,
  qty * mode_no AS co_st, qty / mode_no AS nox_st, ids * CAST(1.5 AS DOUBLE) AS voc_st
FROM {own_units} JOIN {modes} ON mode_no > 0""")

role("coded_ltos", """
SELECT o_orderpriority AS facility_id, 'P ' || o_orderstatus AS airport, l_returnflag AS process,
  CASE WHEN l_tax > 0.07 THEN 999901 + l_linenumber ELSE CAST(l_partkey % 400 AS INT) END AS code,
  CAST(l_linenumber AS INT) AS scc, l_quantity AS lto
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""")

role("codes", """
SELECT DISTINCT CAST(p_partkey % 400 AS INT) AS code, airframe_id AS airframe_code, p_size AS edms_id,
  'M' || CAST(p_size % 7 AS STRING) AS engine, CAST(p_size % 7 + 1 AS INT) AS scc, p_type AS faa_type,
  'scc ' || CAST(p_size % 7 + 1 AS STRING) AS scc_description
FROM {part} JOIN {brands} ON p_brand = brand WHERE p_size >= 3""")

role("engine_names", "SELECT DISTINCT p_size AS engine_id, 'M' || CAST(p_size % 7 AS STRING) AS engine FROM {part}")
