"""Steps whose cost grew faster than their input, on rows of their own."""

from pyspark.sql import functions as F

from skyledger.operators import geo, joins, ranking, skew
from skyledger.plans import compare, emissions, performance


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_cold_keys_are_numbered_without_slices(spark):
    df = spark.range(3000).select((F.col("id") % 1000).alias("k"), (F.col("id") * 7919 % 3000).alias("v"))
    out = ranking.numbered(df, ["k"], [("v", False)], "n")
    assert "_slice" not in plan_of(out)
    want = {}
    for r in df.collect():
        want.setdefault(r.k, []).append(r.v)
    assert {(r.k, r.v): r.n for r in out.collect()} == {
        (k, v): i + 1 for k, vs in want.items() for i, v in enumerate(sorted(vs, reverse=True))}


def test_hot_and_cold_and_null_keys_are_numbered_alike(spark):
    key = F.when(F.col("id") < 900, F.lit(1)).when(F.col("id") < 905, F.lit(None)).otherwise(F.col("id"))
    df = spark.range(2000).select(key.alias("k"), "id")
    out = ranking.numbered(df, ["k"], [("id", True)], "n")
    assert "_slice" in plan_of(out)
    got = {(r.k, r.id): r.n for r in out.collect()}
    assert got == {(1 if i < 900 else None if i < 905 else i, i): i + 1 if i < 900 else i - 899 if i < 905 else 1 for i in range(2000)}


def test_a_sketch_without_hot_keys_gives_plain_joins(spark):
    df = spark.range(2000).select((F.col("id") % 1000).alias("k"), "id")
    out = skew.attach_totals(df, ["k"], sketch_of=df, n=F.count("id"))
    assert "_piece" not in plan_of(out) and {r.n for r in out.collect()} == {2}
    hot = df.withColumn("k", F.when(F.col("id") < 500, 0).otherwise(F.col("k")))
    out = skew.attach_totals(hot, ["k"], sketch_of=hot, n=F.count("id"))
    assert "_piece" in plan_of(out)
    assert {(r.id, r.n) for r in out.collect()} == {(r.id, r.n) for r in skew.attach_totals(hot, ["k"], n=F.count("id")).collect()}


def operations(spark):
    rows = [(f"f{i}", f"n{i % 3}" if j else None, 10.0 + j, 0.5, i % 7 + j, j, 100.0, f"m{j}", f"E{j}", "apu" if j % 2 else None, None)
            for i in range(600) for j in range(1, 5)]
    return spark.createDataFrame(rows, "facility_id string, anp_id string, ops_fleet double, fleetmix double, airframe_id int, engine_id int, "
                                 "annual_operations double, arfm_mod string, engine_code string, apu_name string, anp_helicopter_id string")


def test_operations_without_a_hot_facility_are_not_written_again(spark):
    """Totals, pairs and blocks of a facility follow from one layout by the facility."""
    profiles = spark.createDataFrame([(f"n{i}", op, "STANDARD", "1") for i in range(2) for op in "AD"], "acft_id string, op_type string, profile string, stage_len string")
    made = performance.attach_profiles(operations(spark), profiles, 1e12)
    ltos = performance.split_arr_dep(made["data"], sketch_of=made["marked"])
    tracks = spark.createDataFrame([(0, op, 1, "t", "1", "V", 1.0, 1, 1) for op in "AD"], "aircraft_type int, op_type string, track_id int, track_name string, "
                                   "rwy_end_name string, segment_type string, dist_or_rad double, subtrack_num int, segment_num int")
    nested = performance.scenario_nested(ltos, tracks, block=3, sketch_of=made["marked"])
    assert "_slice" not in plan_of(nested)
    plain = performance.split_arr_dep(made["data"])
    key = lambda r: (r.facility_id, r.op_type, r.airframe_id, r.engine_id, r.ltos, r.ids)
    assert sorted(map(key, ltos.collect())) == sorted(map(key, plain.collect()))
    other = performance.scenario_nested(plain, tracks, block=3)
    key = lambda r: (r.facility_id, r.op_type, r.block_no, r.operations)
    assert sorted(map(key, nested.collect())) == sorted(map(key, other.collect()))


def test_farms_share_one_list(spark):
    """Shares and rates of the farms' list are settled before facilities and list are multiplied."""
    facts = "facility_id string, facility_name string, facility_group string, facility_type string, annual_operations double, fac_class string"
    classed = spark.createDataFrame([(f"f{i}", "n", "g", "AIRPORT", 100.0, "fandr_arpt" if i < 300 else "mil_arpt") for i in range(1200)]
                                    + [("f0", "n", "g", "AIRPORT", 100.0, "mil_arpt")], facts)
    own = spark.createDataFrame([(f"f{i}", 1, 1, "a", 0.25, None, None) for i in (0, *range(300, 1200))],
                                "facility_id string, airframe_id int, engine_id int, aircraft_id string, fleetmix double, anp_airplane_id string, anp_helicopter_id string")
    rates = spark.createDataFrame([(c, "D", m, 1, f"Jet{j}/E1", 1.0, 2.0) for c in ("fandr_arpt", "mil_arpt") for m in emissions.FLIGHT_MODES for j in range(4)],
                                  "fac_class string, departure_airport string, mode string, event_no int, equipment_type string, num_ops double, co_st double")
    engines = spark.createDataFrame([(1, "E1")], "engine_id int, engine_code string")
    frames = spark.createDataFrame([(j, f"Jet{j}") for j in range(4)], "airframe_id int, model string")
    units, tons = emissions.noncommercial_inventory(classed, own, rates, engines, frames, [F.col("event_no")])
    assert "_piece" not in plan_of(units.where(F.col("source") == "donor"))
    shares = {r.facility_id: (r.n, round(r.s, 9), round(r.ops, 6)) for r in units.groupBy("facility_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("fleetmix").alias("s"), F.sum("ops").alias("ops")).collect()}
    assert shares == {f"f{i}": (5 if i == 0 else 4 if i < 300 else 1, 1.0, 100.0) for i in range(1200)}
    assert tons.count() == 2 * units.count() and tons.where("co_st IS NULL").count() == 0
    cover = emissions.noncommercial_coverage(classed, units, tons)
    assert {(r.covered_by, r.units_without_rates) for r in cover.collect()} == {("fleet", 0)}


def test_commercial_scaling_in_windows_equals_joins(spark):
    rows = [("f1", "A/1", emissions.FLIGHT_MODES[0], 1, "u1", 4.0, 90.0), ("f1", "A/1", emissions.FLIGHT_MODES[1], 2, "u2", 7.0, 90.0),
            ("f1", "B/1", emissions.FLIGHT_MODES[0], 1, "u3", 6.0, 90.0), ("f1", "C/1", "APU", 3, "u4", 9.0, 90.0), ("f1", "A/1", "APU", 0, "u0", 1.0, 90.0),
            ("f2", "A/1", emissions.FLIGHT_MODES[1], 2, "u1", 0.0, 50.0), (None, "A/1", emissions.FLIGHT_MODES[0], 1, "u1", 3.0, 10.0),
            ("f3", None, emissions.FLIGHT_MODES[0], 1, "u1", 5.0, 20.0), ("f3", "A/1", emissions.FLIGHT_MODES[0], 1, "u2", 5.0, None)]
    df = spark.createDataFrame(rows, "facility_id string, equipment_type string, mode string, mode_no int, user_id string, ltos double, annual_operations double")
    order = [F.col("mode_no"), F.col("user_id")]
    for a, b in zip(emissions.scaled_by_windows(df, order), emissions.scaled_by_joins(df, order)):
        assert set(a.columns) == set(b.columns)
        assert sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))


def test_nearest_points_of_crowded_places(spark):
    """Only the nearest points of a leaf are rows, also where a leaf has many pages."""
    crowd = spark.range(400).select(F.concat(F.lit("r"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("r"), (F.lit(10.0) + F.col("id") * 1e-7).alias("lat"), F.lit(20.0).alias("lon"))
    left = spark.createDataFrame([("x", 10.0, 20.0), ("y", -60.0, 100.0)], "l string, lat double, lon double")
    out = geo.k_nearest(left, crowd, "l", "r", 3)
    got = {}
    for r in out.collect():
        got.setdefault(r.l, {})[r["rank"]] = r.r
    assert got["x"] == {1: "r000", 2: "r001", 3: "r002"} and set(got["y"]) == {1, 2, 3}
    assert "slice(array_sort(" in plan_of(out)


def test_many_matches_of_a_name_are_single_ids_in_the_last_step(spark):
    a = spark.range(300).select("id", F.lit("same").alias("name"), F.col("id").cast("double").alias("v"), F.lit(1).alias("g"))
    b = spark.range(1000, 1040).select("id", F.when(F.col("id") < 1030, "same").otherwise("other").alias("name"), F.col("id").cast("double").alias("v"), F.lit(1).alias("g"))
    out = joins.cascade_match(a.unionByName(a.limit(1).withColumns({"id": F.lit(5000).cast("long"), "name": F.lit("none")})), b, "id", "name", "v", "g")
    assert {(r.method, r["count"]) for r in out.groupBy("method").count().collect()} == {("name", 9000), ("nearest", 1)}
    plan = plan_of(out)
    assert "LeftAnti" in plan and "Aggregate [id" in plan.split("LeftAnti", 1)[1]


def test_both_ratios_come_from_one_pass(spark):
    rows = spark.createDataFrame([("f", "A/1", m, i, f"u{i}", 4.0 + i, 2.0) for i, m in enumerate(emissions.MODES)] + [("f", "B/1", "APU", 1, "u9", 0.0, 1.0)],
                                 "facility_id string, equipment_type string, mode string, mode_no int, user_id string, ltos double, co_st double")
    factor = spark.createDataFrame([("f", 2.0)], "facility_id string, proj_fac double")
    order = [F.col("mode_no"), F.col("user_id")]
    out = compare.own_intensity(rows, order, {"CO": "co_st"}, factor, False, ["equipment_type"], "scaled")
    got = {(r["mode"], r.equipment_type): (r.lto, r.emis_tons, r.emis_per_lto, r.scaled) for r in out.collect()}
    assert got == {("Aircraft", "A/1"): (8.0, 36.0, 4.5, 9.0), ("GSE LTO", "A/1"): (12.0, 24.0, 2.0, 4.0), ("APU", "A/1"): (14.0, 28.0, 2.0, 4.0),
                   ("APU", "B/1"): (0.0, 0.0, None, None)}
    assert "Window" not in plan_of(out)
