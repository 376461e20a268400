"""Operators on small hand-made tables, with the traps of the source data."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skyledger.functions import names, numbers, rules, text
from skyledger.operators import donors, geo, joins, measures, ranking, reshape, skew
from skyledger.plans import emissions, facility, fleet, operations, performance, projection


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_snake_case_names():
    assert names.snake_case("CO (ST)") == "co_st_"
    assert names.snake_case("NOx (ST)") == "n_ox_st_"
    assert names.snake_case("FacilityID") == "facility_id"
    assert names.snake_case("PM 2.5 (ST)") == "pm_2_5_st_"
    assert names.snake_case("Aircraft-Type") == "aircraft_type"


def test_text_expressions(spark):
    df = spark.createDataFrame([(" 'AbC ", "a/b/c", "29-10-30.0000N", "95-30-00.0W", "o'brien mc-lennan", "2E5")],
                               "k string, p string, lat string, lon string, n string, s string")
    head, tail = text.right_split("p")
    row = df.select(
        text.clean_key("k"), head, tail, text.degrees("lat"), text.degrees("lon"), text.title("n"),
        text.repair_ids(F.lower("s")),
    ).first()
    assert row[0] == "abc" and row[1] == "a/b" and row[2] == "c"
    assert abs(row[3] - (29 + 10 / 60 + 30 / 3600)) < 1e-12 and row[4] == -95.5
    assert row[5] == "O'Brien Mc-Lennan" and row[6] == "200000"


def test_numbers(spark):
    row = spark.range(1).select(
        numbers.to_number(F.lit("-")), numbers.to_number(F.lit("x")), numbers.half_even(F.lit(2.5)),
        numbers.half_even(F.lit(3.5)), numbers.ratio(F.lit(1), F.lit(0)), numbers.sum_of(F.lit(None), F.lit(2)),
        numbers.close_to(F.lit(None), F.lit(1.0)),
    ).first()
    assert list(row) == [0.0, None, 2.0, 4.0, None, 2.0, False]


def test_last_rule_wins_and_null_tests(spark):
    df = spark.createDataFrame([(5,), (15,), (None,)], "v int")
    label = rules.last_rule([(F.col("v") > 0, "a"), (F.col("v") > 10, "b")], "none")
    assert [r[0] for r in df.select(label).collect()] == ["a", "b", "none"]
    assert df.where(rules.not_in("v", [5])).count() == 2


def skewed(spark, n=4000):
    rng = random.Random(1)
    rows = [(1 if i % 3 == 0 else rng.randrange(2, 200), rng.choice([0.0, 0.0, 1.5, 2.5, float(i % 7)]), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k int, v double, i int")


def test_split_join_equals_plain_join(spark):
    _, df = skewed(spark)
    dim = spark.createDataFrame([(k, f"d{k}") for k in range(1, 150)], "k int, d string")
    for how in ("left", "inner", "left_semi", "left_anti"):
        a, b = skew.split_join(df, dim, ["k"], how), df.join(dim, "k", how)
        assert a.columns == b.columns
        assert pairs(a.fillna("~"), *a.columns) == pairs(b.fillna("~"), *b.columns)


def test_hot_key_is_found(spark):
    _, df = skewed(spark)
    hot = skew.hot_key_hashes(df, ["k"]).first()[0]
    assert df.where("k = 1").select(F.xxhash64("k")).first()[0] in hot


def test_row_numbers_with_ties_and_nulls(spark):
    rows, df = skewed(spark)
    df = df.withColumn("v", F.when(F.col("i") % 11 == 0, None).otherwise(F.col("v")))
    out = {(r.k, r.i): r.n for r in ranking.numbered(df, ["k"], [("v", False), ("i", True)], "n").collect()}
    groups = {}
    for k, v, i in rows:
        groups.setdefault(k, []).append((None if i % 11 == 0 else v, i))
    for k, vs in groups.items():
        vs.sort(key=lambda t: (t[0] is None, -(t[0] or 0), t[1]))
        for n, (_, i) in enumerate(vs, 1):
            assert out[(k, i)] == n
    text_order = ranking.numbered(df.withColumn("s", F.concat(F.lit("x"), F.col("v").cast("string"))), [], [("s", True), ("i", True)], "n")
    assert sorted(r.n for r in text_order.collect()) == list(range(1, len(rows) + 1))


def test_row_numbers_beyond_double_precision(spark):
    df = spark.range(4000).select((F.lit(2**53) + F.col("id") % 2).alias("v"), F.pmod(F.xxhash64("id"), F.lit(10**9)).alias("w"), "id")
    out = {r.id: r.n for r in ranking.numbered(df, [], [("v", True), ("w", True), ("id", True)], "n").collect()}
    rows = sorted(df.collect(), key=lambda r: (r.v, r.w, r.id))
    assert all(out[r.id] == n for n, r in enumerate(rows, 1))


def test_strings_of_one_prefix_have_many_slices(spark):
    df = spark.range(20_000).select(F.concat(F.lit("frame Brand#"), "id").alias("s"))
    sliced = ranking.with_slices(df, [("s", True)])
    assert sliced.groupBy("_slice").count().agg(F.max("count")).first()[0] < 2000
    out = {r.s: r.n for r in ranking.numbered(df, [], [("s", False)], "n").collect()}
    assert all(out[s] == n for n, s in enumerate(sorted(out, reverse=True), 1))


def test_hot_key_of_a_narrow_range_has_many_slices(spark):
    """Most rows are of one key whose values lie between those of two other rows."""
    hot = spark.range(30_000).select(F.lit("hot").alias("k"), (F.lit(500.0) + F.col("id") / 1e6).alias("v"), "id")
    rest = spark.range(3000).select(F.when(F.col("id") % 50 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"), F.col("id").cast("double").alias("v"), F.col("id") + 10**6)
    df = hot.unionAll(rest)
    order = [("k", True), ("v", False), ("id", True)]
    sizes = [r["count"] for r in ranking.with_slices(df, order).groupBy("_slice").count().collect()]
    assert len(sizes) > 50 and max(sizes) < 4 * 33_000 / 64
    out = {r.id: r.n for r in ranking.numbered(df, ["k"], order[1:], "n").collect()}
    groups = {}
    for r in df.collect():
        groups.setdefault(r.k, []).append((-r.v, r.id))
    for rows in groups.values():
        assert [out[i] for _, i in sorted(rows)] == list(range(1, len(rows) + 1))


def test_long_title(spark):
    df = spark.createDataFrame([("A" * 20_001 + " bC",)], "n string")
    assert df.select(text.title("n")).first()[0] == "A" + "a" * 20_000 + " Bc"


def test_series_keeps_years_without_value(spark):
    series = spark.createDataFrame([(2001, 5.0)], "y int, v double")
    got = reshape.with_series(spark.range(2), series, 2000, 2002, "y").collect()
    assert sorted((r.id, r.y, r.v or 0) for r in got) == [(i, y, 5.0 if y == 2001 else 0) for i in (0, 1) for y in (2000, 2001, 2002)]


def test_projection_keeps_facilities_without_factors(spark):
    ops = spark.createDataFrame([("a", "Commercial", "d", 1.0), ("b", "Reliever", "d", 2.0), ("c", "Commercial", "d", 3.0)],
                                "facility_id string, facility_group string, district string, annual_operations double")
    factors = spark.createDataFrame([("c", 2011, 1.5)], "facility_id string, sysyear int, proj_fac double")
    observed = spark.createDataFrame([], "facility_id string, proj_fac double")
    national = spark.createDataFrame([], "sysyear int, mil_proj_fac double, com_av_proj_fac double")
    got = projection.projection_all(ops, factors, observed, national).collect()
    assert sorted((r.facility_id, r.sysyear or 0, r.proj_fac or 0) for r in got) == [("a", 0, 0), ("b", 0, 0), ("c", 2011, 1.5)]


def test_exact_quantile(spark):
    df = spark.createDataFrame([(float(v * v % 97),) for v in range(500)], "v double")
    got = ranking.exact_quantile(df, "v", 0.95).first()[0]
    assert abs(got - df.agg(F.percentile("v", 0.95)).first()[0]) < 1e-9


def test_share_sums_to_one_and_null_keys(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0)], "k string, v double")
    out = {(r.k, r.v): r.s for r in measures.share_of_group(df, ["k"], "v", "s").collect()}
    assert out == {("a", 1.0): 0.25, ("a", 3.0): 0.75, (None, 5.0): None}
    assert pairs(measures.group_sums(df, ["k"], t="v"), "k", "t") == [("a", 4.0)]


def test_first_known_is_per_column(spark):
    df = spark.createDataFrame([("a", 1, None, "x"), ("a", 2, "p", "y"), ("a", 3, "q", None)], "k string, o int, c string, d string")
    assert measures.first_known(df, ["k"], ["o"], ["c", "d"]).first()[1:] == ("p", "x")


def test_redistribute_keeps_the_total(spark):
    df = spark.createDataFrame([("f", "a", 0.5, 50.0), ("f", "b", 0.3, 30.0), ("f", "c", 0.2, 20.0)], "f string, e string, s double, o double")
    out = measures.redistribute(df, ["f"], F.col("e") != "c", "s", "o")
    assert {(r.e): round(r.ops_fleet_adj, 9) for r in out.collect()} == {"a": 60.0, "b": 36.0}
    assert abs(sum(r.fleetmix_adj for r in out.collect()) - 1) < 1e-12


def test_nearest_value_against_brute_force(spark):
    rng = random.Random(7)
    have = [(f"d{i:03d}", rng.choice("xyz"), float(rng.choice([1, 2, 3, rng.randrange(1000)]))) for i in range(300)]
    need = [(f"n{i:03d}", rng.choice("xyzw"), float(rng.randrange(1000))) for i in range(200)]
    schema = "id string, g string, m double"
    out = donors.nearest_value(spark.createDataFrame(need, schema), spark.createDataFrame(have, schema), "g", "m", "id")
    got = {r.id: (r.donor_id, r.ops_diff) for r in out.collect()}
    for i, g, m in need:
        best = min(((abs(m - dm), d) for d, dg, dm in have if dg == g), default=(None, None))
        assert got[i] == (best[1], best[0])


def test_donor_errors_and_ties(spark):
    need = spark.createDataFrame([("n",)], "facility_id string")
    have = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "facility_id string, m double")
    assert donors.lowest_donor(need, have, "facility_id", "m").first().donor_id == "a"
    with pytest.raises(Exception, match="more than one donor"):
        donors.only_donor(need, have, "facility_id").collect()


def test_pivot_refuses_repeated_cells(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0)], "k string, c string, v double")
    assert reshape.pivot_unique(df, ["k"], "c", ["y", "x", "z"], "v").first() == ("a", 2.0, 1.0, None)
    with pytest.raises(Exception, match="repeated key"):
        reshape.pivot_unique(df.union(df), ["k"], "c", ["x"], "v").collect()


def test_series_extension(spark):
    df = spark.createDataFrame([("a", 2044, 1.0), ("a", 2045, 2.0), ("b", 2045, 5.0), ("b", 2046, 6.0)], "f string, y int, v double")
    out = reshape.extend_series(df, "f", "y", 2045, 2047)
    assert pairs(out, "f", "y", "v") == [("a", 2044, 1.0), ("a", 2045, 2.0), ("a", 2046, 2.0), ("a", 2047, 2.0), ("b", 2045, 5.0), ("b", 2046, 6.0)]


def test_k_nearest_against_brute_force(spark):
    rng = random.Random(3)
    spot = lambda: (round(rng.uniform(-90, 90), 2), round(rng.uniform(-180, 180), 2))
    town = lambda: (round(30 + rng.uniform(0, 0.05), 3), round(179.98 + rng.uniform(0, 0.02), 3))
    left = [(f"l{i}", *(spot() if i % 2 else town())) for i in range(60)] + [("np", 90.0, 0.0), ("sp", -89.99, 179.9), ("w", 30.01, -179.999)]
    right = [(f"r{i:03d}", *(spot() if i % 3 else town())) for i in range(150)] + [(f"s{i}", 30.0, 180.0) for i in range(6)]
    out = geo.k_nearest(
        spark.createDataFrame(left, "l string, lat double, lon double"), spark.createDataFrame(right, "r string, lat double, lon double"), "l", "r", 3
    )
    got = {}
    for r in out.collect():
        got.setdefault(r.l, []).append((r["rank"], r.dist_mi))

    def dist(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * geo.EARTH_MILES * math.asin(math.sqrt(min(1, h)))

    for a in left:
        want = sorted(dist(a, b) for b in right)[:3]
        assert [round(d, 6) for _, d in sorted(got[a[0]])] == [round(d, 6) for d in want]
    few = geo.k_nearest(
        spark.createDataFrame(left, "l string, lat double, lon double"), spark.createDataFrame(right[:2], "r string, lat double, lon double"), "l", "r", 3
    )
    assert few.count() == 2 * len(left)


def test_point_in_polygon_border(spark):
    ring = [(1, 1, 0.0, 0.0), (1, 2, 4.0, 0.0), (1, 3, 4.0, 4.0), (1, 4, 0.0, 4.0)]
    pts = [("in", 1.0, 1.0), ("edge", 4.0, 2.0), ("corner", 0.0, 0.0), ("out", 5.0, 1.0), ("top", 2.0, 4.0)]
    hits = geo.points_in_polygons(
        spark.createDataFrame(pts, "id string, lon double, lat double"),
        spark.createDataFrame(ring, "poly int, seq int, x double, y double"), "id", "poly",
    )
    assert {r.id for r in hits.collect()} == {"in", "edge", "corner", "top"}


def plain_inside(x, y, rings):
    """Even-odd over all rings; a point on an edge is inside."""
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return True
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * ((x2 - x1) / (y2 - y1)):
                odd = not odd
    return odd


@pytest.mark.parametrize("cell", [0.3, 1.0, 7.0])
def test_polygons_of_several_rings(spark, cell):
    """Holes, an island in a hole, a second outline, and vertex numbers that begin anywhere."""
    rng = random.Random(int(cell * 10))
    square = lambda x, y, d: [(x, y), (x + d, y), (x + d, y + d), (x, y + d)]
    wild = [(20 + r * math.cos(a / 20 * math.pi), 5 + r * math.sin(a / 20 * math.pi)) for a in range(40) for r in [rng.uniform(1, 6)]]
    polygons = {1: [square(0, 0, 10), square(2, 2, 6), square(4, 4, 2)], 2: [square(-9, -9, 3), square(-3, -9, 2)], 3: [wild], 4: [square(3, 3, 4)]}
    rows = [(p, r, 7 + 3 * i, float(x), float(y)) for p, rings in polygons.items() for r, ring in enumerate(rings) for i, (x, y) in enumerate(ring)]
    points = [(i, rng.uniform(-12, 28), rng.uniform(-12, 14)) for i in range(600)] + [(1000 + 30 * x + y, float(x), float(y)) for x in range(-10, 12) for y in range(-10, 12)]
    points += [(5000, None, 1.0), (5001, 3.0, None)]
    hits = geo.points_in_polygons(
        spark.createDataFrame(points, "id int, lon double, lat double"), spark.createDataFrame(rows, "poly int, ring int, seq int, x double, y double"), "id", "poly", cell=cell)
    got = sorted((r.id, r.poly) for r in hits.collect())
    assert got == sorted((i, p) for i, x, y in points if x is not None and y is not None for p, rings in polygons.items() if plain_inside(x, y, rings))


def test_only_border_tiles_meet_edges(spark):
    ring = [(1, 1, 0.0, 0.0), (1, 2, 40.0, 1.0), (1, 3, 39.0, 40.0), (1, 4, 0.5, 38.0)]
    tiles = geo.polygon_tiles(geo.ring_edges(spark.createDataFrame(ring, "poly int, seq int, x double, y double"), "poly"), "poly", 1.0)
    found = {r._border: r.n for r in tiles.groupBy("_border").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert found[False] > 1200 and found[True] < 250


def test_right_points_are_stored_once(spark):
    """A dense town, a line of places and lone ones: every point lies in one leaf, and no leaf is crowded."""
    rng = random.Random(2)
    right = [(f"t{i}", 40 + rng.uniform(0, 0.05), 20 + rng.uniform(0, 0.05)) for i in range(3000)]
    right += [(f"l{i}", -60 + i / 50, 179.99) for i in range(500)] + [(f"s{i}", rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(40)] + [(f"d{i}", 10.0, 10.0) for i in range(300)]
    places = spark.createDataFrame(right, "r string, lat double, lon double").select("r", "lat", "lon", *geo._sphere("lat", "lon"))
    cells = places.select(*geo._index(geo.FINEST)).groupBy(*geo.CELL).agg(F.count(F.lit(1)).alias("_n"))
    leaves = geo.occupancy_tree(cells).where("_leaf").collect()
    assert sum(r._n for r in leaves) == len(right)
    assert all(r._n <= geo.LEAF or r._level == geo.FINEST for r in leaves)
    left = [(f"p{i}", rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(30)] + [("town", 40.02, 20.02), ("line", -55.0, -179.99), ("pole", 90.0, 0.0), ("same", 10.0, 10.0)]
    found = geo.k_nearest(spark.createDataFrame(left, "l string, lat double, lon double"), spark.createDataFrame(right, "r string, lat double, lon double"), "l", "r", 4)
    got = {}
    for r in found.collect():
        got.setdefault(r.l, []).append((r.rank, r.r, r.dist_mi))

    def dist(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * geo.EARTH_MILES * math.asin(math.sqrt(min(1, h)))

    for a in left:
        want = sorted((dist(a, b), b[0]) for b in right)[:4]
        assert [round(d, 6) for _, _, d in sorted(got[a[0]])] == [round(d, 6) for d, _ in want]
    assert [r for _, r, _ in sorted(got["same"])] == sorted(r for r, _, _ in right if r[0] == "d")[:4]


def test_priority_match(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "z"), ("4", None), (None, "y"), ("5", "x")], "id string, name string")
    b = spark.createDataFrame([("1", "y"), ("7", "y"), ("8", "y"), ("9", "x"), (None, "z"), ("10", None)], "id string, name string")
    rules = {"id": (F.col("id"), F.col("id")), "name": (F.col("name"), F.col("name"))}
    got = joins.priority_match(a, b, "id", "id", rules)
    assert pairs(got.where("id IS NOT NULL").na.fill("none"), "id", "match_id", "method") == [
        ("1", "1", "id"), ("2", "1", "name"), ("2", "7", "name"), ("2", "8", "name"), ("3", "none", "name"), ("5", "9", "name")]
    assert got.where("id IS NULL").count() == 3


def test_list_in_blocks(spark):
    items = spark.range(250).select(F.concat(F.lit("i"), "id").alias("item"), F.lit(0.5).alias("share"))
    places = spark.range(40).select(F.concat(F.lit("f"), "id").alias("facility_id"), F.lit("own").alias("item"))
    for size in (7, 1000):
        out = fleet.spread_list(places, items, size)
        assert out.columns == ["facility_id", "item", "share"] and out.count() == out.distinct().count() == 40 * 250
        assert "Cartesian" not in out._jdf.queryExecution().executedPlan().toString()
    assert fleet.spread_list(places, items.limit(0)).count() == 0


def test_scenario_text(spark):
    track = F.struct(F.lit("t <&> 1").alias("track_name"), F.lit(None).cast("string").alias("rwy_end_name"), F.lit("V").alias("segment_type"), F.lit(1.5).alias("dist_or_rad"))
    op = lambda no, name, apu: F.struct(F.lit(no).cast("bigint").alias("no"), F.lit(f"A{no}").alias("id"), F.lit(name).alias("airframe_model"), F.lit("E & <1>").alias("engine_code"),
                                        F.lit(apu).cast("string").alias("apu_name"), F.lit(13.0).alias("arrival_apu_time"), F.lit(None).cast("double").alias("departure_apu_time"),
                                        F.lit(2.0).alias("num_operations"), F.lit("STANDARD").alias("profile"), F.lit("M").alias("stage_len"))
    rows = spark.range(1).select(F.lit("dal").alias("facility_id"), F.lit("A").alias("op_type"), F.lit(0).alias("aircraft_type"), F.lit(2).alias("block_no"),
                                 track.alias("track"), F.array(op(1, 'Cessna "172"', None), op(2, "x", "APU 1")).alias("operations"))
    texts = performance.scenario_xml(rows)
    text_ = texts.first().xml
    assert text_.startswith("<trackOpSet>") and text_.count("<operation>") == 2 and "E &amp; &lt;1" in text_
    got = performance.read_scenario_xml(texts).orderBy("no").collect()
    assert [(r.no, r.id, r.airframe_model, r.engine_code, r.apu_name, r.arrival_apu_time, r.departure_apu_time, r.track_name, r.block_no) for r in got] == [
        (1, "A1", 'Cessna "172"', "E & <1>", None, 13.0, None, "t <&> 1", 2), (2, "A2", "x", "E & <1>", "APU 1", 13.0, None, "t <&> 1", 2)]
    with pytest.raises(Exception):
        performance.read_scenario_xml(texts.withColumn("xml", F.replace("xml", F.lit(">2.0<"), F.lit(">two<")))).collect()


def test_null_safe_join_and_second_chance(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 3), ("y", 4)], "k string, b int")
    assert joins.null_safe_join(a, b, ["k"]).collect()[0][1:] == (1, 3)
    units = spark.createDataFrame([(5,), (200005,), (7,), (None,)], "aetc int")
    codes = spark.createDataFrame([(200005, "t")], "code int, d string")
    out = joins.second_chance(units, codes, "aetc", "code", 200000, "d")
    assert {(r.aetc, r.match_rule) for r in out.collect()} == {(5, "shifted"), (200005, "raw"), (7, "none"), (None, "no key")}


def test_profiles_compare_stages_as_text(spark):
    rows = [("p", "A", "STANDARD", "8", 1.0), ("p", "A", "STANDARD", "M", 2.0), ("p", "A", "NOISEMAP", "Z", 3.0),
            ("q", "D", "NOISEMAP", "1", 4.0), ("q", "D", "NOISEMAP", "1", 5.0), ("p", "V", "STANDARD", "9", 6.0)]
    planes = spark.createDataFrame(rows, "acft_id string, op_type string, prof_id1 string, prof_id2 string, weight double")
    helis = spark.createDataFrame([("h", "A", "STANDARD", "1", 7.0)], "helo_id string, op_type string, prof_id1 string, prof_id2 string, weight double")
    out = performance.clean_profiles(planes, helis)
    assert pairs(out, "acft_id", "stage_len", "weight") == [("h", "1", 7.0), ("p", "M", 2.0), ("q", "1", 4.0), ("q", "1", 5.0)]


def test_split_needs_two_rows(spark):
    schema = "facility_id string, airframe_id int, engine_id int, op_type string, ops_fleet_adj double, arfm_mod string, engine_code string"
    good = [("f", 1, 1, "A", 5.0, "m", "e"), ("f", 1, 1, "D", 5.0, "m", "e"), ("f", 2, 1, "A", 9.0, "n", "e"), ("f", 2, 1, "D", 9.0, "n", "e")]
    out = performance.split_arr_dep(spark.createDataFrame(good, schema))
    assert pairs(out, "airframe_id", "op_type", "ltos", "ids") == [(1, "A", 2.0, 2), (1, "D", 2.0, 2), (2, "A", 4.0, 1), (2, "D", 4.0, 1)]
    with pytest.raises(Exception, match="lacks an arrival"):
        performance.split_arr_dep(spark.createDataFrame(good[:3], schema)).collect()


def test_lost_operations_limit(spark):
    ops = spark.createDataFrame([("f", "a", 0.5, 5000.0), ("f", "b", 0.5, 5000.0)], "facility_id string, anp_id string, fleetmix double, ops_fleet double")
    prof = spark.createDataFrame([("a", "A", "STANDARD", "1", 1.0)], "acft_id string, op_type string, profile string, stage_len string, weight double")
    with pytest.raises(Exception, match="without a profile"):
        performance.attach_profiles(ops, prof)["data"].collect()


def test_imputation_rules(spark):
    rows = [("HELIPORT", "Medical", 9.0), ("HELIPORT", "Other_PR_Heliports", None), ("HELIPORT", "Other_PR_Heliports", 7.0),
            ("HELIPORT", "Farm/Ranch", None), ("AIRPORT", "Other_PU_Airports", 3.0), ("AIRPORT", "TASP", 4.0)]
    out = operations.imputed_operations(spark.createDataFrame(rows, "facility_type string, facility_group string, prior_ops double"))
    assert [r.ops_impute_annual for r in out.collect()] == [156.0, 110.0, 7.0, 2.0, 110.0, 4.0]


def test_classification_order(spark):
    schema = ("facility_id string, facility_name string, facility_type string, used string, other_services string, "
              "medical_use string, ownership string, tx_dot_group string")
    rows = [("x1", "Big RANCH", "AIRPORT", "PR", None, "N", "PR", None), ("x2", "Farm", "HELIPORT", "PR", None, "Y", "PR", None),
            ("x3", "Base", "AIRPORT", "PU", None, "Y", "MA", None), ("dfw", "x", "AIRPORT", "PU", None, "N", "MA", "TASP"),
            ("x4", "y", "HELIPORT", "PU", None, None, None, None)]
    out = facility.classify_facility(spark.createDataFrame(rows, schema))
    assert [r.facility_group for r in out.collect()] == ["Farm/Ranch", "Medical", "Military", "Commercial", "Other_PU_Heliports"]


def test_fleet_mix_drops_unknown_types(spark):
    rows = [(2019, " DAL ", "Love", "B737", "t", "boeing", 30.0), (2019, "dal", "Love", " b737", "t", None, 10.0),
            (2019, "dal", "Love", "C172", "t", "cessna", 60.0), (2019, "dal", "Love", "ZZ", "t", "x - unknown", 5.0),
            (2019, "dal", "Love", "ZY", None, "ok", 5.0), (2019, "dal", "Love", "NOMAP", "t", "ok", 5.0)]
    traffic = spark.createDataFrame(rows, "year_id int, facility_id string, airport string, aircraft_id string, aircraft_type_id string, aircraft_type string, total_ops double")
    amap = spark.createDataFrame([("b737", "a", "t", 1, "f"), ("c172", "b", "t", 2, "f"), ("nomap", "c", "t", None, "f")],
                                 "aircraft_id string, aircraft_type string, aircraft_type_id string, airframe_id int, airframe_type string")
    shares, audit = fleet.fleet_mix(traffic, amap)
    assert pairs(shares, "aircraft_id", "fleetmix") == [("b737", 0.4), ("c172", 0.6)]
    assert audit.first().lost == 5.0


def test_projection_gap_fill(spark):
    fc = spark.createDataFrame([("SKF ", 2016, 50), ("skf", 2019, 100), ("abc", 2019, 10), ("abc", 2020, 0)], "facility_id string, sysyear int, t_aops int")
    out = projection.projection_factor(fc)
    got = {(r.facility_id, r.sysyear): r.proj_fac for r in out.collect()}
    assert got[("skf", 2016)] == 0.5 and got[("skf", 2011)] == 1.0 and ("abc", 2020) not in got and len(got) == 8


def test_airport_fleet_reshares(spark):
    rows = [("f", 1, 1, 0.5, 100.0, None), ("f", 2, 1, 0.25, 100.0, "H"), ("f", 3, 1, 0.25, 100.0, None)]
    own = spark.createDataFrame(rows, "facility_id string, airframe_id int, engine_id int, fleetmix double, annual_operations double, anp_helicopter_id string")
    engines = spark.createDataFrame([(1, "E1")], "engine_id int, engine_code string")
    frames = spark.createDataFrame([(1, "Jet"), (2, "Heli"), (3, "Cessna 182 Float")], "airframe_id int, model string")
    out = emissions.airport_fleet(own, engines, frames, [])
    assert {r.equipment_type: round(r.ltos, 9) for r in out.collect()} == {"h/e1": round(100 / 6, 9), "jet/e1": round(100 / 3, 9)}
