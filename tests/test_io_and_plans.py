"""Scans and sinks, and the shape of physical plans."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from skyledger import schemas
from skyledger.operators import measures
from skyledger.sources import readers, writers
from tests.conftest import DATA

QUERIES = __spark_entry__.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_delimited_round_trip(spark, tmp_path):
    path = tmp_path / "abc_2019_x.csv"
    path.write_text('facility_id,region_id,tx_dot,airport_name,city,airport_type\n"A1",r," TASP ","Smith, Bob",c,t\n')
    df = readers.with_file_keys(readers.read_csv(spark, str(path), schemas.PLANNING_GROUP), {"fac": r"^([a-z]+)_", "year": r"_(\d{4})_"}, ["year"])
    row = df.first()
    assert (row.facility_id, row.tx_dot, row.airport_name, row.fac, row.year) == ("A1", " TASP ", "Smith, Bob", "abc", 2019)


def test_bad_cells_become_null(spark, tmp_path):
    path = tmp_path / "own.tsv"
    path.write_text("facility_id\tops_2019\tops_2020\tsummer_2019\tsummer_2020\na\t1.5\tx\t\t2\n")
    assert tuple(readers.read_tsv(spark, str(path), schemas.OWN_OPS).first()) == ("a", 1.5, None, None, 2.0)


def test_partitioned_write_and_pruned_read(spark, tmp_path):
    path = str(tmp_path / "d")
    df = spark.createDataFrame([(2019, "a", 1.0), (2020, "b", 2.0), (2020, "a", 3.0)], "year int, county string, v double")
    writers.write_by_group(df, path, ["year", "county"])
    assert os.path.isdir(f"{path}/year=2020/county=a")
    back = readers.read_parquet(spark, path, "v double, year int, county string", F.col("year") == 2020)
    assert back.count() == 2 and "PartitionFilters: [isnotnull(year" in plan(back)
    assert readers.read_group(spark, path, "county", "a").count() == 2
    with pytest.raises(ValueError):
        readers.check_schema(back, "v int")
    writers.write_result_set({"one": df, "two": df.limit(1)}, str(tmp_path / "set"))
    assert sorted(os.listdir(tmp_path / "set")) == ["one", "two"]
    writers.write_tsv_by_group(df, str(tmp_path / "tsv"), ["county"])
    assert readers.read_tsv(spark, str(tmp_path / "tsv"), "year int, v double").count() == 3


def test_lines_that_do_not_fit(spark):
    rows = [(1, '5,"a, ""b""",1.5'), (2, "x,b,2"), (3, "6,b"), (4, "6,b,2,3"), (5, None), (6, ""), (7, "7,,"), (8, "y,b,z"), (9, '8,"open,2')]
    good, bad = readers.parse_lines(spark.createDataFrame(rows, "no int, line string"), "line", "k int, name string, v double")
    assert sorted(tuple(r) for r in good.collect()) == [(1, 5, 'a, "b"', 1.5), (7, 7, None, None)]
    reasons = {r.no: r.reason for r in bad.collect()}
    assert reasons == {2: "k", 3: "number of fields", 4: "number of fields", 5: "no line", 6: "no line", 8: "k, v", 9: "number of fields"}
    assert {r.no: r.line for r in bad.collect()}[2] == "x,b,2"


def test_only_partitions_of_the_dimension_are_read(spark):
    text = plan(QUERIES["partition_pruning"](spark, DATA))
    assert "dynamicpruning" in text


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_other_groups_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "groups")
    df = spark.range(3000).select((F.col("id") % 3).cast("int").alias("g"), "id")
    writers.write_by_group(df, path, ["g"])
    before = files(path)
    for _ in range(2):
        writers.replace_groups(df.where("g = 1 AND id < 100"), path, ["g"])
    after = files(path)
    assert {f for f in before if "g=1" not in f} == {f for f in after if "g=1" not in f}
    assert not {f for f in before if "g=1" in f} & after
    back = {r.g: r.n for r in spark.read.parquet(path).groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert back == {0: 1000, 1: 33, 2: 1000}


def test_hot_group_is_cut_and_keeps_its_keys(spark, tmp_path):
    path = str(tmp_path / "hot")
    df = spark.range(0, 400_000, 1, 8).select(F.when(F.col("id") % 20 < 18, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 20)).alias("k"), F.xxhash64("id").alias("v"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "400000")
    try:
        writers.write_group_files(df, path, ["k"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    counts = {g: len(files(f"{path}/of_k={g}")) for g in ("hot", "g18", "g19")}
    assert counts["hot"] > 3 and counts["g18"] <= 2 and counts["g19"] <= 2
    assert spark.read.parquet(f"{path}/of_k=g18").select("k").distinct().first()[0] == "g18"
    back = writers.read_group_files(spark, path)
    assert back.columns == ["k", "v"] and back.exceptAll(df).isEmpty() and df.exceptAll(back).isEmpty()
    assert "PartitionFilters: [isnotnull(of_k" in plan(writers.read_group_files(spark, path, k="g18"))


def test_failed_rows_stop_a_checked_write(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "i int, s string")
    found = writers.write_checked(df, str(tmp_path / "a"), {"number": F.col("i") > 0})
    assert found == {"rows": 3, "number": 0}
    with pytest.raises(ValueError, match="text 2"):
        writers.write_checked(df, str(tmp_path / "b"), {"number": F.col("i") > 0, "text": F.col("s") != ""})


def test_tables_append_and_replace(spark):
    df = spark.createDataFrame([(1, "a")], "i int, s string")
    try:
        assert writers.create_table(df, "sky_t").count() == 1
        writers.append_rows(df.select("s", "i"), "sky_t")
        assert spark.table("sky_t").count() == 2
        writers.replace_rows(df, "sky_t")
        assert [tuple(r) for r in spark.table("sky_t").collect()] == [(1, "a")]
    finally:
        spark.sql("DROP TABLE IF EXISTS sky_t")


@pytest.mark.parametrize("name", ["fleet_mix", "snowflake_chain", "ratio_group", "facility_master", "nearest_donor", "national_series_cross"])
def test_no_cartesian_and_no_single_task_window(spark, name):
    text = plan(QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in text and "BatchEvalPython" not in text
    assert "Window [" not in text or "SinglePartition" not in text.split("Window [")[-1].split("Exchange")[1][:40]


def test_filter_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["dedup_measure_sum"](spark, DATA))
    assert "PushedFilters: [IsNotNull(l_returnflag)" in text and "l_extendedprice" not in text.split("ReadSchema")[1]


def test_same_result_for_other_shuffle_widths(spark):
    def run():
        df = QUERIES["half_even_split"](spark, DATA)
        return sorted(tuple(r) for r in df.collect())

    first = run()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert run() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_top_k_is_cut_before_the_shuffle(spark):
    assert plan(QUERIES["topk_per_group"](spark, DATA)).count("WindowGroupLimit") >= 2


def test_counts_are_partial_before_the_shuffle(spark):
    df = measures.group_sums(spark.read.parquet(f"{DATA}/lineitem.parquet"), ["l_suppkey"], q="l_quantity")
    assert "partial_sum" in plan(df)
