"""Scans and sinks: tables made from the given ones, written to the shared folder and read back."""

from pyspark.sql import functions as F

from skyledger.session import fresh_path
from skyledger.sources import readers, writers
import workload.roles  # noqa: F401
from workload.registry import query

# A text line for each customer; some have a balance that is no number, a field less or a field more.
LINE = """concat_ws('{sep}', CAST(c_custkey AS STRING), '"' || c_name || '{sep} "" Inc"',
  CASE WHEN c_custkey % 7 = 0 THEN 'n/a' ELSE CAST(c_acctbal AS STRING) END,
  CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END, CASE WHEN c_custkey % 13 = 0 THEN 'more' END)"""
LINE_SCHEMA = "custkey bigint, name string, bal double, segment string"
# One field less and one more add up to a line of four fields, whose last one is the surplus.
LINES_SQL = """SELECT c_custkey AS line_no,
  CASE WHEN good THEN c_custkey END AS custkey, CASE WHEN good THEN c_name || '{sep} " Inc' END AS name, CASE WHEN good THEN c_acctbal END AS bal,
  CASE WHEN good AND c_custkey % 11 = 0 THEN 'more' WHEN good THEN c_mktsegment END AS segment,
  CASE WHEN fields <> 4 THEN 'number of fields' WHEN c_custkey % 7 = 0 THEN 'bal' END AS reason
FROM (SELECT *, fields = 4 AND c_custkey % 7 <> 0 AS good FROM (
  SELECT *, 4 - CAST(c_custkey % 11 = 0 AS INT) + CAST(c_custkey % 13 = 0 AS INT) AS fields FROM {{customer}}))"""


def together(good, bad):
    return good.unionByName(bad.select("line_no", "reason"), allowMissingColumns=True).select("line_no", "custkey", "name", "bal", "segment", "reason")


@query("parse_lines", LINES_SQL.format(sep=","))
def _(t):
    lines = t.customer.select(F.col("c_custkey").alias("line_no"), F.expr(LINE.format(sep=",")).alias("line"))
    return together(*readers.parse_lines(lines, "line", LINE_SCHEMA))


@query("delimited_scan", """
SELECT reason, count(*) AS lines, count(DISTINCT line_no) AS customers, round(coalesce(sum(bal), 0), 2) AS bal FROM (""" + LINES_SQL.format(sep="\t") + """) GROUP BY 1""")
def _(t):
    """The lines as files of tab-separated text; where a line does not parse, its first field tells the customer."""
    spark = t.customer.sparkSession
    path = fresh_path(spark, "lines")
    t.customer.select(F.expr(LINE.format(sep="\t")).alias("value")).write.text(path)
    good, bad = readers.read_lines(spark, path, LINE_SCHEMA, "\t")
    rows = good.select(F.col("custkey").alias("line_no"), "bal", F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select(F.split_part("line", F.lit("\t"), F.lit(1)).cast("bigint").alias("line_no"), F.lit(None).cast("double").alias("bal"), "reason"))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("line_no").alias("customers"), F.round(F.coalesce(F.sum("bal"), F.lit(0.0)), 2).alias("bal"))


@query("csv_round_trip", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM {orders}")
def _(t):
    spark = t.orders.sparkSession
    path = fresh_path(spark, "csv")
    writers.write_flat(t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice"), path, "csv", header=True)
    return readers.read_csv(spark, path, "o_orderkey bigint, o_orderpriority string, o_totalprice double")


def kept_customers(t, path):
    columns = ["c_custkey", "c_acctbal", "c_mktsegment", F.col("c_nationkey").cast("int").alias("nation")]
    writers.write_by_group(t.customer.select(*columns), path, ["nation"])
    schema = "c_custkey bigint, c_acctbal double, c_mktsegment string, nation int"
    return readers.check_schema(readers.read_parquet(t.customer.sparkSession, path, schema), schema)


@query("partition_pruning", """
SELECT n_name, c_mktsegment, count(*) AS customers, round(sum(c_acctbal), 2) AS bal FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
JOIN {region} ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1, 2""")
def _(t):
    """A kept table, partitioned by nation, of which only the nations that the filtered dimension has are read."""
    kept = kept_customers(t, fresh_path(t.customer.sparkSession, "customers"))
    asia = t.nation.join(t.region.where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("int").alias("nation"), "n_name")
    return kept.join(asia, "nation").groupBy("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("bal"))


@query("group_read", "SELECT c_custkey, c_acctbal, c_mktsegment FROM {customer} WHERE c_nationkey = 7")
def _(t):
    path = fresh_path(t.customer.sparkSession, "customers")
    kept_customers(t, path)
    return readers.read_group(t.customer.sparkSession, path, "nation", 7).select("c_custkey", "c_acctbal", "c_mktsegment")


@query("replace_groups", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN l_quantity + 1 ELSE l_quantity END AS qty, l_returnflag AS flag FROM {lineitem}
WHERE l_returnflag <> 'R' OR l_linestatus = 'F'""")
def _(t):
    """One group is replaced, twice; the others stay as they were written."""
    spark = t.lineitem.sparkSession
    path = fresh_path(spark, "lines")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("qty"), "l_linestatus", F.col("l_returnflag").alias("flag"))
    writers.write_by_group(rows.drop("l_linestatus"), path, ["flag"])
    fixed = rows.where("flag = 'R' AND l_linestatus = 'F'").withColumn("qty", F.col("qty") + 1).drop("l_linestatus")
    writers.replace_groups(fixed, path, ["flag"])
    writers.replace_groups(fixed, path, ["flag"])
    return readers.read_parquet(spark, path, fixed.schema)


@query("table_rows", """
SELECT n_nationkey AS id, n_name AS name, 'first' AS part FROM {nation} WHERE n_regionkey = 1 UNION ALL
SELECT s_suppkey, s_name, 'second' FROM {supplier}""")
def _(t):
    """A table is created, filled with other rows and added to, columns matched by name."""
    spark = t.nation.sparkSession
    name = fresh_path(spark, "sky_rows").rsplit("/", 1)[1].replace("-", "_")
    rows = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("first").alias("part"), "n_regionkey")
    writers.create_table(rows.drop("n_regionkey"), name)
    writers.replace_rows(rows.where("n_regionkey = 1").select("part", "name", "id"), name)
    writers.append_rows(t.supplier.select(F.lit("second").alias("part"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), name)
    return spark.table(name)


@query("group_files", """
SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity, 'all' AS via FROM {lineitem} UNION ALL
SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity, 'one group' FROM {lineitem} WHERE l_returnflag = 'A' UNION ALL
SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity, 'one file set' FROM {lineitem} WHERE l_returnflag = 'N' AND l_linestatus = 'O'""")
def _(t):
    """One file set per group, with all columns in the files: read whole, by group, and as one directory handed on alone."""
    spark = t.lineitem.sparkSession
    path = fresh_path(spark, "groups")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity")
    writers.write_group_files(rows, path, ["l_returnflag", "l_linestatus"])
    alone = spark.read.parquet(f"{path}/of_l_returnflag=N/of_l_linestatus=O")
    return (
        writers.read_group_files(spark, path).withColumn("via", F.lit("all"))
        .unionByName(writers.read_group_files(spark, path, l_returnflag="A").withColumn("via", F.lit("one group")))
        .unionByName(alone.withColumn("via", F.lit("one file set")))
    )


@query("result_set", """
SELECT 'operations' AS name, CAST(o_custkey AS VARCHAR) AS key, count(*) AS n FROM {orders} GROUP BY o_custkey UNION ALL
SELECT 'fleet', p_brand, count(*) FROM {part} GROUP BY p_brand""")
def _(t):
    spark = t.orders.sparkSession
    path = fresh_path(spark, "result")
    tables = {
        "operations": t.orders.groupBy(F.col("o_custkey").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")),
        "fleet": t.part.groupBy(F.col("p_brand").alias("key")).agg(F.count(F.lit(1)).alias("n")),
    }
    writers.write_result_set(tables, path)
    back = [spark.read.parquet(f"{path}/{name}").withColumn("name", F.lit(name)) for name in tables]
    return back[0].unionByName(back[1])


@query("checked_write", "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM {customer} GROUP BY 1")
def _(t):
    """Rows are checked in the pass that writes them."""
    path = fresh_path(t.customer.sparkSession, "customers")
    writers.write_checked(t.customer, path, {"key": F.col("c_custkey").isNotNull(), "segment": F.col("c_mktsegment") != ""})
    return t.customer.sparkSession.read.parquet(path).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("bal"))
