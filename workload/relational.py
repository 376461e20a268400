"""Joins, aggregates, reshapes, windows, set operations."""

from pyspark.sql import functions as F

from skyledger.functions.numbers import ratio
from skyledger.operators import donors, geo, joins, measures, ranking, reshape
from skyledger.operators.skew import with_scalars
import workload.roles  # noqa: F401
from workload.registry import query


def order_year():
    return F.year("o_orderdate").cast("int")


@query("fleet_mix_loss_audit", """
WITH b AS (SELECT l_suppkey, sum(l_quantity) AS before FROM {lineitem} GROUP BY 1),
a AS (SELECT l_suppkey, sum(l_quantity) AS after FROM {lineitem} JOIN {part} ON l_partkey = p_partkey WHERE p_size <= 40 GROUP BY 1)
SELECT l_suppkey, before, after, before - after AS lost, round((before - after) * 100 / nullif(before, 0), 6) AS percent_lost
FROM b FULL JOIN a USING (l_suppkey)""")
def _(t):
    small = t.part.where("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"))
    after = t.lineitem.join(small, "l_partkey")
    out = measures.loss_audit(t.lineitem, after, ["l_suppkey"], "l_quantity")
    return out.withColumn("percent_lost", F.round("percent_lost", 6))


@query("lookup_join", """
SELECT c_custkey, n_name, r_name FROM {customer} LEFT JOIN {nation} ON c_nationkey = n_nationkey
LEFT JOIN {region} ON n_regionkey = r_regionkey""")
def _(t):
    out = joins.lookup(t.customer, t.nation, {"c_nationkey": "n_nationkey"}, ["n_name", "n_regionkey"])
    out = joins.lookup(out, t.region, {"n_regionkey": "r_regionkey"}, ["r_name"])
    return out.select("c_custkey", "n_name", "r_name")


@query("snowflake_chain", """
SELECT r_name, n_name, p_type, CAST(count(*) AS BIGINT) AS n, sum(l_quantity) AS qty
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
JOIN {part} ON l_partkey = p_partkey GROUP BY 1, 2, 3""")
def _(t):
    out = joins.lookup(t.lineitem, t.orders, {"l_orderkey": "o_orderkey"}, ["o_custkey"], "inner")
    out = joins.lookup(out, t.part, {"l_partkey": "p_partkey"}, ["p_type"], "inner")
    # Customers and types are counted before the names are looked up.
    out = out.groupBy("o_custkey", "p_type").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))
    out = joins.lookup(out, t.customer, {"o_custkey": "c_custkey"}, ["c_nationkey"], "inner")
    out = joins.lookup(out, t.nation, {"c_nationkey": "n_nationkey"}, ["n_name", "n_regionkey"], "inner")
    out = joins.lookup(out, t.region, {"n_regionkey": "r_regionkey"}, ["r_name"], "inner")
    return out.groupBy("r_name", "n_name", "p_type").agg(F.sum("n").alias("n"), F.sum("qty").alias("qty"))


@query("decode_columns", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' END AS status_val,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'fast' ELSE 'slow' END AS priority_val FROM {orders}""")
def _(t):
    spark = t.orders.sparkSession
    fact = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status_code"), F.col("o_orderpriority").alias("priority_code"))
    speeds = t.orders.select(F.col("o_orderpriority").alias("code")).distinct().withColumn(
        "description", F.when(F.col("code").isin("1-URGENT", "2-HIGH"), "fast").otherwise("slow")
    )
    return joins.decode_columns(fact, {
        "status_code": spark.createDataFrame([("F", "final"), ("O", "open")], "code string, description string"),
        "priority_code": speeds,
    })


@query("full_outer_compare", """
WITH y AS (SELECT o_custkey, year(o_orderdate) AS yr, sum(o_totalprice) AS tot FROM {orders} GROUP BY 1, 2),
a AS (SELECT o_custkey, tot FROM y WHERE yr = 1998), b AS (SELECT o_custkey, tot FROM y WHERE yr = 1999)
SELECT o_custkey, round(a.tot, 4) AS total_a, round(b.tot, 4) AS total_b, a.tot IS NOT NULL AS in_a, b.tot IS NOT NULL AS in_b,
  round(a.tot - b.tot, 4) AS diff, round((a.tot - b.tot) * 100 / nullif(b.tot, 0), 4) AS per_diff
FROM a FULL JOIN b USING (o_custkey)""")
def _(t):
    yearly = t.orders.where(order_year().isin(1998, 1999)).groupBy("o_custkey", order_year().alias("yr")).agg(F.sum("o_totalprice").alias("total"))
    both = joins.compare_outer(
        yearly.where("yr = 1998").drop("yr"), yearly.where("yr = 1999").drop("yr"), ["o_custkey"]
    )
    diff = F.col("total_a") - F.col("total_b")
    return both.select(
        "o_custkey", F.round("total_a", 4).alias("total_a"), F.round("total_b", 4).alias("total_b"), "in_a", "in_b",
        F.round(diff, 4).alias("diff"), F.round(ratio(diff * 100, "total_b"), 4).alias("per_diff"),
    )


@query("null_safe_join", """
WITH a AS (SELECT CASE WHEN c_acctbal > 0 THEN c_nationkey END AS k, c_mktsegment AS seg, count(*) AS n FROM {customer} GROUP BY 1, 2),
b AS (SELECT CASE WHEN s_acctbal > 0 THEN s_nationkey END AS k, max(s_acctbal) AS top FROM {supplier} GROUP BY 1)
SELECT a.k, seg, CAST(n AS BIGINT) AS n, top FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k""")
def _(t):
    a = t.customer.groupBy(F.when(F.col("c_acctbal") > 0, F.col("c_nationkey")).alias("k"), F.col("c_mktsegment").alias("seg")).agg(
        F.count(F.lit(1)).alias("n")
    )
    b = t.supplier.groupBy(F.when(F.col("s_acctbal") > 0, F.col("s_nationkey")).alias("k")).agg(F.max("s_acctbal").alias("top"))
    return joins.null_safe_join(a, b, ["k"])


@query("second_chance_join", """
WITH d AS (SELECT p_partkey * 2 + 500 AS code, p_name AS description FROM {part}),
f AS (SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN l_quantity > 2 THEN l_partkey END AS aetc FROM {lineitem})
SELECT f.*, CASE WHEN aetc IS NULL THEN 'no key' WHEN s.code IS NOT NULL THEN 'shifted' WHEN r.code IS NOT NULL THEN 'raw' ELSE 'none' END AS match_rule,
  coalesce(s.description, r.description) AS description
FROM f LEFT JOIN d s ON s.code - 500 = aetc LEFT JOIN d r ON r.code = aetc""")
def _(t):
    codes = t.part.select((F.col("p_partkey") * 2 + 500).alias("code"), F.col("p_name").alias("description"))
    fact = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_extendedprice", F.when(F.col("l_quantity") > 2, F.col("l_partkey")).alias("aetc")
    )
    return joins.second_chance(fact, codes, "aetc", "code", 500, "description")


@query("ambiguous_lookup", """
WITH d AS (SELECT p_name AS code, p_partkey AS engine_id, p_size, p_brand = 'Brand#7' AS agrees FROM {part}),
n AS (SELECT *, count(*) OVER (PARTITION BY code) AS n, sum(CAST(agrees AS INT)) OVER (PARTITION BY code) AS na,
  min(engine_id) OVER (PARTITION BY code) AS lo FROM d)
SELECT code, engine_id, CASE WHEN n = 1 THEN 'unique' WHEN na > 0 THEN 'agrees' ELSE 'lowest' END AS how FROM n
WHERE n = 1 OR (na > 0 AND agrees) OR (na = 0 AND engine_id = lo)""")
def _(t):
    df = t.part.select(F.col("p_name").alias("code"), F.col("p_partkey").alias("engine_id"), "p_brand")
    return joins.resolve_ambiguous(df, "code", F.col("p_brand") == "Brand#7", "engine_id").select("code", "engine_id", "how")


@query("cascade_match", """
WITH a AS (SELECT c_custkey AS id, 'n' || CAST(c_custkey % 97 AS VARCHAR) || c_mktsegment AS name, c_acctbal AS v, c_nationkey AS g FROM {customer}),
b AS (SELECT s_suppkey * 3 AS id, 'n' || CAST(s_suppkey % 89 AS VARCHAR) || CASE WHEN s_acctbal > 4000 THEN 'BUILDING' ELSE 'MACHINERY' END AS name, s_acctbal AS v, s_nationkey AS g FROM {supplier}),
m1 AS (SELECT id, id AS match_id, 'id' AS method FROM a WHERE id IN (SELECT id FROM b)),
r1 AS (SELECT * FROM a WHERE id NOT IN (SELECT id FROM b)),
m2 AS (SELECT r1.id, b.id AS match_id, 'name' AS method FROM r1 JOIN b USING (name)),
r2 AS (SELECT * FROM r1 WHERE id NOT IN (SELECT id FROM m2)),
b2 AS (SELECT * FROM b WHERE id NOT IN (SELECT match_id FROM m1) AND id NOT IN (SELECT match_id FROM m2)),
m3 AS (SELECT id, match_id, method FROM (SELECT r2.id, b2.id AS match_id, 'nearest' AS method,
  row_number() OVER (PARTITION BY r2.id ORDER BY abs(r2.v - b2.v), b2.id) AS rn FROM r2 JOIN b2 USING (g)) WHERE rn = 1)
SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3""")
def _(t):
    a = t.customer.select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("n"), (F.col("c_custkey") % 97).cast("string"), F.col("c_mktsegment")).alias("name"),
        F.col("c_acctbal").alias("v"), F.col("c_nationkey").alias("g"),
    )
    kind = F.when(F.col("s_acctbal") > 4000, "BUILDING").otherwise("MACHINERY")
    b = t.supplier.select(
        (F.col("s_suppkey") * 3).alias("id"), F.concat(F.lit("n"), (F.col("s_suppkey") % 89).cast("string"), kind).alias("name"),
        F.col("s_acctbal").alias("v"), F.col("s_nationkey").alias("g"),
    )
    return joins.cascade_match(a, b, "id", "name", "v", "g")


@query("semi_anti_coverage", """
WITH c AS (SELECT c_custkey AS k FROM {customer}), o AS (SELECT DISTINCT o_custkey AS k FROM {orders} WHERE year(o_orderdate) = 1998)
SELECT k, 'with' AS side FROM c WHERE k IN (SELECT k FROM o) UNION ALL
SELECT k, 'left' FROM c WHERE k NOT IN (SELECT k FROM o) UNION ALL
SELECT k, 'right' FROM o WHERE k NOT IN (SELECT k FROM c)""")
def _(t):
    c = t.customer.select(F.col("c_custkey").alias("k"))
    o = t.orders.where(order_year() == 1998).select(F.col("o_custkey").alias("k"))
    return joins.in_both(c, o, ["k"]).withColumn("side", F.lit("with")).unionByName(joins.key_difference(c, o, ["k"]))


@query("update_join_enrich", """
WITH o AS (SELECT o_custkey AS k, sum(CASE WHEN year(o_orderdate) = 1998 THEN o_totalprice END) AS a98,
  sum(CASE WHEN year(o_orderdate) = 1999 THEN o_totalprice END) AS a99,
  sum(CASE WHEN year(o_orderdate) = 1998 AND month(o_orderdate) IN (6,7,8) THEN o_totalprice END) AS s98,
  sum(CASE WHEN year(o_orderdate) = 1999 AND month(o_orderdate) IN (6,7,8) THEN o_totalprice END) AS s99
  FROM {orders} GROUP BY 1),
p AS (SELECT o_custkey AS k, max(o_totalprice) AS top FROM {orders} WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT c_custkey AS k, round(a98, 2) AS a98, round(a99, 2) AS a99, round(s98, 2) AS s98, round(s99, 2) AS s99, top
FROM {customer} LEFT JOIN o ON c_custkey = o.k LEFT JOIN p ON c_custkey = p.k""")
def _(t):
    summer = F.month("o_orderdate").isin(6, 7, 8)
    price = F.col("o_totalprice")
    yearly = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(
        *[F.round(F.sum(F.when(order_year() == y, price)), 2).alias(f"a{y % 100}") for y in (1998, 1999)],
        *[F.round(F.sum(F.when((order_year() == y) & summer, price)), 2).alias(f"s{y % 100}") for y in (1998, 1999)],
    )
    top = t.orders.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("top"))
    return joins.enrich(t.customer.select(F.col("c_custkey").alias("k")), [yearly, top], "k")


@query("filtered_means", """
SELECT user_id, round(avg(value), 6) AS mean_all, round(avg(CASE WHEN value > 50 THEN value END), 6) AS mean_large,
  round(avg(CASE WHEN event_type = 'click' AND value > 50 THEN value END), 6) AS mean_click
FROM {events} GROUP BY user_id""")
def _(t):
    big = F.col("value") > 50
    return t.events.groupBy("user_id").agg(
        F.round(F.avg("value"), 6).alias("mean_all"), F.round(F.avg(F.when(big, F.col("value"))), 6).alias("mean_large"),
        F.round(F.avg(F.when(big & (F.col("event_type") == "click"), F.col("value"))), 6).alias("mean_click"),
    )


@query("group_sums_null_keys", """
WITH d AS (SELECT CASE WHEN l_tax > 0.02 THEN l_returnflag END AS flag, CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_quantity END AS qty FROM {lineitem})
SELECT flag, coalesce(sum(qty), 0) AS qty FROM d WHERE flag IS NOT NULL GROUP BY flag""")
def _(t):
    df = t.lineitem.select(
        F.when(F.col("l_tax") > 0.02, F.col("l_returnflag")).alias("flag"),
        F.when(F.col("l_returnflag") != "A", F.col("l_quantity")).alias("q"),
    )
    return measures.group_sums(df, ["flag"], qty="q")


@query("conditional_pivot", """
SELECT c_nationkey, round(sum(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal ELSE 0 END) * 2, 4) AS building,
  round(sum(CASE WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal ELSE 0 END) * 2, 4) AS machinery,
  round(sum(CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_acctbal ELSE 0 END) * 2, 4) AS total
FROM {customer} GROUP BY 1""")
def _(t):
    out = reshape.conditional_pivot(
        t.customer, ["c_nationkey"], "c_mktsegment", {"BUILDING": "building", "MACHINERY": "machinery"}, "c_acctbal", 2.0, "total"
    )
    return out.withColumns({c: F.round(c, 4) for c in ("building", "machinery", "total")})


@query("pollutant_pivot", """
SELECT s_nationkey, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS "A",
  sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS "N", sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS "R"
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey GROUP BY 1""")
def _(t):
    by_supplier = measures.group_sums(t.lineitem, ["l_suppkey", "l_returnflag"], qty="l_quantity")
    named = joins.lookup(by_supplier, t.supplier, {"l_suppkey": "s_suppkey"}, ["s_nationkey"], "inner")
    return reshape.pivot_unique(
        measures.group_sums(named, ["s_nationkey", "l_returnflag"], qty="qty"), ["s_nationkey"], "l_returnflag", ["A", "N", "R"], "qty"
    )


@query("grouping_two_grain", """
WITH d AS (SELECT r_name, n_name, c_acctbal FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey)
SELECT 'region' AS grain, r_name, NULL AS n_name, round(sum(c_acctbal), 4) AS bal FROM d GROUP BY r_name UNION ALL
SELECT 'nation', r_name, n_name, round(sum(c_acctbal), 4) FROM d GROUP BY r_name, n_name""")
def _(t):
    df = joins.lookup(t.customer, t.nation, {"c_nationkey": "n_nationkey"}, ["n_name", "n_regionkey"])
    df = joins.lookup(df, t.region, {"n_regionkey": "r_regionkey"}, ["r_name"])
    coarse, fine = reshape.two_grain(df, ["r_name", "n_name"], ["r_name"], {"bal": "c_acctbal"})
    out = coarse.withColumn("grain", F.lit("region")).unionByName(fine.withColumn("grain", F.lit("nation")), allowMissingColumns=True)
    return out.withColumn("bal", F.round("bal", 4)).select("grain", "r_name", "n_name", "bal")


@query("unpivot_measures", """
WITH w AS (SELECT l_suppkey, sum(l_quantity) AS qty, sum(CASE WHEN l_tax > 0.07 AND l_discount > 0.09 AND l_quantity > 45 THEN l_quantity END) AS rare,
  CAST(count(*) AS DOUBLE) AS lines FROM {lineitem} GROUP BY 1)
SELECT l_suppkey, 'qty' AS measure, qty AS amount FROM w WHERE qty IS NOT NULL UNION ALL
SELECT l_suppkey, 'rare', rare FROM w WHERE rare IS NOT NULL UNION ALL SELECT l_suppkey, 'lines', lines FROM w""")
def _(t):
    rare = (F.col("l_tax") > 0.07) & (F.col("l_discount") > 0.09) & (F.col("l_quantity") > 45)
    wide = t.lineitem.groupBy("l_suppkey").agg(
        F.sum("l_quantity").alias("qty"), F.sum(F.when(rare, F.col("l_quantity"))).alias("rare"), F.count(F.lit(1)).cast("double").alias("lines")
    )
    return reshape.unpivot(wide, ["l_suppkey"], ["qty", "rare", "lines"], "measure", "amount")


@query("first_non_null_agg", """
WITH d AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS pri,
  CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS price FROM {orders})
SELECT o_custkey, arg_min(pri, o_orderkey) FILTER (WHERE pri IS NOT NULL) AS pri,
  arg_min(price, o_orderkey) FILTER (WHERE price IS NOT NULL) AS price FROM d GROUP BY o_custkey""")
def _(t):
    df = t.orders.select(
        "o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("pri"),
        F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("price"),
    )
    return measures.first_known(df, ["o_custkey"], ["o_orderkey"], ["pri", "price"])


@query("arbitrary_row", """
SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus, arg_min(o_totalprice, o_orderkey) AS o_totalprice
FROM {orders} GROUP BY o_custkey""")
def _(t):
    return measures.any_row(t.orders, ["o_custkey"], ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


@query("set_aggregate", """
SELECT l_suppkey, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY 1""")
def _(t):
    df = joins.lookup(t.lineitem, t.part, {"l_partkey": "p_partkey"}, ["p_type"], "inner")
    return measures.distinct_values(df, ["l_suppkey"], "p_type", "types").withColumn("types", F.array_join("types", ","))


@query("dedup_keep_first", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM {orders}) WHERE rn = 1""")
def _(t):
    return ranking.first_per_group(t.orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select(
        "o_custkey", "o_orderkey", "o_totalprice"
    )


@query("duplicate_split", """
WITH d AS (SELECT l_orderkey, l_linenumber, l_extendedprice, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM {lineitem})
SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN n = 1 THEN 'single' ELSE 'repeated' END AS kind FROM d""")
def _(t):
    one, many = measures.split_duplicates(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_orderkey", "l_linenumber"])
    return one.withColumn("kind", F.lit("single")).unionByName(many.withColumn("kind", F.lit("repeated")))


@query("duplicated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM {lineitem} GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return measures.duplicated_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("distinct_projection", "SELECT DISTINCT p_brand, p_type FROM {part}")
def _(t):
    return t.part.select("p_brand", "p_type").distinct()


@query("value_counts", "SELECT o_orderpriority, count(*) AS n FROM {orders} GROUP BY 1")
def _(t):
    return measures.value_counts(t.orders, "o_orderpriority", "n")


@query("quantile_minmax", """
SELECT round(quantile_cont(o_totalprice, 0.95), 4) AS p95, min(o_totalprice) AS low, max(o_totalprice) AS high,
  round(sum(o_totalprice), 2) AS total, count(DISTINCT o_custkey) AS customers FROM {orders}""")
def _(t):
    p95 = ranking.exact_quantile(t.orders, "o_totalprice", 0.95, "p95")
    return with_scalars(t.orders.agg(
        F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.round(F.sum("o_totalprice"), 2).alias("total"),
        F.count_distinct("o_custkey").alias("customers"),
    ), p95).withColumn("p95", F.round("p95", 4))


@query("ratio_group", """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, round(l_quantity / sum(l_quantity) OVER (PARTITION BY l_suppkey), 10) AS share FROM {lineitem}""")
def _(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return measures.share_of_group(lines, ["l_suppkey"], "l_quantity", "share").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.round("share", 10).alias("share")
    )


@query("ratio_global", """
SELECT p_brand, round(sum(l_quantity) / (SELECT sum(l_quantity) FROM {lineitem}), 8) AS share
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY 1""")
def _(t):
    df = joins.lookup(t.lineitem, t.part, {"l_partkey": "p_partkey"}, ["p_brand"], "inner")
    sums = measures.group_sums(df, ["p_brand"], qty="l_quantity")
    return measures.share_of_total(sums, "qty", "share").select("p_brand", F.round("share", 8).alias("share"))


@query("group_count_min", """
SELECT o_orderkey, count(o_orderkey) OVER (PARTITION BY o_custkey) AS n, min(o_totalprice) OVER (PARTITION BY o_custkey) AS low FROM {orders}""")
def _(t):
    df = measures.group_count(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], "o_orderkey", "n")
    return measures.group_min(df, ["o_custkey"], "o_totalprice", "low").select("o_orderkey", "n", "low")


@query("renormalise_after_drop", """
WITH q AS (SELECT l_suppkey, p_type, sum(l_quantity) AS ops FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY 1, 2),
s AS (SELECT *, ops / sum(ops) OVER (PARTITION BY l_suppkey) AS share, sum(ops) OVER (PARTITION BY l_suppkey) AS annual FROM q),
k AS (SELECT *, sum(share) OVER (PARTITION BY l_suppkey) AS left_share FROM s WHERE p_type <> 'PROMO')
SELECT l_suppkey, p_type, round(share / left_share, 8) AS fleetmix, round(share / left_share * annual, 4) AS ops FROM k""")
def _(t):
    df = joins.lookup(t.lineitem, t.part, {"l_partkey": "p_partkey"}, ["p_type"], "inner")
    q = measures.group_sums(df, ["l_suppkey", "p_type"], qty="l_quantity")
    shares = measures.share_of_aggregate(q, ["l_suppkey"], "qty", "fleetmix", "annual")
    out = measures.reshare(shares.where("p_type <> 'PROMO'"), ["l_suppkey"], "fleetmix", "annual", "ops")
    return out.select("l_suppkey", "p_type", F.round("fleetmix", 8).alias("fleetmix"), F.round("ops", 4).alias("ops"))


@query("redistribute_lost", """
WITH q AS (SELECT l_suppkey, p_type, sum(l_quantity) AS ops FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY 1, 2),
s AS (SELECT *, ops / sum(ops) OVER (PARTITION BY l_suppkey) AS share,
  coalesce(sum(CASE WHEN p_type = 'PROMO' THEN ops END) OVER (PARTITION BY l_suppkey), 0) AS lost FROM q),
k AS (SELECT *, share * lost + ops AS adj FROM s WHERE p_type <> 'PROMO')
SELECT l_suppkey, p_type, round(adj, 6) AS ops_fleet_adj, round(adj / sum(adj) OVER (PARTITION BY l_suppkey), 8) AS fleetmix_adj FROM k""")
def _(t):
    df = joins.lookup(t.lineitem, t.part, {"l_partkey": "p_partkey"}, ["p_type"], "inner")
    q = measures.group_sums(df, ["l_suppkey", "p_type"], ops="l_quantity")
    shares = measures.share_of_aggregate(q, ["l_suppkey"], "ops", "share", "annual")
    out = measures.redistribute(shares, ["l_suppkey"], F.col("p_type") != "PROMO", "share", "ops")
    return out.select("l_suppkey", "p_type", F.round("ops_fleet_adj", 6).alias("ops_fleet_adj"), F.round("fleetmix_adj", 8).alias("fleetmix_adj"))


@query("topk_per_group", """
SELECT c_nationkey, o_orderkey, o_totalprice, CAST(rn AS INT) AS rank FROM (SELECT c_nationkey, o_orderkey, o_totalprice,
  row_number() OVER (PARTITION BY c_nationkey ORDER BY o_totalprice DESC, o_orderkey) AS rn
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey) WHERE rn <= 3""")
def _(t):
    df = joins.lookup(t.orders, t.customer, {"o_custkey": "c_custkey"}, ["c_nationkey"], "inner")
    return ranking.top_k_per_group(df, ["c_nationkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3).select(
        "c_nationkey", "o_orderkey", "o_totalprice", "rank"
    )


@query("ties_at_extreme", """
SELECT p_brand, p_partkey, p_type FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_type DESC) AS r FROM {part}) WHERE r = 1""")
def _(t):
    return ranking.tied_at_extreme(t.part.select("p_brand", "p_partkey", "p_type"), ["p_brand"], "p_type")


@query("row_numbers", """
SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS row_no FROM {orders}""")
def _(t):
    return ranking.numbered(
        t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice"), ["o_orderpriority"], [("o_totalprice", False), ("o_orderkey", True)]
    ).select("o_orderkey", "row_no")


@query("half_even_split", """
WITH u AS (SELECT l_suppkey, l_partkey, sum(l_quantity) AS ops FROM {lineitem} GROUP BY 1, 2),
s AS (SELECT *, unnest(['A', 'D']) AS op_type FROM u), l AS (SELECT *, CAST(round_even(ops / 2, 0) AS DOUBLE) AS ltos FROM s)
SELECT l_suppkey, l_partkey, op_type, ltos, CAST(ceil(row_number() OVER (PARTITION BY l_suppkey ORDER BY ltos DESC, l_partkey, op_type) / 2) AS INT) AS ids FROM l""")
def _(t):
    units = measures.group_sums(t.lineitem, ["l_suppkey", "l_partkey"], ops="l_quantity")
    moves = units.select("l_suppkey", "l_partkey", F.bround(F.col("ops") / 2, 0).alias("ltos"), F.explode(F.array(F.lit("A"), F.lit("D"))).alias("op_type"))
    return ranking.pair_ids(moves, ["l_suppkey"], [("ltos", False), ("l_partkey", True), ("op_type", True)])


@query("base_year_factor", """
WITH y AS (SELECT o_custkey, CAST(year(o_orderdate) AS INT) AS yr, count(*) AS n FROM {orders} GROUP BY 1, 2)
SELECT o_custkey, yr, round(n / nullif(max(CASE WHEN yr = 1998 THEN n END) OVER (PARTITION BY o_custkey), 0), 8) AS factor FROM y""")
def _(t):
    y = t.orders.groupBy("o_custkey", order_year().alias("yr")).agg(F.count(F.lit(1)).alias("n"))
    based = joins.with_base_period(y, ["o_custkey"], "yr", 1998, {"n": "base"})
    return based.select("o_custkey", "yr", F.round(ratio("n", "base"), 8).alias("factor"))


@query("extend_series", """
WITH y AS (SELECT c_nationkey, CAST(year(o_orderdate) AS INT) AS yr, count(*) AS n FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT c_nationkey, yr, n FROM y UNION ALL SELECT c_nationkey, yr + CAST(d AS INT), n FROM y, generate_series(1, 5) g(d) WHERE yr = 2001""")
def _(t):
    df = joins.lookup(t.orders, t.customer, {"o_custkey": "c_custkey"}, ["c_nationkey"], "inner")
    y = df.groupBy("c_nationkey", order_year().alias("yr")).agg(F.count(F.lit(1)).alias("n"))
    return reshape.extend_series(y, "c_nationkey", "yr", 2001, 2006).select("c_nationkey", "yr", "n")


@query("gap_fill", """
WITH y AS (SELECT o_custkey, CAST(year(o_orderdate) AS INT) AS yr, CAST(count(*) AS DOUBLE) AS v FROM {orders} GROUP BY 1, 2),
g AS (SELECT o_custkey, CAST(d AS INT) AS yr FROM (SELECT DISTINCT o_custkey FROM y), generate_series(1995, 2001) s(d))
SELECT g.o_custkey, g.yr, coalesce(v, 1) AS v FROM g LEFT JOIN y USING (o_custkey, yr)""")
def _(t):
    y = t.orders.groupBy("o_custkey", order_year().alias("yr")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    return reshape.fill_gaps(y, ["o_custkey"], "yr", 1995, 2001, "v", 1.0)


@query("national_series_cross", """
WITH s AS (SELECT CAST(year(o_orderdate) AS INT) AS yr, count(*) AS n FROM {orders} GROUP BY 1)
SELECT c_custkey, yr, n FROM {customer}, s WHERE yr BETWEEN 1996 AND 2000""")
def _(t):
    s = t.orders.groupBy(order_year().alias("yr")).agg(F.count(F.lit(1)).alias("n"))
    return reshape.with_series(t.customer.select("c_custkey"), s, 1996, 2000, "yr").select("c_custkey", "yr", "n")


@query("override_coalesce", """
WITH o AS (SELECT o_custkey AS c_custkey, max(o_totalprice) AS seen FROM {orders} WHERE year(o_orderdate) = 1998 GROUP BY 1)
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN coalesce(seen, c_acctbal) ELSE c_acctbal END AS v FROM {customer} LEFT JOIN o USING (c_custkey)""")
def _(t):
    seen = t.orders.where(order_year() == 1998).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("seen"))
    df = joins.lookup(t.customer, seen, ["c_custkey"])
    return df.select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", F.coalesce("seen", "c_acctbal")).otherwise(F.col("c_acctbal")).alias("v"))


@query("clone_rows", """
SELECT c_custkey, c_mktsegment FROM {customer} UNION ALL SELECT c_custkey, 'CLONED' FROM {customer} WHERE c_nationkey = 7""")
def _(t):
    return donors.clone_rows(t.customer.select("c_custkey", "c_mktsegment", "c_nationkey"), F.col("c_nationkey") == 7, {"c_mktsegment": "CLONED"}).drop("c_nationkey")


NEEDY_SQL = """WITH d AS (SELECT DISTINCT o_custkey FROM {orders} WHERE year(o_orderdate) = 1998),
needy AS (SELECT * FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM d)),
donor AS (SELECT * FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM d))"""


def _needy_and_donors(t):
    active = t.orders.where(order_year() == 1998).select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(active, "c_custkey", "left_anti"), t.customer.join(active, "c_custkey", "left_semi")


@query("nearest_donor", NEEDY_SQL + """
SELECT c_custkey, donor_id, round(gap, 4) AS ops_diff FROM (SELECT n.c_custkey, d.c_custkey AS donor_id, abs(n.c_acctbal - d.c_acctbal) AS gap,
  row_number() OVER (PARTITION BY n.c_custkey ORDER BY abs(n.c_acctbal - d.c_acctbal), d.c_custkey) AS rn
  FROM needy n LEFT JOIN donor d ON n.c_nationkey = d.c_nationkey) WHERE rn = 1""")
def _(t):
    needy, have = _needy_and_donors(t)
    return donors.nearest_value(needy, have, "c_nationkey", "c_acctbal", "c_custkey").select(
        "c_custkey", "donor_id", F.round("ops_diff", 4).alias("ops_diff")
    )


@query("min_donor", NEEDY_SQL + """,
best AS (SELECT c_custkey AS donor_id FROM donor ORDER BY c_acctbal, c_custkey LIMIT 1),
rows AS (SELECT o_custkey AS donor_id, o_orderpriority, count(*) AS n FROM {orders} GROUP BY 1, 2)
SELECT needy.c_custkey, donor_id, o_orderpriority, n FROM needy, best JOIN rows USING (donor_id)""")
def _(t):
    needy, have = _needy_and_donors(t)
    rows = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    found = donors.lowest_donor(needy.select("c_custkey"), have, "c_custkey", "c_acctbal")
    return donors.copy_donor_rows(found, rows, "o_custkey", ["o_orderpriority", "n"])


@query("constant_mix", """
SELECT c_custkey, f AS aircraft_id, round(CAST(1.0 AS DOUBLE) / 3, 8) AS fleetmix FROM {customer}, (SELECT unnest(['h1', 'h2', 'h3']) AS f) WHERE c_acctbal < 0""")
def _(t):
    mix = [{"aircraft_id": h} for h in ("h1", "h2", "h3")]
    return donors.constant_mix(t.customer.where("c_acctbal < 0").select("c_custkey"), mix).withColumn("fleetmix", F.round("fleetmix", 8))


@query("rate_weighted_totals", """
SELECT l_suppkey, round(sum(l_tax * l_quantity), 4) AS tax, round(sum(l_discount * l_quantity), 4) AS discount,
  sum(l_quantity) AS qty, round(sum(l_tax * l_quantity) / nullif(sum(l_quantity), 0), 8) AS intensity FROM {lineitem} GROUP BY 1""")
def _(t):
    w = measures.weighted_totals(t.lineitem.withColumn("one", F.lit(1.0)), ["l_suppkey"], {"tax": "l_tax", "discount": "l_discount", "qty": "one"}, "l_quantity")
    out = measures.intensity(w, "tax", "qty", "intensity")
    return out.select("l_suppkey", F.round("tax", 4).alias("tax"), F.round("discount", 4).alias("discount"), "qty", F.round("intensity", 8).alias("intensity"))


@query("dedup_measure_sum", """
SELECT l_suppkey, coalesce(sum(l_quantity), 0) AS ltos FROM {lineitem} WHERE l_returnflag = 'A' AND l_linestatus = 'F' GROUP BY 1""")
def _(t):
    one = (F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F")
    return measures.sliced_sum(t.lineitem, ["l_suppkey"], one, "l_quantity", "ltos")


@query("unit_sum", """
SELECT l_suppkey, sum(q) AS qty FROM (SELECT l_suppkey, l_partkey, arg_min(l_quantity, (l_orderkey, l_linenumber, l_extendedprice, l_quantity)) AS q FROM {lineitem} GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")]
    return measures.unit_sum(t.lineitem, ["l_suppkey"], ["l_suppkey", "l_partkey"], order, "l_quantity", "qty")


@query("rounding_correction", """
WITH q AS (SELECT l_suppkey, l_partkey, round(sum(l_quantity) / 10, 0) AS part, FROM {lineitem} GROUP BY 1, 2),
a AS (SELECT l_suppkey, sum(l_quantity) / 10 AS annual FROM {lineitem} GROUP BY 1)
SELECT l_suppkey, l_partkey, round(part * annual / nullif(sum(part) OVER (PARTITION BY l_suppkey), 0), 6) AS scaled FROM q JOIN a USING (l_suppkey)""")
def _(t):
    q = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.round(F.sum("l_quantity") / 10, 0).alias("part"))
    a = t.lineitem.groupBy("l_suppkey").agg((F.sum("l_quantity") / 10).alias("annual"))
    out = measures.scale_to_total(joins.lookup(q, a, ["l_suppkey"]), ["l_suppkey"], "part", "annual", "scaled")
    return out.select("l_suppkey", "l_partkey", F.round("scaled", 6).alias("scaled"))


@query("custom_order_rank", """
SELECT o_orderkey, CAST(list_position(['2-HIGH', '1-URGENT', '5-LOW'], o_orderpriority) AS INT) AS place FROM {orders}""")
def _(t):
    return t.orders.select("o_orderkey", ranking.category_rank("o_orderpriority", ["2-HIGH", "1-URGENT", "5-LOW"]).alias("place"))


@query("sorted_head", """
SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def _(t):
    return ranking.sort_by(t.orders.select("o_orderkey", "o_totalprice"), o_totalprice=False, o_orderkey=True).limit(10)


@query("set_ops", """
SELECT 'both' AS kind, k FROM (SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}) UNION ALL
SELECT 'any', k FROM (SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}) UNION ALL
SELECT 'less', k FROM (SELECT n_nationkey AS k FROM {nation} WHERE n_regionkey < 3 EXCEPT SELECT s_nationkey FROM {supplier} WHERE s_acctbal < 5000)""")
def _(t):
    c, s = t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"), "s_acctbal")
    n = t.nation.where("n_regionkey < 3").select(F.col("n_nationkey").alias("k"))
    tag = lambda df, v: df.withColumn("kind", F.lit(v))
    return (
        tag(c.intersect(s.select("k")), "both").unionByName(tag(c.unionByName(s.select("k")).distinct(), "any"))
        .unionByName(tag(n.exceptAll(s.where("s_acctbal < 5000").select("k").distinct()), "less"))
    )


@query("union_by_name", """
SELECT c_name AS name, c_acctbal AS bal, c_mktsegment AS seg FROM {customer} UNION ALL SELECT s_name, s_acctbal, NULL FROM {supplier}""")
def _(t):
    a = t.customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    return a.unionByName(t.supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal")), allowMissingColumns=True)


@query("partition_transform_union", """
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal * 2 WHEN c_mktsegment = 'MACHINERY' THEN 0.0 ELSE c_acctbal END AS v FROM {customer}""")
def _(t):
    seg = F.col("c_mktsegment")
    rest = t.customer.where(~seg.isin("BUILDING", "MACHINERY")).select("c_custkey", F.col("c_acctbal").alias("v"))
    a = t.customer.where(seg == "BUILDING").select("c_custkey", (F.col("c_acctbal") * 2).alias("v"))
    return rest.unionByName(a).unionByName(t.customer.where(seg == "MACHINERY").select("c_custkey", F.lit(0.0).alias("v")))


@query("knn_distance", """
WITH p AS (SELECT facility_id, match_id, 2 * 3958.7613 * asin(sqrt(least(1.0, power(sin(radians(s.lat - f.lat) / 2), 2) +
  cos(radians(f.lat)) * cos(radians(s.lat)) * power(sin(radians(s.lon - f.lon) / 2), 2)))) AS d FROM {points} f, {sites} s)
SELECT facility_id, match_id, round(d, 4) AS dist_mi, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY facility_id ORDER BY d, match_id) AS rn FROM p) WHERE rn <= 3""")
def _(t):
    return geo.k_nearest(t.points, t.sites, "facility_id", "match_id", 3).withColumn("dist_mi", F.round("dist_mi", 4))


POLYGON_SQL = """WITH v AS (SELECT *, row_number() OVER r AS i, count(*) OVER (PARTITION BY poly_id, ring) AS n FROM {rings} WINDOW r AS (PARTITION BY poly_id, ring ORDER BY seq)),
e AS (SELECT a.poly_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM v a JOIN v b ON a.poly_id = b.poly_id AND a.ring = b.ring AND b.i = a.i % a.n + 1),
hits AS (SELECT facility_id, poly_id FROM {points}, e GROUP BY facility_id, poly_id
  HAVING sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) * ((x2 - x1) / nullif(y2 - y1, 0)) THEN 1 ELSE 0 END) % 2 = 1
  OR max(CASE WHEN (x2 - x1) * (lat - y1) - (y2 - y1) * (lon - x1) = 0 AND lon BETWEEN least(x1, x2) AND greatest(x1, x2)
    AND lat BETWEEN least(y1, y2) AND greatest(y1, y2) THEN 1 ELSE 0 END) = 1)"""


@query("point_in_polygon", POLYGON_SQL + " SELECT facility_id, poly_id FROM hits")
def _(t):
    return geo.points_in_polygons(t.points, t.rings, "facility_id", "poly_id", cell=10.0)
