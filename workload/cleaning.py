"""Names, text, numbers, predicates."""

from pyspark.sql import functions as F

from skyledger.functions import names, numbers, rules, text
from skyledger.operators import joins, measures, ranking
from skyledger.sources import readers, writers
import workload.roles  # noqa: F401
from workload.registry import query


@query("snake_case_clean", """
SELECT p_partkey AS part_key, replace(lower(trim(p_name)), '''', '') AS part_name,
  replace(lower(trim(p_brand)), '''', '') AS y2019_brand
FROM {part}""")
def _(t):
    raw = t.part.select(
        F.col("p_partkey").alias("PartKey"), F.col("p_name").alias("Part-Name"), F.col("p_brand").alias("2019 Brand")
    )
    df = names.prefix_digit_columns(names.snake_columns(raw))
    return df.withColumns({c: text.clean_key(c) for c in ("part_name", "y2019_brand")})


@query("rename_project", """
SELECT c_custkey AS "Facility", c_name AS "Facility Name", c_acctbal AS "Annual Operations" FROM {customer}""")
def _(t):
    df = names.rename(t.customer, {"c_custkey": "facility_id", "c_name": "facility_name", "c_acctbal": "annual_operations"})
    return names.title_columns(names.select_existing(df, ["facility_id", "facility_name", "no_such_column", "annual_operations"]))


@query("regex_repair", """
SELECT p_partkey, regexp_replace(p_brand, '#', '-', 'g') AS brand,
  CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT) AS brand_no,
  CASE WHEN p_name LIKE '%ring%' THEN '-999' ELSE replace(p_name, 'small', 'tiny') END AS repaired,
  NOT regexp_matches(p_name, '[^a-z ]') AS plain
FROM {part}""")
def _(t):
    return t.part.select(
        "p_partkey", F.regexp_replace("p_brand", "#", "-").alias("brand"), text.digits("p_brand").alias("brand_no"),
        text.repair_text("p_name", {"small": "tiny"}, ["ring"]).alias("repaired"),
        text.is_plain("p_name", "a-z ").alias("plain"),
    )


@query("repair_ids", """
SELECT c_custkey, CASE lower(c_nationkey || 'e' || (c_custkey % 8)) WHEN '1e4' THEN '10000' WHEN '1e2' THEN '100'
  WHEN '1e7' THEN '10000000' WHEN '2e5' THEN '200000' WHEN '2e7' THEN '20000000' WHEN '3e0' THEN '3'
  ELSE lower(c_nationkey || 'e' || (c_custkey % 8)) END AS fixed
FROM {customer}""")
def _(t):
    raw = F.concat(F.lit("'"), F.col("c_nationkey").cast("string"), F.lit("E"), (F.col("c_custkey") % 8).cast("string"))
    return t.customer.select("c_custkey", text.repair_ids(text.clean_key(raw)).alias("fixed"))


@query("right_split", """
SELECT p_partkey, p_brand || '/' || p_type AS head, p_name AS tail,
  replace(p_brand, '#', '') || '_' || CAST(p_size AS VARCHAR) AS pair_key
FROM {part}""")
def _(t):
    df = t.part.withColumn("path", text.joined("p_brand", "p_type", "p_name", sep="/"))
    head, tail = text.right_split("path", "/")
    return df.select(
        "p_partkey", head.alias("head"), tail.alias("tail"),
        text.joined(F.replace("p_brand", F.lit("#"), F.lit("")), "p_size", sep="_").alias("pair_key"),
    )


@query("split_delimited", """
SELECT o_orderkey, CAST(split_part(o_orderpriority, '-', 1) AS INT) AS rank_no,
  split_part(o_orderpriority, '-', -1) AS label, right(o_orderpriority, 1) AS last_sign,
  CASE WHEN right(o_orderpriority, 1) = 'H' THEN 1 ELSE -1 END AS sign_no
FROM {orders}""")
def _(t):
    df = t.orders.withColumn("last_sign", F.right("o_orderpriority", F.lit(1)))
    return df.select(
        "o_orderkey", text.part("o_orderpriority", "-", 1).cast("int").alias("rank_no"),
        text.part("o_orderpriority", "-", -1).alias("label"), "last_sign",
        rules.sign_of("last_sign", "H").alias("sign_no"),
    )


@query("dms_to_decimal", """
SELECT s_suppkey, round(CASE WHEN s_nationkey < 12 THEN 1.0 ELSE -1.0 END *
  (CAST(20 + s_nationkey AS DOUBLE) + CAST(s_suppkey % 60 AS DOUBLE) / 60 + CAST(s_suppkey % 50 AS DOUBLE) / 3600), 6) AS latitude
FROM {supplier}""")
def _(t):
    number = lambda c: c.cast("string")
    dms = F.concat_ws(
        "-", number(F.col("s_nationkey") + 20), number(F.col("s_suppkey") % 60),
        F.concat(number(F.col("s_suppkey") % 50), F.lit(".0"), F.when(F.col("s_nationkey") < 12, "N").otherwise("S")),
    )
    return t.supplier.select("s_suppkey", F.round(text.degrees(dms), 6).alias("latitude"))


@query("safe_cast_sum", """
SELECT c_custkey, try_cast(CASE WHEN substr(c_name, 10) = '000000007' THEN '-' ELSE substr(c_name, 10) END AS DOUBLE) AS plain_number,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0 ELSE try_cast(substr(c_name, 10) AS DOUBLE) END AS number,
  round(coalesce(try_cast(c_mktsegment AS DOUBLE), 0) + coalesce(c_acctbal, 0), 4) AS total
FROM {customer}""")
def _(t):
    tail = F.expr("substring(c_name, 10)")
    marked = F.when(F.col("c_mktsegment") == "BUILDING", " - ").otherwise(tail)
    return t.customer.select(
        "c_custkey",
        numbers.to_number(F.when(tail == "000000007", "-").otherwise(tail), zeros=()).alias("plain_number"),
        numbers.to_number(marked).alias("number"),
        F.round(numbers.sum_of(F.col("c_mktsegment").try_cast("double"), "c_acctbal"), 4).alias("total"),
    )


@query("recode_values", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'PM25-PRI' WHEN '2-HIGH' THEN 'PM10-PRI'
    ELSE o_orderpriority END AS code,
  CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'small' END AS size_label,
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' END AS state
FROM {orders}""")
def _(t):
    price = F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey", text.recode("o_orderpriority", {"1-URGENT": "PM25-PRI", "2-HIGH": "PM10-PRI"}).alias("code"),
        rules.first_rule([(price > 300000, "large"), (price > 100000, "middle")], "small").alias("size_label"),
        text.recode_or_null("o_orderstatus", {"F": "done", "O": "open"}).alias("state"),
    )


@query("title_case", """
SELECT p_partkey, upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' ||
  upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS title,
  split_part(p_name, ' ', 1) AS first_token, CAST(2 AS INT) AS n_tokens
FROM {part}""")
def _(t):
    words = text.tokens(F.upper("p_name"))
    return t.part.select(
        "p_partkey", text.title(F.upper("p_name")).alias("title"), words[0].alias("first_token"), F.size(words).alias("n_tokens")
    )


@query("unit_conversion", """
SELECT s_suppkey, round(s_acctbal * 0.217264143, 6) AS summer, round(s_acctbal / 365, 6) AS daily,
  round(s_acctbal * 0.000621371, 6) AS miles, CAST(round_even(s_acctbal / 2, 0) AS DOUBLE) AS half,
  coalesce(CASE WHEN s_acctbal > 0 THEN s_acctbal END, -999.0) AS filled
FROM {supplier}""")
def _(t):
    b = F.col("s_acctbal")
    return t.supplier.select(
        "s_suppkey", F.round(numbers.summer_from_annual(b), 6).alias("summer"), F.round(numbers.daily_from_annual(b), 6).alias("daily"),
        F.round(numbers.miles_from_metres(b), 6).alias("miles"), numbers.half_even(b / 2).alias("half"),
        F.coalesce(F.when(b > 0, b), F.lit(-999.0)).alias("filled"),
    )


@query("difference_tolerance", """
SELECT l_orderkey, l_linenumber, l_partkey, round(abs(l_extendedprice - l_quantity * 1000), 4) AS gap,
  round((l_extendedprice - l_quantity * 1000) * 100 / nullif(l_quantity * 1000, 0), 9) AS per_gap,
  abs(l_extendedprice - l_quantity * 1000) <= 1e-8 + 0.1 * abs(l_quantity * 1000) AS close, l_suppkey, l_extendedprice
FROM {lineitem}""")
def _(t):
    a, b = F.col("l_extendedprice"), F.col("l_quantity") * 1000
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(F.abs(a - b), 4).alias("gap"),
        F.round(numbers.percent_change(a, b), 9).alias("per_gap"), numbers.close_to(a, b, rtol=0.1).alias("close"),
        "l_suppkey", "l_extendedprice",
    )


@query("first_known_column", """
SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 5000 THEN c_mktsegment END, c_name) AS label,
  CASE WHEN c_acctbal > 5000 THEN 'segment' ELSE 'name' END AS source FROM {customer}""")
def _(t):
    df = t.customer.withColumn("seg", F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")))
    return df.select(
        "c_custkey", rules.override("c_name", "seg").alias("label"),
        F.when(F.col("seg").isNotNull(), F.lit("segment")).otherwise(F.lit("name")).alias("source"),
    )


@query("predicates", """
SELECT o_orderkey, o_orderstatus FROM {orders}
WHERE o_totalprice >= 50000 AND o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')
  AND o_orderstatus <> 'P' AND NOT (o_orderpriority LIKE '%LOW%' AND o_totalprice > 200000)
  AND o_orderpriority ILIKE '%-%'""")
def _(t):
    low = text.has("o_orderpriority", "LOW")
    return t.orders.where(
        (F.col("o_totalprice") >= 50000) & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "5-LOW")
        & rules.not_in("o_orderstatus", ["P"]) & ~(low & (F.col("o_totalprice") > 200000))
        & text.has("o_orderpriority", "-", any_case=True)
    ).select("o_orderkey", "o_orderstatus")


@query("null_predicates", """
WITH d AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS seg, c_name FROM {customer})
SELECT c_custkey, seg IS NULL AS missing, coalesce(CAST(seg = 'BUILDING' AS INT), 0) AS flag FROM d
WHERE seg IS NULL OR seg NOT IN ('HOUSEHOLD', 'FURNITURE')""")
def _(t):
    df = t.customer.withColumn("seg", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment"))).withColumn("want", F.lit("BUILDING"))
    return df.where(rules.not_in("seg", ["HOUSEHOLD", "FURNITURE"])).select(
        "c_custkey", F.col("seg").isNull().alias("missing"), rules.same_flag("seg", "want").alias("flag")
    )


@query("validity_interval", """
WITH v AS (SELECT *, o_orderdate + INTERVAL 400 DAY AS until FROM {orders}),
ok AS (SELECT * FROM v WHERE o_orderdate < TIMESTAMP '1999-01-01' AND until > TIMESTAMP '1999-01-01')
SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey FROM ok GROUP BY 1, 2""")
def _(t):
    df = t.orders.withColumn("until", F.col("o_orderdate") + F.expr("INTERVAL 400 DAY"))
    valid = df.where(rules.valid_on("1999-01-01", "o_orderdate", "until"))
    return ranking.tied_at_extreme(
        valid.select("o_custkey", "o_orderpriority", "o_orderkey"), ["o_custkey", "o_orderpriority"], "o_orderkey", largest=False
    )


@query("exclusion_list", """
SELECT p_partkey, p_brand FROM {part}
WHERE replace(p_brand, 'Brand#', '') || '_' || CAST(p_size AS VARCHAR) NOT IN ('1_1', '4_22', '10_15', '25_50')""")
def _(t):
    key = text.joined(F.replace("p_brand", F.lit("Brand#"), F.lit("")), "p_size", sep="_")
    return joins.drop_listed(t.part, key, ["1_1", "4_22", "10_15", "25_50"]).select("p_partkey", "p_brand")


@query("repair_rows", """
SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN 'closed' ELSE s_name END AS s_name FROM {supplier} WHERE NOT s_acctbal < 0""")
def _(t):
    kept = writers.drop_rows(t.supplier, F.col("s_acctbal") < 0)
    return writers.set_constant(kept, "s_name", "closed", F.col("s_nationkey") == 3).select("s_suppkey", "s_name")


@query("sql_source", """
SELECT n_name, count(*) AS n FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
WHERE n_name ILIKE '%nation_1%' GROUP BY n_name ORDER BY n DESC""")
def _(t):
    return readers.query_source(
        t.customer.sparkSession,
        "SELECT n_name, count(*) AS n FROM {c} JOIN {n} ON c_nationkey = n_nationkey "
        "WHERE n_name ILIKE '%nation_1%' GROUP BY n_name ORDER BY n DESC",
        c=t.customer, n=t.nation,
    )


@query("file_keys", """SELECT o_orderpriority, count(*) AS n, 'orders' AS source_table FROM {orders} GROUP BY o_orderpriority""")
def _(t):
    keyed = readers.with_file_keys(t.orders, {"source_table": r"^([a-z]+)\.parquet"})
    return keyed.groupBy("o_orderpriority", "source_table").agg(F.count(F.lit(1)).alias("n"))


@query("constant_lookup", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' END AS status_name FROM {orders}""")
def _(t):
    table = readers.literal_table(t.orders.sparkSession, [("F", "final"), ("O", "open")], "code string, status_name string")
    return joins.lookup(t.orders.select("o_orderkey", "o_orderstatus"), table, {"o_orderstatus": "code"}).drop("o_orderstatus")


@query("list_vocabulary", """
WITH d AS (SELECT DISTINCT other_services FROM {registry})
SELECT DISTINCT unnest(string_split(other_services, ',')) AS service FROM d""")
def _(t):
    return measures.list_vocabulary(t.registry, "other_services", ",", "service")
