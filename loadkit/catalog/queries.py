"""Catalog queries: one per operator of the inventory, each with its SQL oracle.

Every query reads whole given tables (or frames Spark derives from them)
and returns a DataFrame.  Queries that exercise a sink write to a fresh
folder under the shared directory and return what they read back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadkit.catalog import inputs as I
from loadkit.catalog.inputs import table
from loadkit.operators import checks, drift, lookups, routing, scd, transforms
from loadkit.operators.routing import ERROR_MESSAGES, ERROR_RULES
from loadkit.session import scratch_path
from loadkit.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


LINEITEM_COLS = ("l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
                 "l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate")


# =============================================================== sources
@query("incremental_extract", """
SELECT * FROM orders WHERE o_orderdate >= CAST(DATE '2001-07-30' - INTERVAL 3 DAY AS TIMESTAMP)""")
def q_incremental_extract(spark, sf):
    return readers.incremental_extract(table(spark, sf, "orders"), "o_orderdate",
                                       "2001-07-30", lookback_days=3)


@query("table_scan", """
SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1998-01-01 00:00:00'""")
def q_table_scan(spark, sf):
    df = readers.read_table(spark, f"{sf}/lineitem.parquet",
                            columns=["l_orderkey", "l_linenumber", "l_quantity", "l_shipdate"])
    return df.filter(F.col("l_shipdate") >= F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00")))


# =============================================================== projections
@query("derived_columns", """
SELECT l_orderkey, l_linenumber,
       l_extendedprice * (1 - l_discount) AS net_price,
       l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge,
       l_returnflag = 'R' AS is_returned,
       l_quantity AS l_quantity
FROM lineitem""")
def q_derived_columns(spark, sf):
    li = table(spark, sf, "lineitem")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    out = transforms.derived_columns(li, {
        "net_price": net,
        "charge": net * (1 + F.col("l_tax")),
        "is_returned": F.col("l_returnflag") == "R",
    })
    return out.select("l_orderkey", "l_linenumber", "net_price", "charge", "is_returned",
                      "l_quantity")


@query("lineage_columns", f"""
SELECT *, {I.LOAD_TS_SQL} AS load_timestamp, 'SOURCE_DB' AS source_system,
       'supplier.parquet' AS source_file
FROM supplier""")
def q_lineage_columns(spark, sf):
    out = transforms.lineage_columns(table(spark, sf, "supplier"), source_system="SOURCE_DB",
                                     load_ts=I.LOAD_TS, source_file=True)
    # The full path depends on where the tables lie; SQL knows its last part.
    return out.withColumn("source_file", F.regexp_extract("source_file", r"^file:.*/([^/]+)$", 1))


@query("date_key", """
SELECT o_orderkey, o_orderdate, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date_sk
FROM orders""")
def q_date_key(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return transforms.add_date_key(o, "o_orderdate")


@query("null_defaults", f"""
SELECT c_custkey, COALESCE(c_name, 'n/a') AS c_name, c_nationkey,
       COALESCE(c_acctbal, 0.0) AS c_acctbal, COALESCE(c_mktsegment, 'UNKNOWN') AS c_mktsegment
FROM ({I.CUSTOMER_WITH_GAPS_SQL}) g""")
def q_null_defaults(spark, sf):
    return transforms.null_defaults(I.customer_with_gaps(spark, sf), {
        "c_name": "n/a", "c_acctbal": 0.0, "c_mktsegment": "UNKNOWN"})


SK_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
            "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
            "l_shipdate"]


@query("surrogate_key", f"""
SELECT *, CAST(1000 + row_number() OVER (ORDER BY {', '.join(SK_ORDER)}) AS BIGINT) AS fact_sk
FROM lineitem""")
def q_surrogate_key(spark, sf):
    return transforms.assign_surrogate_keys(table(spark, sf, "lineitem"), "fact_sk",
                                            order_by=SK_ORDER, offset=1000)


# Strings as a flat file would carry them, with junk made by rules on every row.
PART_TEXT_SQL = """
SELECT CAST(p_partkey AS VARCHAR) AS p_partkey,
       CASE WHEN p_brand = 'Brand#3' THEN 'n/a' ELSE CAST(p_size AS VARCHAR) END AS p_size,
       CASE WHEN p_type = 'SMALL' AND p_size > 40 THEN 'abc' ELSE CAST(p_retailprice AS VARCHAR) END
         AS p_retailprice,
       CASE WHEN p_brand = 'Brand#5' THEN '2020/13/45'
            ELSE strftime(DATE '2020-01-01' + CAST(p_size * 7 AS INTEGER), '%Y/%m/%d') END
         AS avail_date
FROM part"""


def part_as_text(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("p_partkey"),
        F.when(F.col("p_brand") == "Brand#3", F.lit("n/a"))
        .otherwise(F.col("p_size").cast("string")).alias("p_size"),
        F.when((F.col("p_type") == "SMALL") & (F.col("p_size") > 40), F.lit("abc"))
        .otherwise(F.col("p_retailprice").cast("string")).alias("p_retailprice"),
        F.when(F.col("p_brand") == "Brand#5", F.lit("2020/13/45"))
        .otherwise(F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.col("p_size") * 7),
                                 "yyyy/MM/dd")).alias("avail_date"),
    )


PART_CONVERSIONS = {"p_partkey": "bigint", "p_size": "int", "p_retailprice": "double",
                    "avail_date": ("date", "yyyy/MM/dd")}


@query("type_conversions", f"""
WITH txt AS ({PART_TEXT_SQL}),
conv AS (
  SELECT TRY_CAST(p_partkey AS BIGINT) AS p_partkey, TRY_CAST(p_size AS INTEGER) AS p_size,
         TRY_CAST(p_retailprice AS DOUBLE) AS p_retailprice,
         CAST(try_strptime(avail_date, '%Y/%m/%d') AS DATE) AS avail_date,
         p_partkey AS r_partkey, p_size AS r_size, p_retailprice AS r_price, avail_date AS r_date
  FROM txt)
SELECT p_partkey, p_size, p_retailprice, avail_date,
       concat_ws('|',
         CASE WHEN r_partkey IS NOT NULL AND p_partkey IS NULL THEN 'bad_p_partkey' END,
         CASE WHEN r_size IS NOT NULL AND p_size IS NULL THEN 'bad_p_size' END,
         CASE WHEN r_price IS NOT NULL AND p_retailprice IS NULL THEN 'bad_p_retailprice' END,
         CASE WHEN r_date IS NOT NULL AND avail_date IS NULL THEN 'bad_avail_date' END)
         AS conversion_errors
FROM conv""")
def q_type_conversions(spark, sf):
    conv, rules = transforms.type_conversions(part_as_text(spark, sf), PART_CONVERSIONS)
    tagged = routing.tag_errors(conv, rules)
    return transforms.drop_raw_columns(tagged).select(
        "p_partkey", "p_size", "p_retailprice", "avail_date",
        F.array_join(ERROR_RULES, "|").alias("conversion_errors"))


# =============================================================== routing
@query("conditional_split", """
SELECT o_orderkey, o_totalprice, o_orderpriority,
       CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice >= 300000 THEN 'urgent_large'
            WHEN o_totalprice >= 300000 THEN 'large'
            WHEN o_totalprice >= 100000 THEN 'medium'
            ELSE 'small' END AS split_output
FROM orders""")
def q_conditional_split(spark, sf):
    from loadkit.session import scratch_path
    from loadkit.sinks.tables import write_split
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    price = F.col("o_totalprice")
    cases = [("urgent_large", (F.col("o_orderpriority") == "1-URGENT") & (price >= 300000)),
             ("large", price >= 300000), ("medium", price >= 100000)]
    path = scratch_path(spark, "split")
    write_split(o, cases, path, default="small")     # one pass, one folder per output
    return spark.read.parquet(path)


@query("route_errors_valid", f"""
SELECT * FROM customer WHERE NOT ({I.any_rule_sql(I.CUSTOMER_RULE_SQL)})""")
def q_route_errors_valid(spark, sf):
    valid, _ = routing.route_errors(table(spark, sf, "customer"), I.customer_rules())
    return valid


@query("route_errors_rejected", f"""
SELECT *, {I.rules_sql(I.CUSTOMER_RULE_SQL, 0)} AS error_rules,
       {I.rules_sql(I.CUSTOMER_RULE_SQL, 2)} AS error_messages
FROM customer WHERE {I.any_rule_sql(I.CUSTOMER_RULE_SQL)}""")
def q_route_errors_rejected(spark, sf):
    _, errors = routing.route_errors(table(spark, sf, "customer"), I.customer_rules())
    return errors.withColumns({ERROR_RULES: F.array_join(ERROR_RULES, "|"),
                               ERROR_MESSAGES: F.array_join(ERROR_MESSAGES, "|")})


def _threshold_sql(limit: int) -> str:
    return f"""
SELECT CAST({limit} AS BIGINT) AS error_limit, count(*) AS error_count,
       count(*) <= {limit} AS passed
FROM customer WHERE {I.any_rule_sql(I.CUSTOMER_RULE_SQL)}"""


@query("error_threshold", _threshold_sql(500))
def q_error_threshold(spark, sf):
    _, errors = routing.route_errors(table(spark, sf, "customer"), I.customer_rules())
    return routing.error_limit_status(errors, 500)


@query("fail_on_error", _threshold_sql(0))
def q_fail_on_error(spark, sf):
    _, errors = routing.route_errors(table(spark, sf, "customer"), I.customer_rules())
    return routing.error_limit_status(errors, 0)


# =============================================================== joins
@query("merge_join", """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice,
       o.o_custkey, o.o_orderdate, o.o_orderstatus,
       CAST(strftime(o.o_orderdate, '%Y%m%d') AS INTEGER) AS date_sk
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""")
def q_merge_join(spark, sf):
    detail = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    primary = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate", "o_orderstatus")
    joined = lookups.merge_join(detail, primary, on="l_orderkey")
    return transforms.add_date_key(joined, "o_orderdate")


def _supplier_lookup(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    approved = table(spark, sf, "supplier").filter(F.col("s_acctbal") >= 0)
    return lookups.lookup(li, approved, {"l_suppkey": "s_suppkey"}, ["s_name", "s_nationkey"])


@query("lookup_matched", """
SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_extendedprice, s.s_name, s.s_nationkey
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey AND s.s_acctbal >= 0""")
def q_lookup_matched(spark, sf):
    return _supplier_lookup(spark, sf)[0]


@query("lookup_unmatched", """
SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_extendedprice
FROM lineitem l WHERE NOT EXISTS
  (SELECT 1 FROM supplier s WHERE s.s_suppkey = l.l_suppkey AND s.s_acctbal >= 0)""")
def q_lookup_unmatched(spark, sf):
    return _supplier_lookup(spark, sf)[1]


@query("lookup_current_version", f"""
SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, d.customer_sk, d.c_mktsegment
FROM orders o JOIN ({I.CUSTOMER_DIM_SQL}) d
  ON o.o_custkey = d.customer_id AND d.is_current = 1""")
def q_lookup_current_version(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    matched, _ = lookups.lookup_current(o, I.customer_dim_versions(spark, sf),
                                        {"o_custkey": "customer_id"},
                                        ["customer_sk", "c_mktsegment"])
    return matched


@query("multi_dimension_lookup", """
SELECT l.l_orderkey, l.l_linenumber, p.p_brand, s.s_name, o.o_custkey, c.c_mktsegment,
       p.p_partkey IS NOT NULL AS hit_part, s.s_suppkey IS NOT NULL AS hit_supplier,
       o.o_orderkey IS NOT NULL AS hit_order, c.c_custkey IS NOT NULL AS hit_customer
FROM lineitem l
LEFT JOIN part p ON l.l_partkey = p.p_partkey
LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
LEFT JOIN customer c ON o.o_custkey = c.c_custkey""")
def q_multi_dimension_lookup(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                             "l_suppkey")
    out = lookups.multi_lookup(li, [
        {"name": "part", "dim": table(spark, sf, "part"), "on": {"l_partkey": "p_partkey"},
         "columns": ["p_brand"]},
        {"name": "supplier", "dim": table(spark, sf, "supplier"),
         "on": {"l_suppkey": "s_suppkey"}, "columns": ["s_name"]},
        {"name": "order", "dim": table(spark, sf, "orders"), "on": {"l_orderkey": "o_orderkey"},
         "columns": ["o_custkey"]},
        {"name": "customer", "dim": table(spark, sf, "customer"),
         "on": {"o_custkey": "c_custkey"}, "columns": ["c_mktsegment"]},
    ])
    return out.drop("l_partkey", "l_suppkey")


# =============================================================== sort / set
def _dedup_sql(direction: str, nulls: str) -> str:
    rest = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
            "l_tax", "l_returnflag", "l_linestatus"]
    order = ", ".join(f"{c} {direction} NULLS {nulls}" for c in rest)
    return f"""
SELECT {LINEITEM_COLS} FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {order}) = 1"""


@query("dedup_keep_last", _dedup_sql("DESC", "LAST"))
def q_dedup_keep_last(spark, sf):
    return transforms.deduplicate(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"],
                                  ["l_shipdate"], keep="last")


@query("dedup_keep_first", _dedup_sql("ASC", "FIRST"))
def q_dedup_keep_first(spark, sf):
    return transforms.deduplicate(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"],
                                  ["l_shipdate"], keep="first")


@query("union_all", """
SELECT 'customer' AS party_type, c_custkey AS party_key, c_name AS party_name,
       c_nationkey AS nation_key, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL
SELECT 'supplier', s_suppkey, s_name, s_nationkey, s_acctbal, NULL FROM supplier""")
def q_union_all(spark, sf):
    c = table(spark, sf, "customer").select(
        F.lit("customer").alias("party_type"), F.col("c_custkey").alias("party_key"),
        F.col("c_name").alias("party_name"), F.col("c_nationkey").alias("nation_key"),
        F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(
        F.lit("supplier").alias("party_type"), F.col("s_suppkey").alias("party_key"),
        F.col("s_name").alias("party_name"), F.col("s_nationkey").alias("nation_key"),
        F.col("s_acctbal").alias("balance"))
    return transforms.union_all(c, s)


# =============================================================== checks
ORDERS_EXPECTED = T.StructType([
    T.StructField("o_orderkey", T.LongType()),
    T.StructField("o_custkey", T.LongType()),
    T.StructField("o_orderstatus", T.StringType()),
    T.StructField("o_totalprice", T.DoubleType()),
    T.StructField("o_orderdate", T.TimestampNTZType()),
    T.StructField("o_orderpriority", T.IntegerType()),
    T.StructField("o_clerk", T.StringType()),
])


@query("schema_check", """
WITH o AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
         CASE WHEN o_orderpriority = '5-LOW' THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) END
           AS o_totalprice,
         o_orderdate, o_orderpriority
  FROM orders),
bad AS (
  SELECT count(*) FILTER (WHERE o_totalprice IS NOT NULL AND TRY_CAST(o_totalprice AS DOUBLE) IS NULL) AS b_price,
         count(*) FILTER (WHERE o_orderpriority IS NOT NULL AND TRY_CAST(o_orderpriority AS INTEGER) IS NULL) AS b_prio
  FROM o)
SELECT 'o_orderkey' AS column_name, 'bigint' AS expected_type, 'bigint' AS actual_type, 'ok' AS status, CAST(0 AS BIGINT) AS bad_rows
UNION ALL SELECT 'o_custkey', 'bigint', 'bigint', 'ok', 0
UNION ALL SELECT 'o_orderstatus', 'string', 'string', 'ok', 0
UNION ALL SELECT 'o_totalprice', 'double', 'string', 'type_mismatch', b_price FROM bad
UNION ALL SELECT 'o_orderdate', 'timestamp_ntz', 'timestamp_ntz', 'ok', 0
UNION ALL SELECT 'o_orderpriority', 'int', 'string', 'type_mismatch', b_prio FROM bad
UNION ALL SELECT 'o_clerk', 'string', NULL, 'missing', NULL""")
def q_schema_check(spark, sf):
    o = table(spark, sf, "orders").withColumn(
        "o_totalprice", F.when(F.col("o_orderpriority") == "5-LOW", F.lit("n/a"))
        .otherwise(F.col("o_totalprice").cast("string")))
    return checks.schema_check(o, ORDERS_EXPECTED)


@query("schema_drift_between_files", """
SELECT 'o_custkey' AS column_name, 'bigint' AS expected_type, 'string' AS file_type, 'type_differs' AS status,
       count(*) FILTER (WHERE o_orderstatus = 'O') AS n FROM orders
UNION ALL SELECT 'o_orderpriority', 'string', NULL, 'missing', count(*) FILTER (WHERE o_orderstatus = 'P') FROM orders
UNION ALL SELECT 'o_note', NULL, 'int', 'unexpected', count(*) FILTER (WHERE o_orderstatus = 'P') FROM orders""")
def q_schema_drift_between_files(spark, sf):
    o = table(spark, sf, "orders")
    folder = scratch_path(spark, "schema-drift")
    feeds = {"F": o, "O": o.withColumn("o_custkey", F.col("o_custkey").cast("string")),
             "P": o.drop("o_orderpriority").withColumn("o_note", F.lit(1))}
    for status, feed in feeds.items():
        feed.filter(F.col("o_orderstatus") == status).write.parquet(f"{folder}/{status}")
    found = drift.schema_drift(spark, [f"{folder}/{status}" for status in feeds], o.schema)
    return found.groupBy("column_name", "expected_type", "file_type", "status").agg(F.sum("file_rows").alias("n"))


@query("null_check", f"""
WITH g AS ({I.CUSTOMER_WITH_GAPS_SQL})
SELECT 'c_custkey' AS column_name, count(*) AS row_count,
       count(*) FILTER (WHERE c_custkey IS NULL) AS null_count,
       count(*) FILTER (WHERE c_custkey IS NULL) = 0 AS passed FROM g
UNION ALL SELECT 'c_name', count(*), count(*) FILTER (WHERE c_name IS NULL),
       count(*) FILTER (WHERE c_name IS NULL) = 0 FROM g
UNION ALL SELECT 'c_acctbal', count(*), count(*) FILTER (WHERE c_acctbal IS NULL),
       count(*) FILTER (WHERE c_acctbal IS NULL) = 0 FROM g
UNION ALL SELECT 'c_mktsegment', count(*), count(*) FILTER (WHERE c_mktsegment IS NULL),
       count(*) FILTER (WHERE c_mktsegment IS NULL) = 0 FROM g""")
def q_null_check(spark, sf):
    return checks.null_check(I.customer_with_gaps(spark, sf),
                             ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"])


@query("duplicate_check", """
SELECT l_orderkey, l_linenumber, count(*) AS dup_count FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def q_duplicate_check(spark, sf):
    return checks.duplicate_check(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("ref_integrity_check", """
SELECT * FROM orders o WHERE NOT EXISTS
  (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal >= 0)""")
def q_ref_integrity_check(spark, sf):
    parent = table(spark, sf, "customer").filter(F.col("c_acctbal") >= 0)
    return checks.ref_integrity_check(table(spark, sf, "orders"), parent,
                                      {"o_custkey": "c_custkey"})


# =============================================================== SCD
@query("change_detection", f"""
WITH tgt AS ({I.SCD2_TARGET_SQL}), src AS ({I.SCD2_SOURCE_SQL}),
cur AS (SELECT * FROM tgt WHERE is_current = 1)
SELECT s.*,
       CASE WHEN c.business_key IS NULL THEN 'new'
            WHEN c.c_mktsegment IS DISTINCT FROM s.c_mktsegment
              OR c.c_name IS DISTINCT FROM s.c_name THEN 'changed'
            ELSE 'unchanged' END AS change_type
FROM src s LEFT JOIN cur c ON s.business_key = c.business_key""")
def q_change_detection(spark, sf):
    return scd.change_detection(I.scd2_source(spark, sf), I.scd2_target(spark, sf),
                                ["business_key"], I.SCD2_TRACKED)


@query("scd2_merge", I.scd2_merge_sql(I.SCD2_TARGET_SQL, I.SCD2_SOURCE_SQL))
def q_scd2_merge(spark, sf):
    return scd.scd2_merge(I.scd2_target(spark, sf), I.scd2_source(spark, sf),
                          ["business_key"], I.SCD2_TRACKED, I.AS_OF)


@query("scd1_upsert", I.scd1_merge_sql(I.SCD1_TARGET_SQL, I.SCD1_SOURCE_SQL))
def q_scd1_upsert(spark, sf):
    return scd.scd1_merge(I.scd1_target(spark, sf), I.scd1_source(spark, sf), ["p_partkey"],
                          exclude_columns=["created_date"])

