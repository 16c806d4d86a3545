"""Inputs the catalog queries share, each derived from the given tables.

Test tables have no nulls, no orphans and no changes, so each scenario
derives them from attribute rules applied to *every* row (never a key
subset).  Each builder has a SQL twin (a CTE body) used by the oracle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the test scenarios.
AS_OF = dt.date(2024, 6, 1)
AS_OF_SQL = "DATE '2024-06-01'"
LOAD_TS = dt.datetime(2024, 6, 1, 2, 30, 0)
LOAD_TS_SQL = "TIMESTAMP '2024-06-01 02:30:00'"
BATCH_ID = "batch-20240601"
TARGET_EFFECTIVE = dt.date(2020, 1, 1)
HISTORY_EFFECTIVE = dt.date(2019, 1, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ----------------------------------------------------------------- customer with gaps
def customer_with_gaps(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        "c_custkey",
        F.when((F.col("c_mktsegment") == "AUTOMOBILE") & (F.col("c_nationkey") < 5),
               F.lit(None)).otherwise(F.col("c_name")).alias("c_name"),
        "c_nationkey",
        F.when(F.col("c_nationkey") == 7, F.lit(None)).otherwise(F.col("c_acctbal"))
        .alias("c_acctbal"),
        F.when(F.col("c_acctbal") < 0, F.lit(None)).otherwise(F.col("c_mktsegment"))
        .alias("c_mktsegment"),
    )


CUSTOMER_WITH_GAPS_SQL = """
SELECT c_custkey,
       CASE WHEN c_mktsegment = 'AUTOMOBILE' AND c_nationkey < 5 THEN NULL ELSE c_name END AS c_name,
       c_nationkey,
       CASE WHEN c_nationkey = 7 THEN NULL ELSE c_acctbal END AS c_acctbal,
       CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment
FROM customer"""


# ----------------------------------------------------------------- customer rules
def customer_rules() -> list[dict]:
    return [
        {"name": "negative_balance", "condition": F.col("c_acctbal") < 0,
         "message": "account balance is negative"},
        {"name": "restricted_nation", "condition": F.col("c_nationkey").isin(5, 11, 23),
         "message": "nation is not served"},
    ]


CUSTOMER_RULE_SQL = [
    ("negative_balance", "c_acctbal < 0", "account balance is negative"),
    ("restricted_nation", "c_nationkey IN (5, 11, 23)", "nation is not served"),
]


def rules_sql(rules, field: int) -> str:
    """``concat_ws('|', ...)`` of the failed rule names (field 0) or messages (2)."""
    parts = [f"CASE WHEN COALESCE({r[1]}, false) THEN '{r[field]}' END" for r in rules]
    return f"concat_ws('|', {', '.join(parts)})"


def any_rule_sql(rules) -> str:
    return " OR ".join(f"COALESCE({r[1]}, false)" for r in rules)


# ----------------------------------------------------------------- SCD2 scenario
# Stored dimension: customers outside nation 0 (nation 0 keys arrive as new),
# current since 2020-01-01; nations 1 and 2 also carry a closed 2019 version;
# nation 24 has only its closed version (re-opened by the merge).  The stored
# name is null for nation 5 customers with balance under 1000 (null -> value).
def scd2_target(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer").filter(F.col("c_nationkey") != 0)
    name = F.when((F.col("c_nationkey") == 5) & (F.col("c_acctbal") < 1000),
                  F.lit(None)).otherwise(F.col("c_name"))
    base = [F.col("c_custkey").alias("business_key"), name.alias("c_name"),
            "c_nationkey", "c_mktsegment"]
    current = c.filter(F.col("c_nationkey") != 24).select(
        *base, F.lit(TARGET_EFFECTIVE).alias("effective_date"),
        F.lit(dt.date(9999, 12, 31)).alias("end_date"), F.lit(1).alias("is_current"))
    history = c.filter(F.col("c_nationkey").isin(1, 2, 24)).select(
        F.col("c_custkey").alias("business_key"), name.alias("c_name"), "c_nationkey",
        F.lit("LEGACY").alias("c_mktsegment"),
        F.lit(HISTORY_EFFECTIVE).alias("effective_date"),
        F.lit(TARGET_EFFECTIVE).alias("end_date"), F.lit(0).alias("is_current"))
    return current.unionByName(history)


SCD2_TARGET_SQL = """
SELECT c_custkey AS business_key,
       CASE WHEN c_nationkey = 5 AND c_acctbal < 1000 THEN NULL ELSE c_name END AS c_name,
       c_nationkey, c_mktsegment,
       DATE '2020-01-01' AS effective_date, DATE '9999-12-31' AS end_date, 1 AS is_current
FROM customer WHERE c_nationkey <> 0 AND c_nationkey <> 24
UNION ALL
SELECT c_custkey AS business_key,
       CASE WHEN c_nationkey = 5 AND c_acctbal < 1000 THEN NULL ELSE c_name END AS c_name,
       c_nationkey, 'LEGACY' AS c_mktsegment,
       DATE '2019-01-01' AS effective_date, DATE '2020-01-01' AS end_date, 0 AS is_current
FROM customer WHERE c_nationkey IN (1, 2, 24)"""


# Incoming rows: every customer but nation 23 (absent keys stay untouched);
# negative balances move to segment RETAIL; balances over 9500 lose their name
# (value -> null).
def scd2_source(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer").filter(F.col("c_nationkey") != 23)
    return c.select(
        F.col("c_custkey").alias("business_key"),
        F.when(F.col("c_acctbal") > 9500, F.lit(None)).otherwise(F.col("c_name")).alias("c_name"),
        "c_nationkey",
        F.when(F.col("c_acctbal") < 0, F.lit("RETAIL")).otherwise(F.col("c_mktsegment"))
        .alias("c_mktsegment"),
    )


SCD2_SOURCE_SQL = """
SELECT c_custkey AS business_key,
       CASE WHEN c_acctbal > 9500 THEN NULL ELSE c_name END AS c_name,
       c_nationkey,
       CASE WHEN c_acctbal < 0 THEN 'RETAIL' ELSE c_mktsegment END AS c_mktsegment
FROM customer WHERE c_nationkey <> 23"""

SCD2_TRACKED = ["c_mktsegment", "c_name"]


def scd2_merge_sql(target_cte: str, source_cte: str, as_of_sql: str = AS_OF_SQL) -> str:
    """The SCD2 contract in SQL: kept/closed rows, opened rows, history."""
    changed = ("(t.c_mktsegment IS DISTINCT FROM s.c_mktsegment "
               "OR t.c_name IS DISTINCT FROM s.c_name)")
    return f"""
WITH tgt AS ({target_cte}), src AS ({source_cte}),
cur AS (SELECT * FROM tgt WHERE is_current = 1),
j AS (
  SELECT t.business_key AS t_key, t.c_name AS t_name, t.c_nationkey AS t_nation,
         t.c_mktsegment AS t_seg, t.effective_date AS t_eff, t.end_date AS t_end,
         t.is_current AS t_cur,
         s.business_key AS s_key, s.c_name AS s_name, s.c_nationkey AS s_nation,
         s.c_mktsegment AS s_seg,
         (t.business_key IS NOT NULL AND s.business_key IS NOT NULL AND {changed}) AS changed
  FROM cur t FULL OUTER JOIN src s ON t.business_key = s.business_key)
SELECT t_key AS business_key, t_name AS c_name, t_nation AS c_nationkey, t_seg AS c_mktsegment,
       t_eff AS effective_date,
       CASE WHEN changed THEN {as_of_sql} ELSE t_end END AS end_date,
       CASE WHEN changed THEN 0 ELSE t_cur END AS is_current
FROM j WHERE t_key IS NOT NULL
UNION ALL
SELECT s_key, s_name, s_nation, s_seg, {as_of_sql}, DATE '9999-12-31', 1
FROM j WHERE s_key IS NOT NULL AND (t_key IS NULL OR changed)
UNION ALL
SELECT * FROM tgt WHERE is_current IS NULL OR is_current <> 1"""


# ----------------------------------------------------------------- SCD1 scenario
# Stored: parts of size up to 45, created 2020-01-01.  Incoming: every part but
# size 1 (absent); Brand#1 prices rise by 10; size 50 parts lose their name
# (null overwrites); created_date is the load date (excluded on update).
def scd1_target(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part").filter(F.col("p_size") <= 45)
    return p.select("p_partkey", "p_name", "p_brand", "p_retailprice",
                    F.lit(TARGET_EFFECTIVE).alias("created_date"))


SCD1_TARGET_SQL = """
SELECT p_partkey, p_name, p_brand, p_retailprice, DATE '2020-01-01' AS created_date
FROM part WHERE p_size <= 45"""


def scd1_source(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part").filter(F.col("p_size") != 1)
    return p.select(
        "p_partkey",
        F.when(F.col("p_size") == 50, F.lit(None)).otherwise(F.col("p_name")).alias("p_name"),
        "p_brand",
        F.when(F.col("p_brand") == "Brand#1", F.col("p_retailprice") + 10)
        .otherwise(F.col("p_retailprice")).alias("p_retailprice"),
        F.lit(AS_OF).alias("created_date"),
    )


SCD1_SOURCE_SQL = """
SELECT p_partkey,
       CASE WHEN p_size = 50 THEN NULL ELSE p_name END AS p_name,
       p_brand,
       CASE WHEN p_brand = 'Brand#1' THEN p_retailprice + 10 ELSE p_retailprice END AS p_retailprice,
       DATE '2024-06-01' AS created_date
FROM part WHERE p_size <> 1"""


def scd1_merge_sql(target_cte: str, source_cte: str) -> str:
    return f"""
WITH tgt AS ({target_cte}), src AS ({source_cte})
SELECT COALESCE(t.p_partkey, s.p_partkey) AS p_partkey,
       CASE WHEN s.p_partkey IS NOT NULL THEN s.p_name ELSE t.p_name END AS p_name,
       CASE WHEN s.p_partkey IS NOT NULL THEN s.p_brand ELSE t.p_brand END AS p_brand,
       CASE WHEN s.p_partkey IS NOT NULL THEN s.p_retailprice ELSE t.p_retailprice END
         AS p_retailprice,
       CASE WHEN t.p_partkey IS NOT NULL THEN t.created_date ELSE s.created_date END
         AS created_date
FROM tgt t FULL OUTER JOIN src s ON t.p_partkey = s.p_partkey"""


# ----------------------------------------------------------------- versioned customer dim
# Current version for every customer outside nation 13; customers with a
# negative balance also carry an older closed version; nation 13 customers
# have only a closed version, so their orders find no current row.
def customer_dim_versions(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    cur = c.filter(F.col("c_nationkey") != 13).select(
        (F.col("c_custkey") * 10 + 2).alias("customer_sk"),
        F.col("c_custkey").alias("customer_id"), "c_mktsegment",
        F.lit(1).alias("is_current"))
    old = c.filter((F.col("c_acctbal") < 0) | (F.col("c_nationkey") == 13)).select(
        (F.col("c_custkey") * 10 + 1).alias("customer_sk"),
        F.col("c_custkey").alias("customer_id"), F.lit("LEGACY").alias("c_mktsegment"),
        F.lit(0).alias("is_current"))
    return cur.unionByName(old)


CUSTOMER_DIM_SQL = """
SELECT c_custkey * 10 + 2 AS customer_sk, c_custkey AS customer_id, c_mktsegment, 1 AS is_current
FROM customer WHERE c_nationkey <> 13
UNION ALL
SELECT c_custkey * 10 + 1, c_custkey, 'LEGACY', 0
FROM customer WHERE c_acctbal < 0 OR c_nationkey = 13"""
