"""Catalog queries that write: sinks, the five loads, audit, restartable ingest.

Each call works in a fresh folder under the shared directory, writes its
inputs there with Spark (derived from the given tables), runs the load and
returns what the load wrote, read back.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadkit.catalog import inputs as I
from loadkit.catalog.inputs import table
from loadkit.catalog.queries import PART_CONVERSIONS, PART_TEXT_SQL, part_as_text, query
from loadkit.operators import routing, scd, transforms
from loadkit.operators.routing import ERROR_MESSAGES, ERROR_RULES, ErrorLimitExceeded
from loadkit.plans import loads
from loadkit.plans.audit import AuditTrail
from loadkit.plans.high_water import extract_new
from loadkit.session import scratch_path
from loadkit.sinks import batches, buckets, compaction
from loadkit.sinks import tables as sinks
from loadkit.sources import readers
from loadkit.streaming.ingest import ingest_new_files


def _ntz(text: str):
    return F.to_timestamp_ntz(F.lit(text))


def _table_name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:10]}"


# =============================================================== sources on files
@query("csv_ingest", """
SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type,
       CAST(p_size AS VARCHAR) AS p_size, p_retailprice, true AS from_csv_file
FROM part""")
def q_csv_ingest(spark, sf):
    folder = scratch_path(spark, "csv-ingest")
    table(spark, sf, "part").write.option("header", "true").csv(folder)
    cols = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
    raw = readers.read_delimited(spark, folder, cols, delimiter=",", header=True)
    raw = transforms.lineage_columns(raw, source_file=True)
    return raw.select(*cols[:-1], F.col("p_retailprice").try_cast("double").alias("p_retailprice"),
                      F.col("source_file").like("%/part-%.csv").alias("from_csv_file"))


FIXED_WIDTH = [("c_custkey", 10), ("c_name", 25), ("c_nationkey", 3), ("c_acctbal", 12),
               ("c_mktsegment", 10)]


def fixed_width_lines(c):
    line = F.concat(
        F.lpad(F.col("c_custkey").cast("string"), 10, " "),
        F.rpad(F.col("c_name"), 25, " "),
        F.lpad(F.col("c_nationkey").cast("string"), 3, " "),
        F.lpad(F.format_string("%.2f", F.col("c_acctbal")), 12, " "),
        F.rpad(F.col("c_mktsegment"), 10, " "))
    return c.select(line.alias("value"))


@query("fixed_width_ingest", """
SELECT c_custkey, c_name, c_nationkey, CAST(c_acctbal AS DECIMAL(12,2)) AS c_acctbal, c_mktsegment
FROM customer""")
def q_fixed_width_ingest(spark, sf):
    folder = scratch_path(spark, "fixed-width")
    c = table(spark, sf, "customer")
    fixed_width_lines(c).write.text(folder)
    raw = readers.read_fixed_width(spark, folder, FIXED_WIDTH)
    conv, rules = transforms.type_conversions(raw, {"c_custkey": "bigint", "c_nationkey": "int",
                                                    "c_acctbal": "decimal(12,2)"})
    valid, _ = routing.route_errors(conv, [readers.fixed_width_length_rule(FIXED_WIDTH), *rules])
    return transforms.drop_raw_columns(valid).drop("_record_length")


# =============================================================== sinks
@query("append_table", """
SELECT * FROM customer UNION ALL SELECT * FROM customer WHERE c_acctbal < 0""")
def q_append_table(spark, sf):
    path = scratch_path(spark, "append")
    c = table(spark, sf, "customer")
    sinks.append(c, path)
    sinks.append(c.filter(F.col("c_acctbal") < 0), path)
    return spark.read.parquet(path)


@query("partitioned_append", """
SELECT *, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date_sk FROM orders""")
def q_partitioned_append(spark, sf):
    path = scratch_path(spark, "partitioned")
    o = transforms.add_date_key(table(spark, sf, "orders"), "o_orderdate")
    cut = F.col("o_orderdate") < _ntz("1998-01-01 00:00:00")
    sinks.append(o.filter(cut), path, partition_by=["date_sk"])
    sinks.append(o.filter(~cut), path, partition_by=["date_sk"])
    # Re-running the second batch replaces its partitions instead of doubling them.
    sinks.append(o.filter(~cut), path, partition_by=["date_sk"], replace_partitions=True)
    return spark.read.parquet(path)


@query("append_batches_rerun", "SELECT * FROM customer")
def q_append_batches_rerun(spark, sf):
    """Two batches; the first dies after its write and runs again, then both run again: each row once."""
    path = scratch_path(spark, "append-once")
    c = table(spark, sf, "customer")
    halves = {"low": c.filter(F.col("c_acctbal") < 0), "rest": c.filter("c_acctbal is null or c_acctbal >= 0")}
    batches.write_batch(halves["low"], path)  # killed before its manifest entry
    for _ in range(2):
        for name, rows in halves.items():
            batches.append_batch(rows, path, name)
    return batches.read_batches(spark, path, c.schema)


@query("compaction_after_appends", "SELECT *, CAST(o_orderdate AS DATE) AS order_day FROM orders")
def q_compaction_after_appends(spark, sf):
    """Twelve batches, compacted after eight and again at the end: the same rows, in fewer folders."""
    path = scratch_path(spark, "compacted")
    orders = table(spark, sf, "orders").withColumn("order_day", F.to_date("o_orderdate"))
    for k in range(12):
        rows = orders.filter(F.pmod(F.coalesce("o_orderkey", F.lit(0)), F.lit(12)) == k)
        batches.append_batch(rows, path, f"batch-{k}")
        if k in (7, 11):
            compaction.compact(spark, path, orders.schema)
    if len(batches.live_folders(spark, path)) > 6:
        raise RuntimeError("the batches were not compacted")
    return batches.read_batches(spark, path, orders.schema)


ORDER_RULES_SQL = [
    ("low_value", "o_totalprice < 5000", "order value below 5000"),
    ("urgent_pending", "o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'",
     "urgent order still pending"),
]


def order_rules() -> list[dict]:
    return [
        {"name": "low_value", "condition": F.col("o_totalprice") < 5000,
         "message": "order value below 5000"},
        {"name": "urgent_pending",
         "condition": (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P"),
         "message": "urgent order still pending"},
    ]


@query("error_row_sink", f"""
SELECT *, {I.rules_sql(ORDER_RULES_SQL, 0)} AS error_rules,
       {I.rules_sql(ORDER_RULES_SQL, 2)} AS error_messages,
       'validation' AS stage, '{I.BATCH_ID}' AS batch_id, {I.LOAD_TS_SQL} AS error_timestamp
FROM orders WHERE {I.any_rule_sql(ORDER_RULES_SQL)}""")
def q_error_row_sink(spark, sf):
    path = scratch_path(spark, "errors")
    _, errors = routing.route_errors(table(spark, sf, "orders"), order_rules())
    sinks.write_error_rows(errors, path, "orders_load", "validation", I.BATCH_ID, I.LOAD_TS)
    back = spark.read.parquet(f"{path}/pipeline=orders_load")
    return back.withColumns({ERROR_RULES: F.array_join(ERROR_RULES, "|"),
                             ERROR_MESSAGES: F.array_join(ERROR_MESSAGES, "|")})


# =============================================================== SCD2 dimension load
def scd2_load_source(spark, sf):
    c = table(spark, sf, "customer").filter(F.col("c_nationkey") != 23)
    key = F.when(F.col("c_nationkey") == 22, F.lit(None)).otherwise(F.col("c_custkey"))
    name = F.when(F.col("c_acctbal") > 9500, F.lit(None)).otherwise(F.col("c_name"))
    seg = F.when(F.col("c_acctbal") < 0, F.lit("RETAIL")).otherwise(F.col("c_mktsegment"))
    bal = F.col("c_acctbal")

    def shape(segment, ts):
        return [key.alias("business_key"), name.alias("c_name"), "c_nationkey",
                segment.alias("c_mktsegment"), _ntz(ts).alias("modified_date")]

    base = c.select(*shape(seg, "2024-05-31 00:00:00"))
    stale = c.filter((bal >= 0) & (bal < 1000)).select(*shape(F.lit("STALE"), "2024-05-01 00:00:00"))
    bad = c.filter((bal >= 1000) & (bal < 1500)).select(*shape(F.lit("BAD"), "2024-05-31 12:00:00"))
    return transforms.union_all(base, stale, bad)


SCD2_LOAD_SOURCE_SQL = """
WITH c AS (SELECT * FROM customer WHERE c_nationkey <> 23),
raw AS (
  SELECT CASE WHEN c_nationkey = 22 THEN NULL ELSE c_custkey END AS business_key,
         CASE WHEN c_acctbal > 9500 THEN NULL ELSE c_name END AS c_name, c_nationkey,
         CASE WHEN c_acctbal < 0 THEN 'RETAIL' ELSE c_mktsegment END AS c_mktsegment,
         TIMESTAMP '2024-05-31 00:00:00' AS modified_date FROM c
  UNION ALL
  SELECT CASE WHEN c_nationkey = 22 THEN NULL ELSE c_custkey END,
         CASE WHEN c_acctbal > 9500 THEN NULL ELSE c_name END, c_nationkey, 'STALE',
         TIMESTAMP '2024-05-01 00:00:00' FROM c WHERE c_acctbal >= 0 AND c_acctbal < 1000
  UNION ALL
  SELECT CASE WHEN c_nationkey = 22 THEN NULL ELSE c_custkey END,
         CASE WHEN c_acctbal > 9500 THEN NULL ELSE c_name END, c_nationkey, 'BAD',
         TIMESTAMP '2024-05-31 12:00:00' FROM c WHERE c_acctbal >= 1000 AND c_acctbal < 1500)
SELECT * FROM raw"""

SCD2_LOAD_VALID_SQL = f"""
WITH raw AS ({SCD2_LOAD_SOURCE_SQL}),
dd AS (SELECT * FROM raw WHERE business_key IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY business_key ORDER BY modified_date DESC) = 1)
SELECT business_key, c_name, c_nationkey, c_mktsegment FROM dd
WHERE NOT COALESCE(c_mktsegment = 'BAD', false)"""


def bad_segment_rule() -> dict:
    return {"name": "bad_segment", "condition": F.col("c_mktsegment") == "BAD",
            "message": "segment code BAD"}


def run_scd2_load(spark, sf, source=None, bucketed=False):
    root = scratch_path(spark, "dim-scd2")
    if bucketed:
        name = buckets.create_bucketed(I.scd2_target(spark, sf), f"{root}/dimension", ["business_key"], 8)
    else:
        name = _table_name("dim_customer")
        sinks.publish_version(spark, I.scd2_target(spark, sf), name, root)
    return loads.load_dimension_scd2(
        spark, scd2_load_source(spark, sf) if source is None else source,
        table=name, root=root, keys=["business_key"], tracked=I.SCD2_TRACKED,
        order_columns=["modified_date"], as_of=I.AS_OF, rules=[bad_segment_rule()],
        load_ts=I.LOAD_TS, error_path=f"{root}/errors",
        audit=AuditTrail("dimension_scd2", batch_id=I.BATCH_ID))


@query("dimension_scd2_load", I.scd2_merge_sql(I.SCD2_TARGET_SQL, SCD2_LOAD_VALID_SQL))
def q_dimension_scd2_load(spark, sf):
    return run_scd2_load(spark, sf).output


@query("dimension_scd2_load_bucketed", I.scd2_merge_sql(I.SCD2_TARGET_SQL, SCD2_LOAD_VALID_SQL))
def q_dimension_scd2_load_bucketed(spark, sf):
    return run_scd2_load(spark, sf, bucketed=True).output


@query("scd2_merge_bucketed", I.scd2_merge_sql(I.SCD2_TARGET_SQL, I.SCD2_SOURCE_SQL))
def q_scd2_merge_bucketed(spark, sf):
    dim = buckets.create_bucketed(I.scd2_target(spark, sf), scratch_path(spark, "scd2-buckets"), ["business_key"], 8)
    dim.merge(I.scd2_source(spark, sf),
              lambda target, rows: scd.scd2_merge(target, rows, ["business_key"], I.SCD2_TRACKED, I.AS_OF))
    return dim.read()


@query("scd1_upsert_bucketed", I.scd1_merge_sql(I.SCD1_TARGET_SQL, I.SCD1_SOURCE_SQL))
def q_scd1_upsert_bucketed(spark, sf):
    dim = buckets.create_bucketed(I.scd1_target(spark, sf), scratch_path(spark, "scd1-buckets"), ["p_partkey"], 8)
    dim.merge(I.scd1_source(spark, sf),
              lambda target, rows: scd.scd1_merge(target, rows, ["p_partkey"], exclude_columns=["created_date"]))
    return dim.read()


@query("empty_source_exit", I.SCD2_TARGET_SQL)
def q_empty_source_exit(spark, sf):
    # Every source row was modified a month before as_of: the 3-day window is empty.
    src = scd2_load_source(spark, sf).withColumn("modified_date", _ntz("2024-05-01 00:00:00"))
    src = readers.incremental_extract(src, "modified_date", I.AS_OF, lookback_days=3)
    result = run_scd2_load(spark, sf, source=src)
    if result.audit.status != "complete" or result.audit.count("read") != 0:
        raise RuntimeError("an empty source must end the load as complete with nothing read")
    return result.output


# =============================================================== SCD1 dimension load
def scd1_load_source(spark, sf):
    p = table(spark, sf, "part").filter(F.col("p_size") != 1)
    key = F.when(F.col("p_size") == 3, F.lit(None)).otherwise(F.col("p_partkey"))
    name = F.when(F.col("p_size") == 50, F.lit(None)).otherwise(F.col("p_name"))
    price = F.when(F.col("p_brand") == "Brand#1", F.col("p_retailprice") + 10) \
        .otherwise(F.col("p_retailprice"))

    def shape(nm, pr, ts):
        return [key.alias("p_partkey"), nm.alias("p_name"), "p_brand", pr.alias("p_retailprice"),
                F.lit(I.AS_OF).alias("created_date"), _ntz(ts).alias("modified_date")]

    base = p.select(*shape(name, price, "2024-05-31 00:00:00"))
    newer_bad = p.filter(F.col("p_size") == 2).select(
        *shape(name, F.lit(-1.0), "2024-05-31 12:00:00"))
    older = p.filter(F.col("p_size") == 4).select(
        *shape(F.lit("OLD"), price, "2024-05-01 00:00:00"))
    return transforms.union_all(base, newer_bad, older)


SCD1_LOAD_VALID_SQL = """
WITH p AS (SELECT * FROM part WHERE p_size <> 1),
raw AS (
  SELECT CASE WHEN p_size = 3 THEN NULL ELSE p_partkey END AS p_partkey,
         CASE WHEN p_size = 50 THEN NULL ELSE p_name END AS p_name, p_brand,
         CASE WHEN p_brand = 'Brand#1' THEN p_retailprice + 10 ELSE p_retailprice END
           AS p_retailprice,
         DATE '2024-06-01' AS created_date, TIMESTAMP '2024-05-31 00:00:00' AS modified_date
  FROM p
  UNION ALL
  SELECT p_partkey, CASE WHEN p_size = 50 THEN NULL ELSE p_name END, p_brand, -1.0,
         DATE '2024-06-01', TIMESTAMP '2024-05-31 12:00:00' FROM p WHERE p_size = 2
  UNION ALL
  SELECT p_partkey, 'OLD', p_brand,
         CASE WHEN p_brand = 'Brand#1' THEN p_retailprice + 10 ELSE p_retailprice END,
         DATE '2024-06-01', TIMESTAMP '2024-05-01 00:00:00' FROM p WHERE p_size = 4),
dd AS (SELECT * FROM raw WHERE p_partkey IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY modified_date DESC) = 1)
SELECT p_partkey, p_name, p_brand, p_retailprice, created_date FROM dd
WHERE NOT COALESCE(p_retailprice < 0, false)"""


@query("dimension_scd1_load", I.scd1_merge_sql(I.SCD1_TARGET_SQL, SCD1_LOAD_VALID_SQL))
def q_dimension_scd1_load(spark, sf):
    root = scratch_path(spark, "dim-scd1")
    name = _table_name("dim_part")
    sinks.publish_version(spark, I.scd1_target(spark, sf), name, root)
    result = loads.load_dimension_scd1(
        spark, scd1_load_source(spark, sf), table=name, root=root, keys=["p_partkey"],
        order_columns=["modified_date"], exclude_columns=["created_date"],
        rules=[{"name": "negative_price", "condition": F.col("p_retailprice") < 0,
                "message": "price below zero"}],
        load_ts=I.LOAD_TS, error_path=f"{root}/errors",
        audit=AuditTrail("dimension_scd1", batch_id=I.BATCH_ID))
    return result.output


# =============================================================== fact load
def run_fact_load(spark, sf, *, detail=None, twice=False, root=None, once=False, batch_id=I.BATCH_ID, steps=False,
                  error_limit=None):
    """``detail``: other detail rows; ``twice``: every primary row comes twice; ``once``: as a published batch;
    ``steps``: with a step ledger."""
    root = root or scratch_path(spark, "fact")
    if detail is None:
        detail = table(spark, sf, "lineitem")
    detail = detail.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "l_extendedprice", "l_discount")
    primary = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate", "o_orderstatus")
    if twice:
        primary = primary.unionAll(primary)
    lookups = [
        {"name": "customer", "dim": I.customer_dim_versions(spark, sf), "current_only": True,
         "on": {"o_custkey": "customer_id"}, "columns": ["customer_sk"]},
        {"name": "part", "dim": table(spark, sf, "part"), "on": {"l_partkey": "p_partkey"},
         "columns": ["p_brand"]},
        {"name": "supplier", "dim": table(spark, sf, "supplier").filter(F.col("s_acctbal") >= 0),
         "on": {"l_suppkey": "s_suppkey"}, "columns": ["s_name"]},
    ]
    return loads.load_fact(
        spark, detail, primary, join_on="l_orderkey", path=f"{root}/fact", lookups=lookups,
        date_column="o_orderdate",
        derived={"line_total": F.col("l_extendedprice") * (1 - F.col("l_discount"))},
        rules=[{"name": "bulk_quantity", "condition": F.col("l_quantity") > 48,
                "message": "quantity above 48"}],
        load_ts=I.LOAD_TS, error_path=f"{root}/errors", once=once, partition_by=[] if once else None,
        error_limit=error_limit, steps_path=f"{root}/steps" if steps else None,
        audit=AuditTrail("fact_load", batch_id=batch_id))


FACT_JOINED_SQL = f"""
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice,
       l.l_discount, o.o_custkey, o.o_orderdate, o.o_orderstatus,
       d.customer_sk, p.p_brand, s.s_name,
       d.customer_id IS NOT NULL AS hit_customer, p.p_partkey IS NOT NULL AS hit_part,
       s.s_suppkey IS NOT NULL AS hit_supplier
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
LEFT JOIN ({I.CUSTOMER_DIM_SQL}) d ON o.o_custkey = d.customer_id AND d.is_current = 1
LEFT JOIN part p ON l.l_partkey = p.p_partkey
LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey AND s.s_acctbal >= 0"""

FACT_ERROR_SQL = "(NOT hit_customer OR NOT hit_part OR NOT hit_supplier OR l_quantity > 48)"


FACT_LOAD_SQL = f"""
WITH f AS ({FACT_JOINED_SQL})
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount,
       o_custkey, o_orderdate, o_orderstatus, customer_sk, p_brand, s_name,
       l_extendedprice * (1 - l_discount) AS line_total,
       CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date_sk,
       'OLTP' AS source_system, {I.LOAD_TS_SQL} AS load_timestamp
FROM f WHERE NOT {FACT_ERROR_SQL}"""


@query("fact_load", FACT_LOAD_SQL)
def q_fact_load(spark, sf):
    # fact_sk depends on staged file order, not on a SQL-expressible order;
    # tests check it is dense and unique.
    return run_fact_load(spark, sf).output.drop("fact_sk")


@query("fact_load_rerun", FACT_LOAD_SQL)
def q_fact_load_rerun(spark, sf):
    """The same batch twice, and its rows once more in a folder that was never published: each row once."""
    root = scratch_path(spark, "fact-rerun")
    batches.write_batch(run_fact_load(spark, sf, root=root, once=True).output, f"{root}/fact")
    return run_fact_load(spark, sf, root=root, once=True).output.drop("fact_sk")


def unreadable(df):
    """``df`` with its columns, which fails if any of its rows is read."""
    return df.filter(F.raise_error(F.lit("the source was read again")).isNull())


@query("fact_load_restart", FACT_LOAD_SQL)
def q_fact_load_restart(spark, sf):
    """A load refused for its bad rows after it was staged, then run again without a limit under its batch id: it goes
    on from the staged rows (its source now fails if it is read).  A third run repeats nothing."""
    root, lines = scratch_path(spark, "fact-restart"), table(spark, sf, "lineitem")
    try:
        run_fact_load(spark, sf, root=root, once=True, steps=True, error_limit=0)
    except ErrorLimitExceeded:
        lines = unreadable(lines)
    for _ in range(2):
        result = run_fact_load(spark, sf, detail=lines, root=root, once=True, steps=True)
    return result.output.drop("fact_sk")


@query("fact_load_two_at_once", f"""
WITH f AS ({FACT_JOINED_SQL})
SELECT count(*) AS n, CASE WHEN count(*) > 0 THEN 1 END AS least, nullif(count(*), 0) AS most,
       count(*) AS different FROM f WHERE NOT {FACT_ERROR_SQL}""")
def q_fact_load_two_at_once(spark, sf):
    """Two loads of half the rows each at one time: their key ranges are disjoint and leave no gap."""
    root = scratch_path(spark, "fact-two")
    lines = table(spark, sf, "lineitem")
    with ThreadPoolExecutor(2) as pool:
        runs = [pool.submit(run_fact_load, spark, sf, detail=lines.filter(F.col("l_linenumber") % 2 == k),
                            root=root, once=True, batch_id=f"half-{k}") for k in (0, 1)]
    results = [r.result() for r in runs]
    return batches.read_batches(spark, f"{root}/fact", results[0].output.schema).agg(
        F.count("fact_sk").alias("n"), F.min("fact_sk").cast("int").alias("least"),
        F.max("fact_sk").alias("most"), F.count_distinct("fact_sk").alias("different"))


@query("stage_row_counts", f"""
WITH f AS ({FACT_JOINED_SQL})
SELECT 'detail' AS stage, (SELECT count(*) FROM lineitem) AS row_count
UNION ALL SELECT 'primary', (SELECT count(*) FROM orders)
UNION ALL SELECT 'joined', (SELECT count(*) FROM f)
UNION ALL SELECT 'errors', (SELECT count(*) FROM f WHERE {FACT_ERROR_SQL})
UNION ALL SELECT 'written', (SELECT count(*) FROM f WHERE NOT {FACT_ERROR_SQL})""")
def q_stage_row_counts(spark, sf):
    return _stage_counts(spark, run_fact_load(spark, sf).metrics)


@query("stage_row_counts_repeated_primary", f"""
WITH f AS ({FACT_JOINED_SQL})
SELECT 'detail' AS stage, (SELECT count(*) FROM lineitem) AS row_count
UNION ALL SELECT 'primary', (SELECT 2 * count(*) FROM orders)
UNION ALL SELECT 'joined', (SELECT 2 * count(*) FROM f)
UNION ALL SELECT 'errors', (SELECT 2 * count(*) FROM f WHERE {FACT_ERROR_SQL})
UNION ALL SELECT 'written', (SELECT 2 * count(*) FROM f WHERE NOT {FACT_ERROR_SQL})""")
def q_stage_row_counts_repeated_primary(spark, sf):
    return _stage_counts(spark, run_fact_load(spark, sf, twice=True).metrics)


@query("read_counts_per_file", """
SELECT 'detail' AS source, 'lineitem.parquet' AS file, (SELECT count(*) FROM lineitem) AS n
UNION ALL SELECT 'primary', 'orders.parquet', (SELECT count(*) FROM orders)""")
def q_read_counts_per_file(spark, sf):
    file = F.regexp_extract("file_path", "([^/]+[.]parquet)(/[^/]*)?$", 1).alias("file")
    return run_fact_load(spark, sf).read_files.groupBy("source", file).agg(F.sum("rows").alias("n"))


@query("fact_surrogate_keys", f"""
WITH f AS ({FACT_JOINED_SQL})
SELECT count(*) AS n, CASE WHEN count(*) > 0 THEN 1 END AS least, nullif(count(*), 0) AS most,
       count(*) AS different FROM f WHERE NOT {FACT_ERROR_SQL}""")
def q_fact_surrogate_keys(spark, sf):
    return run_fact_load(spark, sf).output.agg(
        F.count("fact_sk").alias("n"), F.min("fact_sk").cast("int").alias("least"),
        F.max("fact_sk").alias("most"), F.count_distinct("fact_sk").alias("different"))


@query("empty_fact_load", """
SELECT 'detail' AS object, 0 AS "rows", 'ok' AS status
UNION ALL SELECT 'primary', (SELECT count(*) FROM orders), 'ok'
UNION ALL SELECT 'joined', 0, 'ok' UNION ALL SELECT 'detail_without_primary', 0, 'ok'
UNION ALL SELECT 'error_rows', 0, 'ok' UNION ALL SELECT 'fact_table', 0, 'ok'
UNION ALL SELECT 'fact_load', NULL, 'complete'""")
def q_empty_fact_load(spark, sf):
    result = run_fact_load(spark, sf, detail=table(spark, sf, "lineitem").filter("l_quantity < 0"))
    if result.output.count() or "fact_sk" not in result.output.columns:
        raise RuntimeError("nothing may be written, and the frame keeps its columns")
    return result.audit.to_frame(spark).filter("kind <> 'start'").select("object", "rows", "status")


def _stage_counts(spark, m):
    rows = [(s, int(m[k])) for s, k in [("detail", "detail"), ("primary", "primary"),
                                         ("joined", "joined"), ("errors", "errors"),
                                         ("written", "written")]]
    schema = T.StructType([T.StructField("stage", T.StringType()),
                           T.StructField("row_count", T.LongType())])
    return spark.createDataFrame(rows, schema)


@query("audit_trail", f"""
WITH f AS ({FACT_JOINED_SQL}),
c AS (SELECT (SELECT count(*) FROM lineitem) AS n_detail, (SELECT count(*) FROM orders) AS n_primary,
             (SELECT count(*) FROM f) AS n_joined,
             (SELECT count(*) FROM f WHERE {FACT_ERROR_SQL}) AS n_err)
SELECT '{I.BATCH_ID}' AS batch_id, 'fact_load' AS pipeline, 1 AS seq, 'run' AS stage,
       'fact_load' AS object, 'start' AS kind, CAST(NULL AS BIGINT) AS "rows",
       'running' AS status, CAST(NULL AS VARCHAR) AS message
UNION ALL SELECT '{I.BATCH_ID}', 'fact_load', 2, 'read', 'detail', 'read', n_detail, 'ok', NULL FROM c
UNION ALL SELECT '{I.BATCH_ID}', 'fact_load', 3, 'read', 'primary', 'read', n_primary, 'ok', NULL FROM c
UNION ALL SELECT '{I.BATCH_ID}', 'fact_load', 4, 'join', 'joined', 'read', n_joined, 'ok', NULL FROM c
UNION ALL SELECT '{I.BATCH_ID}', 'fact_load', 5, 'join', 'detail_without_primary', 'dropped', n_detail - n_joined, 'ok', NULL FROM c
UNION ALL SELECT '{I.BATCH_ID}', 'fact_load', 6, 'validation', 'error_rows', 'error', n_err, 'ok', NULL FROM c
UNION ALL SELECT '{I.BATCH_ID}', 'fact_load', 7, 'write', 'fact_table', 'write', n_joined - n_err, 'ok', NULL FROM c
UNION ALL SELECT '{I.BATCH_ID}', 'fact_load', 8, 'run', 'fact_load', 'end', NULL, 'complete', NULL""")
def q_audit_trail(spark, sf):
    trail = run_fact_load(spark, sf).audit.to_frame(spark)
    if trail.filter("ts IS NULL").count():
        raise RuntimeError("every audit row has its time")
    return trail.drop("ts")


# =============================================================== flat file load
@query("flat_file_load", f"""
WITH txt AS ({PART_TEXT_SQL})
SELECT TRY_CAST(p_partkey AS BIGINT) AS p_partkey, TRY_CAST(p_size AS INTEGER) AS p_size,
       TRY_CAST(p_retailprice AS DOUBLE) AS p_retailprice,
       CAST(try_strptime(avail_date, '%Y/%m/%d') AS DATE) AS avail_date,
       true AS from_csv_file, {I.LOAD_TS_SQL} AS load_timestamp
FROM txt
WHERE TRY_CAST(p_partkey AS BIGINT) IS NOT NULL AND TRY_CAST(p_size AS INTEGER) IS NOT NULL
  AND TRY_CAST(p_retailprice AS DOUBLE) IS NOT NULL
  AND try_strptime(avail_date, '%Y/%m/%d') IS NOT NULL""")
def q_flat_file_load(spark, sf):
    root = scratch_path(spark, "flat-file")
    part_as_text(spark, sf).write.option("header", "true").csv(f"{root}/incoming")
    result = loads.load_flat_file(
        spark, f"{root}/incoming", ["p_partkey", "p_size", "p_retailprice", "avail_date"],
        path=f"{root}/target", conversions=PART_CONVERSIONS, load_ts=I.LOAD_TS,
        error_path=f"{root}/errors", error_limit=None, error_fraction=0.25,
        audit=AuditTrail("flat_file_ingest", batch_id=I.BATCH_ID))
    out = result.output
    return out.select("p_partkey", "p_size", "p_retailprice", "avail_date",
                      F.col("source_file").like("%/part-%.csv").alias("from_csv_file"),
                      "load_timestamp")


@query("header_only_file_load", """
SELECT 'file' AS object, CAST(0 AS BIGINT) AS "rows", 'ok' AS status UNION ALL SELECT 'error_rows', 0, 'ok'
UNION ALL SELECT 'target', 0, 'ok' UNION ALL SELECT 'flat_file_ingest', NULL, 'complete'""")
def q_header_only_file_load(spark, sf):
    root = scratch_path(spark, "header-only")
    # No part has this size: the file is its header line.
    (part_as_text(spark, sf).filter("p_size = 'none'").coalesce(1)
     .write.option("header", "true").csv(f"{root}/incoming"))
    result = loads.load_flat_file(
        spark, f"{root}/incoming", ["p_partkey", "p_size", "p_retailprice", "avail_date"],
        path=f"{root}/target", conversions=PART_CONVERSIONS, load_ts=I.LOAD_TS)
    if result.output.count():
        raise RuntimeError("a header-only file has no rows")
    return result.audit.to_frame(spark).filter("kind <> 'start'").select("object", "rows", "status")


@query("fixed_width_load", """
SELECT c_custkey, c_name, c_nationkey, CAST(c_acctbal AS DECIMAL(12,2)) AS c_acctbal, c_mktsegment,
       true AS from_file FROM customer""")
def q_fixed_width_load(spark, sf):
    root = scratch_path(spark, "fixed-width-load")
    fixed_width_lines(table(spark, sf, "customer")).write.text(f"{root}/incoming")
    out = loads.load_flat_file(
        spark, f"{root}/incoming", path=f"{root}/target", fixed_width=FIXED_WIDTH, load_ts=I.LOAD_TS,
        conversions={"c_custkey": "bigint", "c_nationkey": "int", "c_acctbal": "decimal(12,2)"}).output
    return out.select(*[c for c, _ in FIXED_WIDTH], F.col("source_file").like("%/part-%.txt").alias("from_file"))


# =============================================================== generic load
def _drop_views(df):
    return df.filter(F.col("event_type") != "view")


def _enrich_events(df):
    return df.withColumns({
        "prop_k": F.get_json_object("props", "$.k").cast("int"),
        "event_date": F.to_date("ts"),
        "value_band": F.when(F.col("value") >= 100, "high").when(F.col("value") >= 10, "mid")
        .otherwise("low"),
    })


@query("generic_load", """
SELECT event_id, ts, user_id, event_type, value, props,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS prop_k,
       CAST(ts AS DATE) AS event_date,
       CASE WHEN value >= 100 THEN 'high' WHEN value >= 10 THEN 'mid' ELSE 'low' END AS value_band
FROM events WHERE event_type <> 'view' AND NOT COALESCE(value > 400, false)""")
def q_generic_load(spark, sf):
    root = scratch_path(spark, "generic")
    result = loads.load_generic(
        spark, table(spark, sf, "events"), path=f"{root}/target",
        steps=[_drop_views, _enrich_events],
        rules=[{"name": "value_out_of_range", "condition": F.col("value") > 400,
                "message": "value above 400"}],
        partition_by=["event_date"], load_ts=I.LOAD_TS, error_path=f"{root}/errors",
        audit=AuditTrail("generic", batch_id=I.BATCH_ID))
    return result.output


def refused_load(spark, sf, limit, **more):
    """Load the customers, then a batch with more bad rows than ``limit``:
    (the target's rows after the refusal, the audit status)."""
    root = scratch_path(spark, "refused")
    good = table(spark, sf, "customer")
    kw = dict(path=f"{root}/target", load_ts=I.LOAD_TS, error_path=f"{root}/errors")
    loads.load_generic(spark, good, **kw)
    audit = AuditTrail("generic", batch_id=I.BATCH_ID)
    try:
        loads.load_generic(spark, good, rules=[{"name": "negative_balance", "condition": F.col("c_acctbal") < 0}],
                           error_limit=limit, audit=audit, **kw, **more)
    except routing.ErrorLimitExceeded:
        pass
    return spark.read.parquet(f"{root}/target").withColumn("load_status", F.lit(audit.status))


def _refused_sql(limit):
    status = f"CASE WHEN (SELECT count(*) FROM customer WHERE c_acctbal < 0) > {limit} THEN 'failed' ELSE 'complete' END"
    return f"""
SELECT *, {status} AS load_status FROM customer
UNION ALL SELECT *, 'complete' FROM customer
WHERE c_acctbal >= 0 AND (SELECT count(*) FROM customer WHERE c_acctbal < 0) <= {limit}"""


@query("error_threshold_refused_load", _refused_sql(5))
def q_error_threshold_refused_load(spark, sf):
    return refused_load(spark, sf, 5)


@query("fail_on_error_refused_load", _refused_sql(0))
def q_fail_on_error_refused_load(spark, sf):
    return refused_load(spark, sf, 0)


@query("early_stop_refused_load", _refused_sql(5))
def q_early_stop_refused_load(spark, sf):
    return refused_load(spark, sf, 5, stop_early=True)


@query("early_stop_complete_load", _refused_sql(1_000_000_000))
def q_early_stop_complete_load(spark, sf):
    """Watched all the way, and within its limit: the same rows as a load that is not watched."""
    return refused_load(spark, sf, 1_000_000_000, stop_early=True)


@query("all_rejected_generic_load", """
SELECT 'source' AS object, (SELECT count(*) FROM events) AS "rows", 'ok' AS status
UNION ALL SELECT 'error_rows', (SELECT count(*) FROM events), 'ok' UNION ALL SELECT 'target', 0, 'ok'
UNION ALL SELECT 'generic', NULL, 'complete'""")
def q_all_rejected_generic_load(spark, sf):
    root = scratch_path(spark, "all-rejected")
    result = loads.load_generic(
        spark, table(spark, sf, "events").withColumn("event_date", F.to_date("ts")), path=f"{root}/target",
        rules=[{"name": "any", "condition": F.col("event_id").isNotNull()}], partition_by=["event_date"],
        load_ts=I.LOAD_TS, error_path=f"{root}/errors")
    if result.output.count() or spark.read.parquet(f"{root}/errors").count() != result.metrics["errors"]:
        raise RuntimeError("all rows go to the error sink")
    return result.audit.to_frame(spark).filter("kind <> 'start'").select("object", "rows", "status")


# =============================================================== restartable ingest
ORDERS_SCHEMA = T.StructType([
    T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
    T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType()),
    T.StructField("o_orderdate", T.TimestampNTZType()),
    T.StructField("o_orderpriority", T.StringType()),
])

#: Each row is in the first drop whose condition holds; the last takes all others.
DROP_CASES = [("drop_1", "o_orderpriority in ('1-URGENT', '2-HIGH')"),
              ("drop_2", "o_orderpriority in ('3-MEDIUM', '4-NOT SPECIFIED')")]


def drops(orders):
    """The orders as three file drops, by name."""
    return routing.conditional_split(orders, [(n, F.expr(c)) for n, c in DROP_CASES], default="drop_3")


@query("restartable_ingest", "SELECT * FROM orders")
def q_restartable_ingest(spark, sf):
    root = scratch_path(spark, "restartable")
    orders = table(spark, sf, "orders")
    kw = dict(target=f"{root}/target", checkpoint=f"{root}/checkpoint", fmt="csv",
              options={"header": "true"}, load_ts=I.LOAD_TS)

    def drop(name):
        drops(orders)[name].write.option("header", "true").csv(f"{root}/incoming/{name}")

    drop("drop_1")
    drop("drop_2")
    ingest_new_files(spark, f"{root}/incoming/*/*.csv", ORDERS_SCHEMA, **kw)
    drop("drop_3")
    ingest_new_files(spark, f"{root}/incoming/*/*.csv", ORDERS_SCHEMA, **kw)
    ingest_new_files(spark, f"{root}/incoming/*/*.csv", ORDERS_SCHEMA, **kw)  # nothing new
    return spark.read.parquet(f"{root}/target").select(*ORDERS_SCHEMA.names)


HIGH_WATER_CUTS = ("1994-01-01", "1996-01-01", "2100-01-01")
HIGH_WATER_DAYS = 60


@query("high_water_extract", f"""
WITH v AS (SELECT o_orderkey, o_orderdate AS modified, o_orderkey % 5 = 0 AS late FROM orders
           WHERE o_orderdate IS NOT NULL),
r1 AS (SELECT * FROM v WHERE modified < TIMESTAMP '{HIGH_WATER_CUTS[0]}' AND NOT late),
h1 AS (SELECT max(modified) AS high FROM r1),
r2 AS (SELECT v.* FROM v LEFT JOIN h1 ON true
       WHERE modified < TIMESTAMP '{HIGH_WATER_CUTS[1]}' AND (NOT late OR modified < TIMESTAMP '{HIGH_WATER_CUTS[0]}')
         AND coalesce(modified >= high - INTERVAL {HIGH_WATER_DAYS} DAY, true)
         AND o_orderkey NOT IN (SELECT o_orderkey FROM r1)),
h2 AS (SELECT max(modified) AS high FROM (SELECT modified FROM r1 UNION ALL SELECT modified FROM r2)),
r3 AS (SELECT v.* FROM v LEFT JOIN h2 ON true
       WHERE coalesce(modified >= high - INTERVAL {HIGH_WATER_DAYS} DAY, true)
         AND o_orderkey NOT IN (SELECT o_orderkey FROM r1 UNION ALL SELECT o_orderkey FROM r2))
SELECT o_orderkey, modified, 1 AS run FROM r1 UNION ALL SELECT o_orderkey, modified, 2 FROM r2
UNION ALL SELECT o_orderkey, modified, 3 FROM r3""")
def q_high_water_extract(spark, sf):
    """Three extracts of a growing source; every fifth order arrives one extract late. Before the second, a load fails
    and commits nothing."""
    state = scratch_path(spark, "high-water")
    v = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("modified"))
    first, second, third = (F.col("modified") < _ntz(f"{cut} 00:00:00") for cut in HIGH_WATER_CUTS)
    late = F.col("o_orderkey") % 5 == 0
    arrived = [v.filter(first & ~late), v.filter(second & (~late | first)), v.filter(third)]
    out = []
    for run, rows in enumerate(arrived, 1):
        for committed in (False, True) if run == 2 else (True,):
            got = extract_new(rows, state, "orders", keys=["o_orderkey"], modified_column="modified",
                              lookback_days=HIGH_WATER_DAYS)
            if committed:
                got.commit()
        out.append(got.rows.select("o_orderkey", "modified", F.lit(run).alias("run")))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("restartable_ingest_two_sources", """
SELECT *, 1 AS times FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01 00:00:00'
UNION ALL SELECT *, 2 FROM orders WHERE NOT COALESCE(o_orderdate < TIMESTAMP '1995-01-01 00:00:00', false)""")
def q_restartable_ingest_two_sources(spark, sf):
    """Two sources with their own checkpoints fill one target; the second's checkpoint is then lost and begun anew,
    so its files come again, and overwrite nothing."""
    root = scratch_path(spark, "restartable-two")
    orders = table(spark, sf, "orders").select(*ORDERS_SCHEMA.names)
    old = F.coalesce(F.col("o_orderdate") < _ntz("1995-01-01 00:00:00"), F.lit(False))
    for name, rows in {"a": orders.filter(old), "b": orders.filter(~old)}.items():
        rows.write.option("header", "true").csv(f"{root}/{name}")
    for name, checkpoint in (("a", "one"), ("b", "two"), ("a", "one"), ("b", "two-again")):
        ingest_new_files(spark, f"{root}/{name}/*.csv", ORDERS_SCHEMA, target=f"{root}/target",
                         checkpoint=f"{root}/checkpoints/{checkpoint}", fmt="csv", options={"header": "true"},
                         load_ts=I.LOAD_TS)
    rows = spark.read.parquet(f"{root}/target")
    return rows.groupBy(*ORDERS_SCHEMA.names).agg(F.count(F.lit(1)).cast("int").alias("times"))


@query("restartable_ingest_malformed", """
WITH n AS (SELECT count(*) AS good FROM orders),
b AS (SELECT count(*) AS bad FROM orders WHERE o_totalprice < 5000)
SELECT 'valid' AS output, 'none' AS rules, good AS "rows" FROM n
UNION ALL SELECT 'error', 'bad_o_custkey', bad FROM b WHERE bad > 0
UNION ALL SELECT 'error', 'malformed_line', bad FROM b WHERE bad > 0
UNION ALL SELECT 'audit', 'read', good + 2 * bad FROM n, b
UNION ALL SELECT 'audit', 'error', 2 * bad FROM b
UNION ALL SELECT 'audit', 'write', good FROM n""")
def q_restartable_ingest_malformed(spark, sf):
    """Three drops; every cheap order comes twice more, with a bad key and as a short line."""
    root = scratch_path(spark, "restartable-malformed")
    orders = table(spark, sf, "orders").select(*ORDERS_SCHEMA.names)
    audit = f"{root}/audit"
    for k, (name, good) in enumerate(drops(orders).items()):
        text = good.select(*[F.col(c).cast("string").alias(c) for c in good.columns])
        text.write.option("header", "true").csv(f"{root}/incoming/{name}")
        cheap = text.filter("cast(o_totalprice as double) < 5000")
        cheap.withColumn("o_custkey", F.concat(F.lit("x"), "o_custkey")) \
            .write.option("header", "true").csv(f"{root}/incoming/{name}_key")
        cheap.select("o_orderkey", "o_custkey").write.option("header", "true") \
            .option("enforceSchema", "false").csv(f"{root}/incoming/{name}_short")
        ingest_new_files(spark, f"{root}/incoming/*/*.csv", ORDERS_SCHEMA, target=f"{root}/target",
                         checkpoint=f"{root}/checkpoint", options={"header": "true"}, load_ts=I.LOAD_TS,
                         error_path=f"{root}/errors", audit=AuditTrail("ingest", batch_id=f"run-{k}"),
                         audit_path=audit)
    valid = spark.read.parquet(f"{root}/target").agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit("valid").alias("output"), F.lit("none").alias("rules"), "rows")
    errors = (spark.read.parquet(f"{root}/errors").groupBy(F.array_join(ERROR_RULES, "|").alias("rules"))
              .agg(F.count(F.lit(1)).alias("rows")).select(F.lit("error").alias("output"), "rules", "rows"))
    trail = (spark.read.parquet(audit).filter("kind in ('read', 'error', 'write')").groupBy("kind")
             .agg(F.sum("rows").alias("rows"))
             .select(F.lit("audit").alias("output"), F.col("kind").alias("rules"), "rows"))
    return valid.unionByName(errors).unionByName(trail)


@query("restartable_ingest_routed", """
SELECT * FROM orders WHERE NOT COALESCE(o_totalprice < 5000, false)""")
def q_restartable_ingest_routed(spark, sf):
    root = scratch_path(spark, "restartable-routed")
    orders = table(spark, sf, "orders")
    kw = dict(target=f"{root}/target", checkpoint=f"{root}/checkpoint", fmt="csv",
              options={"header": "true"}, load_ts=I.LOAD_TS, error_path=f"{root}/errors",
              rules=[order_rules()[0]])
    for i, (name, rows) in enumerate(drops(orders).items()):
        rows.write.option("header", "true").csv(f"{root}/incoming/{name}")
        if i >= 1:       # first run after two drops, second after the third
            ingest_new_files(spark, f"{root}/incoming/*/*.csv", ORDERS_SCHEMA, **kw)
    ingest_new_files(spark, f"{root}/incoming/*/*.csv", ORDERS_SCHEMA, **kw)  # nothing new
    return spark.read.parquet(f"{root}/target").select(*ORDERS_SCHEMA.names)


@query("fact_load_rejected", f"""
WITH f AS ({FACT_JOINED_SQL})
SELECT l_orderkey, l_linenumber,
       concat_ws('|',
         CASE WHEN NOT hit_customer THEN 'missing_customer' END,
         CASE WHEN NOT hit_part THEN 'missing_part' END,
         CASE WHEN NOT hit_supplier THEN 'missing_supplier' END,
         CASE WHEN l_quantity > 48 THEN 'bulk_quantity' END) AS error_rules,
       'validation' AS stage, '{I.BATCH_ID}' AS batch_id
FROM f WHERE {FACT_ERROR_SQL}""")
def q_fact_load_rejected(spark, sf):
    result = run_fact_load(spark, sf)
    errors_path = f"{result.location.rsplit('/', 1)[0]}/errors/pipeline=fact_load"
    return spark.read.parquet(errors_path).select(
        "l_orderkey", "l_linenumber", F.array_join(ERROR_RULES, "|").alias("error_rules"),
        "stage", "batch_id")
