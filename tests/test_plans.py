"""Plan shape: the physical plans we rely on for scale."""

import re

from pyspark.sql import functions as F

from loadkit.catalog import QUERIES
from loadkit.catalog import inputs as I
from loadkit.operators import lookups, routing, scd, transforms
from loadkit.sinks import tables
from loadkit.sources import readers
from tests.conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df) -> str:
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_lookup_broadcasts_small_dimension(spark):
    matched = QUERIES["lookup_matched"](spark, SF_SMALL)
    assert "BroadcastHashJoin" in formatted(matched)


def test_lookup_falls_back_to_shuffle_beyond_bound(spark):
    li = I.table(spark, SF_SMALL, "lineitem")
    dim = I.table(spark, SF_SMALL, "orders")
    m, _ = lookups.lookup(li, dim, {"l_orderkey": "o_orderkey"}, ["o_custkey"],
                          max_broadcast_rows=100)
    text = formatted(m)
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text


def test_dedup_limits_before_shuffle(spark):
    text = formatted(QUERIES["dedup_keep_last"](spark, SF_SMALL))
    # a partial group limit runs before the exchange on the key
    assert text.count("WindowGroupLimit") >= 2


def test_incremental_extract_pushes_filter(spark):
    text = formatted(QUERIES["incremental_extract"](spark, SF_SMALL))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", text)


def test_table_scan_prunes_columns(spark):
    text = formatted(QUERIES["table_scan"](spark, SF_SMALL))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert schema.count(":") == 4


def test_scd2_is_one_join_and_history_does_not_shuffle(spark):
    out = scd.scd2_merge(I.scd2_target(spark, SF_SMALL), I.scd2_source(spark, SF_SMALL),
                         ["business_key"], I.SCD2_TRACKED, I.AS_OF, check_source_unique=False,
                         broadcast_source=False)
    text = plan(out)
    assert text.count("SortMergeJoin") == 1
    assert "FullOuter" in text
    # the join's two inputs are the only ones that move: closed history is a bare scan below the union
    assert text.count("Exchange hashpartitioning") == 2
    depth = {n: len(line) - len(line.lstrip(" :+-*()0123456789")) for line in text.splitlines()
             for n in ("Union", "SortMergeJoin", "Exchange hashpartitioning") if n in line}
    assert depth["Union"] < depth["SortMergeJoin"] < depth["Exchange hashpartitioning"]


def test_surrogate_keys_never_single_partition(spark):
    li = I.table(spark, SF_SMALL, "lineitem")
    out = transforms.assign_surrogate_keys(li, "sk", order_by=["l_orderkey", "l_linenumber",
                                                              "l_shipdate", "l_partkey"])
    text = plan(out)
    # only the ranges' row counts (one row a range) meet in one partition
    assert text.count("SinglePartition") == 1
    assert "HashAggregate(keys=[_sk_pid" in text.split("SinglePartition")[1].split("Exchange")[0]
    assert out.rdd.getNumPartitions() > 1


def test_partitioned_write_rebalances(spark, tmp_shared, monkeypatch):
    """``append`` itself writes a frame rebalanced on its partition columns."""
    written = []
    real = tables._writer
    monkeypatch.setattr(tables, "_writer", lambda df, *a: written.append(plan(df)) or real(df, *a))
    o = I.table(spark, SF_SMALL, "orders").withColumn("date_sk", F.year("o_orderdate"))
    tables.append(o, f"{tmp_shared}/t", partition_by=["date_sk"])
    assert "REBALANCE_PARTITIONS_BY_COL" in written[0]
    # a value's rows are in few files, not one per input task
    assert spark.read.parquet(f"{tmp_shared}/t").select(F.input_file_name()).distinct().count() <= 2 * 7


def test_error_conditions_reach_the_scan(spark):
    c = I.table(spark, SF_SMALL, "customer")
    _, errors = routing.route_errors(c, [
        {"name": "neg", "condition": F.col("c_acctbal") < 0},
        {"name": "seg", "condition": F.col("c_mktsegment") == "AUTOMOBILE"}])
    pushed = re.search(r"PushedFilters: \[(.*)\]", formatted(errors)).group(1)
    assert "LessThan(c_acctbal,0.0)" in pushed and "EqualTo(c_mktsegment,AUTOMOBILE)" in pushed


def test_fact_load_never_scans_its_target(spark, tmp_shared):
    """The next keys come from the state table, not from the written rows."""
    from loadkit.plans import loads
    path = f"{tmp_shared}/fact"
    d = I.table(spark, SF_SMALL, "lineitem").select("l_orderkey", "l_linenumber")
    p = I.table(spark, SF_SMALL, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    first = loads.load_fact(spark, d, p, join_on="l_orderkey", path=path).metrics["written"]
    # a state far ahead of the rows shows which of the two is read
    loads._reserve_keys(spark, path, "other", 10 ** 9)
    out = loads.load_fact(spark, d, p, join_on="l_orderkey", path=path).output
    assert out.agg(F.max("fact_sk")).first()[0] == 10 ** 9 + first
    assert out.select("fact_sk").distinct().count() == out.count() == 2 * first


def test_lookups_share_one_broadcast_budget(spark, monkeypatch):
    dims = [{"name": n, "dim": I.table(spark, SF_SMALL, t), "on": {f: k}, "columns": {c: f"out_{n}"}}
            for n, t, f, k, c in (("part", "part", "l_partkey", "p_partkey", "p_brand"),
                                  ("supp", "supplier", "l_suppkey", "s_suppkey", "s_name"))]
    li = I.table(spark, SF_SMALL, "lineitem")
    assert formatted(lookups.multi_lookup(li, dims)).count(" BroadcastHashJoin ") >= 2
    side = lookups.assert_unique(I.table(spark, SF_SMALL, "part").select("p_partkey", "p_brand"), ["p_partkey"])
    monkeypatch.setattr(lookups, "DEFAULT_BROADCAST_BYTES", side[1] + 300)
    text = formatted(lookups.multi_lookup(li, dims))
    assert "SortMergeJoin" in text and "BroadcastHashJoin" in text


def test_fixed_width_reader_is_one_projection(spark, tmp_shared):
    spark.createDataFrame([("  12abc",)], "value string").write.text(tmp_shared)
    df = readers.read_fixed_width(spark, tmp_shared, [("n", 4), ("s", 3)])
    assert [tuple(r)[:2] for r in df.collect()] == [("12", "abc")]


def test_scd_broadcast_source_moves_no_target_rows(spark):
    out = scd.scd1_merge(I.scd1_target(spark, SF_SMALL), I.scd1_source(spark, SF_SMALL),
                         ["p_partkey"], ["created_date"], broadcast_source=True)
    text = plan(out)
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text
    # nothing of the target moves but the keys it shares with the source, made distinct before they do
    assert text.count("Exchange hashpartitioning") == 1
    below = text.split("Exchange hashpartitioning")[1]
    assert below.index("HashAggregate") < below.index("LeftSemi")
