"""Loads and ingest without rows, without valid rows, and with rows that must not pass."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadkit.catalog import inputs as I
from loadkit.operators import scd
from loadkit.operators.lookups import DuplicateLookupKey
from loadkit.plans import loads
from loadkit.plans.audit import AuditTrail
from loadkit.sinks import tables as sinks
from loadkit.streaming.ingest import ingest_new_files
from tests.conftest import SF_SMALL

def reject_all():
    return [{"name": "all", "condition": F.lit(True)}]


def ends(audit):
    assert audit.records[-1][6] == "end" and [r[6] for r in audit.records].count("end") == 1
    return audit.status


@pytest.mark.parametrize("rules", [False, True])
@pytest.mark.parametrize("rows", [0, 20])
@pytest.mark.parametrize("parts", [None, ["k"]])
def test_generic(spark, tmp_shared, rules, rows, parts):
    src = spark.range(rows).select("id", (F.col("id") % 3).alias("k"))
    audit = AuditTrail("g")
    got = loads.load_generic(spark, src, path=f"{tmp_shared}/t", rules=reject_all() if rules else [],
                             partition_by=parts, audit=audit)
    want = 0 if rules else rows
    assert got.output.count() == want == got.metrics["written"] and ends(audit) == "complete"
    assert got.output.columns == src.columns
    assert (audit.count("read"), audit.count("error"), audit.count("write")) == (rows, rows - want, want)


@pytest.mark.parametrize("case", ["no_detail", "no_primary", "no_match", "rejected"])
def test_fact(spark, tmp_shared, case):
    day = dt.datetime(2024, 1, 2)
    detail = spark.createDataFrame([(k, 1.0) for k in range(10)], "k long, v double")
    primary = spark.createDataFrame([(k, day) for k in range(10)], "k long, d timestamp_ntz")
    detail = detail.limit(0) if case == "no_detail" else detail
    primary = primary.filter("k < 0") if case == "no_primary" else primary
    primary = primary.withColumn("k", F.col("k") + 100) if case == "no_match" else primary
    audit = AuditTrail("f")
    got = loads.load_fact(spark, detail, primary, join_on="k", path=f"{tmp_shared}/f", date_column="d",
                          rules=reject_all() if case == "rejected" else [], audit=audit)
    m = got.metrics
    assert got.output.count() == 0 and ends(audit) == "complete"
    assert m["detail"] == (0 if case == "no_detail" else 10) and m["primary"] == (0 if case == "no_primary" else 10)
    assert m["dropped"] == audit.count("dropped") == (10 if case in ("no_primary", "no_match") else 0)
    assert m["errors"] == (10 if case == "rejected" else 0)
    # the next batch starts at key 1
    more = loads.load_fact(spark, spark.createDataFrame([(1, 1.0)], "k long, v double"),
                           spark.createDataFrame([(1, day)], "k long, d timestamp_ntz"),
                           join_on="k", path=f"{tmp_shared}/f", date_column="d")
    assert [r.fact_sk for r in more.output.collect()] == [1]


def test_fact_batch_again_replaces_its_partitions(spark, tmp_shared):
    detail = spark.createDataFrame([(k, 1.0) for k in range(10)], "k long, v double")
    primary = spark.createDataFrame([(k, dt.datetime(2024, 1, 1 + k % 2)) for k in range(10)], "k long, d timestamp_ntz")
    for _ in range(2):
        got = loads.load_fact(spark, detail, primary, join_on="k", path=f"{tmp_shared}/f", date_column="d",
                              replace_partitions=True)
    assert got.output.count() == 10 and got.output.agg(F.min("fact_sk")).first()[0] == 11


def test_dimension_scd1_without_rows(spark, tmp_shared):
    name = "dim_empty_" + tmp_shared.rsplit("-", 1)[-1]
    sinks.publish_version(spark, I.scd1_target(spark, SF_SMALL), name, tmp_shared)
    source = I.scd1_target(spark, SF_SMALL).filter("p_partkey < 0").withColumn("modified_date", F.lit(1))
    audit = AuditTrail("d")
    got = loads.load_dimension_scd1(spark, source, table=name, root=tmp_shared, keys=["p_partkey"],
                                    order_columns=["modified_date"], audit=audit)
    assert got.output.count() == I.scd1_target(spark, SF_SMALL).count() and ends(audit) == "complete"
    # every row rejected: the table stays, too
    bad = I.scd1_target(spark, SF_SMALL).withColumn("modified_date", F.lit(1))
    got = loads.load_dimension_scd1(spark, bad, table=name, root=tmp_shared, keys=["p_partkey"], rules=reject_all(),
                                    order_columns=["modified_date"])
    assert got.output.exceptAll(I.scd1_target(spark, SF_SMALL)).count() == 0


def test_null_key_rows_carry_every_failed_rule(spark, tmp_shared):
    name = "dim_null_" + tmp_shared.rsplit("-", 1)[-1]
    spark.createDataFrame([(1, "a")], "k long, v string").write.saveAsTable(name, path=f"{tmp_shared}/v0")
    src = spark.createDataFrame([(None, "bad", 1), (2, "b", 1)], "k long, v string, at long")
    loads.load_dimension_scd1(spark, src, table=name, root=tmp_shared, keys=["k"], order_columns=["at"],
                              rules=[{"name": "bad_v", "condition": F.col("v") == "bad"}],
                              error_path=f"{tmp_shared}/e")
    errors = spark.read.parquet(f"{tmp_shared}/e").collect()
    assert [r.error_rules for r in errors] == [["null_key", "bad_v"]]


def test_header_only_file(spark, tmp_shared):
    spark.createDataFrame([], "a string, b string").coalesce(1).write.option("header", "true").csv(f"{tmp_shared}/in")
    audit = AuditTrail("flat")
    got = loads.load_flat_file(spark, f"{tmp_shared}/in", ["a", "b"], path=f"{tmp_shared}/t",
                               conversions={"a": "int"}, audit=audit)
    assert got.output.count() == 0 and dict(got.output.dtypes)["a"] == "int" and ends(audit) == "complete"


def test_failure_message_is_whole_and_timed(spark):
    audit = AuditTrail("x")
    audit.start()
    audit.fail("m" * 5000)
    last = audit.to_frame(spark).orderBy("seq").collect()[-1]
    assert last.message == "m" * 5000 and last.ts is not None


def test_scd2_two_current_rows_raise(spark):
    target = I.scd2_target(spark, SF_SMALL)
    twice = target.unionAll(target.filter("is_current = 1").limit(1))
    with pytest.raises(DuplicateLookupKey):
        scd.scd2_merge(twice, I.scd2_source(spark, SF_SMALL), ["business_key"], I.SCD2_TRACKED, I.AS_OF)


def test_scd1_repeated_target_keys_stay_repeated(spark):
    target = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string")
    source = spark.createDataFrame([(1, "new"), (3, "d")], "k long, v string")
    for broadcast in (True, False):
        got = scd.scd1_merge(target, source, ["k"], broadcast_source=broadcast)
        assert sorted(map(tuple, got.collect())) == [(1, "new"), (1, "new"), (2, "c"), (3, "d")]


SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.DoubleType())])


def lines(spark, path, text):
    spark.createDataFrame([(x,) for x in text], "value string").coalesce(1).write.text(path)


def test_ingest_never_writes_a_silent_null(spark, tmp_shared):
    lines(spark, f"{tmp_shared}/in/1", ["1,1.5", "zz,2.0", "3", "4,4.5,9"])
    audit = AuditTrail("in")
    kw = dict(target=f"{tmp_shared}/t", checkpoint=f"{tmp_shared}/c", error_path=f"{tmp_shared}/e")
    got = ingest_new_files(spark, f"{tmp_shared}/in/*", SCHEMA, audit=audit, **kw)
    assert got == {"rows": 4, "errors": 3, "written": 1, "batches": 1}
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_shared}/t").select("a", "b").collect()] == [(1, 1.5)]
    rules = {r for x in spark.read.parquet(f"{tmp_shared}/e").collect() for r in x.error_rules}
    assert rules == {"malformed_line", "bad_a"}
    assert (audit.count("read"), audit.count("error"), audit.count("write")) == (4, 3, 1)
    # rules added later: the next rows are visible like the first
    lines(spark, f"{tmp_shared}/in/2", ["5,5.5", "6,-1"])
    ingest_new_files(spark, f"{tmp_shared}/in/*", SCHEMA, rules=[{"name": "neg", "condition": F.col("b") < 0}], **kw)
    assert {r.a for r in spark.read.parquet(f"{tmp_shared}/t").collect()} == {1, 5}


def test_ingest_without_error_path_stops(spark, tmp_shared):
    lines(spark, f"{tmp_shared}/in/1", ["zz,2.0"])
    audit = AuditTrail("in")
    kw = dict(target=f"{tmp_shared}/t", checkpoint=f"{tmp_shared}/c")
    with pytest.raises(Exception, match="limit") as caught:
        ingest_new_files(spark, f"{tmp_shared}/in/*", SCHEMA, audit=audit, audit_path=f"{tmp_shared}/a", **kw)
    assert audit.status == "failed" and not isinstance(caught.value, AssertionError)
    trail = spark.read.parquet(f"{tmp_shared}/a").collect()
    assert [r.status for r in sorted(trail, key=lambda r: r.seq)][-1] == "failed"
    assert audit.count("read") == audit.count("error") == 1
    # the refused batch is taken again
    assert ingest_new_files(spark, f"{tmp_shared}/in/*", SCHEMA, error_limit=5, **kw)["errors"] == 1


def test_ingest_counts_beyond_the_progress_buffer(spark, tmp_shared):
    for k in range(103):
        with open(f"{_local(tmp_shared)}/{k}.csv", "w") as f:
            f.write(f"{k},1.0\n")
    got = ingest_new_files(spark, f"{tmp_shared}/*.csv", SCHEMA, target=f"{tmp_shared}-t",
                           checkpoint=f"{tmp_shared}-c", max_files_per_trigger=1)
    assert got == {"rows": 103, "errors": 0, "written": 103, "batches": 103}


def _local(path):
    import os

    from loadkit.session import local_path
    os.makedirs(local_path(path), exist_ok=True)
    return local_path(path)


def test_ingest_refuses_a_streaming_sinks_folder(spark, tmp_shared):
    lines(spark, f"{tmp_shared}/t/_spark_metadata/0", ["v1"])
    with pytest.raises(ValueError, match="streaming file sink"):
        ingest_new_files(spark, f"{tmp_shared}/in/*", SCHEMA, target=f"{tmp_shared}/t", checkpoint=f"{tmp_shared}/c")


def test_overwrite_replaces(spark, tmp_shared):
    from loadkit import compat
    for _ in range(2):
        compat.write_delta(spark.range(5), f"{tmp_shared}/t", mode="overwrite")
    assert spark.read.parquet(f"{tmp_shared}/t").count() == 5



def test_a_cluster_without_a_shared_folder_is_refused():
    from loadkit import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
