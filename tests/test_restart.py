"""Loads that go on behind their last finished step."""

import pytest
from pyspark.sql import functions as F

from loadkit.catalog.load_queries import unreadable
from loadkit.operators.routing import ErrorLimitExceeded
from loadkit.plans import loads
from loadkit.plans.audit import AuditTrail
from loadkit.plans.steps import StepMismatch, Steps
from loadkit.sinks import batches, buckets


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def killed(*_, **__):
    raise RuntimeError("killed")


def reused(audit):
    return [r[4] for r in audit.records if r[6] == "reuse"]


def generic(spark, root, source, rules=(), **kw):
    audit = AuditTrail("generic", batch_id="b")
    kw = {"once": True, "error_path": f"{root}/errors"} | kw
    return loads.load_generic(spark, source, path=f"{root}/target", rules=rules, audit=audit,
                              steps_path=f"{root}/steps", **kw), audit


def test_a_step_runs_once(spark, tmp_shared):
    ran, seen = [], []
    steps = Steps(spark, tmp_shared, "b", on_reuse=seen.append)
    assert [steps.once("x", lambda: ran.append(1) or {"n": 3}) for _ in range(3)] == [{"n": 3}] * 3
    assert ran == [1] and seen == ["x", "x"]
    assert Steps(spark, tmp_shared, "c").done("x") is None
    with pytest.raises(RuntimeError):
        steps.once("y", killed)
    assert steps.done("y") is None
    nothing_kept = Steps(spark, None, "b")
    assert [nothing_kept.once("x", lambda: {"n": k}) for k in (1, 2)] == [{"n": 1}, {"n": 2}]


@pytest.mark.parametrize("dies", ["before", "after"])
@pytest.mark.parametrize("once", [True, False])
def test_a_load_whose_write_died_does_not_read_its_source_again(spark, tmp_shared, monkeypatch, dies, once):
    source = spark.range(30).select("id", F.when(F.col("id") % 3 > 0, F.col("id")).alias("v"))
    rules = [{"name": "no_v", "condition": F.col("v").isNull(), "message": "v is missing"}]
    with monkeypatch.context() as m:
        if dies == "before":
            m.setattr(loads, "append_batch" if once else "append", killed)
        else:
            m.setattr(loads, "read_batches" if once else "_read_target", killed)
        with pytest.raises(RuntimeError, match="killed"):
            generic(spark, tmp_shared, source, rules, once=once)
    for run in (1, 2):
        result, audit = generic(spark, tmp_shared, unreadable(source), rules, once=once)
        assert rows(result.output) == [(k, k) for k in range(30) if k % 3]
        assert result.metrics == {"read": 30, "errors": 10, "written": 20}
        assert reused(audit) == ["stage", "errors"] + (["write"] if run == 2 or dies == "after" else [])
    folder = f"{tmp_shared}/errors/pipeline=generic"
    errors = (batches.read_batches(spark, folder, spark.createDataFrame([], "id long").schema) if once
              else spark.read.parquet(folder))
    assert errors.count() == 10


def test_a_refused_load_goes_on_with_a_higher_limit(spark, tmp_shared):
    source = spark.range(10)
    rules = [{"name": "low", "condition": F.col("id") < 4, "message": "too low"}]
    with pytest.raises(ErrorLimitExceeded):
        generic(spark, tmp_shared, source, rules, error_limit=3)
    result, audit = generic(spark, tmp_shared, unreadable(source), rules, error_limit=4)
    assert rows(result.output) == [(k,) for k in range(4, 10)] and reused(audit) == ["stage"]


def test_other_columns_and_lost_staging_are_refused(spark, tmp_shared, monkeypatch):
    first, _ = generic(spark, tmp_shared, spark.range(3))
    with pytest.raises(StepMismatch, match="other columns"):
        generic(spark, tmp_shared, spark.range(3).withColumn("more", F.lit(1)))
    monkeypatch.setattr("loadkit.plans.steps.path_exists", lambda *_: False)
    with pytest.raises(StepMismatch, match="gone"):
        generic(spark, tmp_shared, spark.range(3))
    assert rows(first.output) == [(0,), (1,), (2,)]


def test_an_empty_load_restarts(spark, tmp_shared):
    for _ in range(2):
        result, _ = generic(spark, tmp_shared, spark.range(0))
        assert result.output.count() == 0 and result.metrics["read"] == 0


@pytest.mark.parametrize("kind", ["scd1", "scd2"])
def test_a_dimension_load_restarts_before_and_after_its_merge(spark, tmp_shared, monkeypatch, kind):
    source = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (2, "x", 1), (None, "n", 1)], "k long, v string, m int")
    if kind == "scd2":
        start = spark.sql("SELECT 1L AS k, 'a' AS v, DATE '2024-01-01' AS effective_date, "
                          "DATE '9999-12-31' AS end_date, 1 AS is_current")
        load, more = loads.load_dimension_scd2, {"tracked": ["v"], "as_of": "2024-06-01"}
    else:
        start, load, more = spark.sql("SELECT 1L AS k, 'a' AS v"), loads.load_dimension_scd1, {}
    dim = buckets.create_bucketed(start, f"{tmp_shared}/d", ["k"], 4)

    def run(src):
        audit = AuditTrail("dim", batch_id="b")
        return load(spark, src, table=dim, keys=["k"], order_columns=["m"], audit=audit,
                    error_path=f"{tmp_shared}/errors", steps_path=f"{tmp_shared}/steps", **more), audit

    with monkeypatch.context() as m:
        m.setattr(type(dim), "merge", killed)
        with pytest.raises(RuntimeError, match="killed"):
            run(source)
    result, audit = run(unreadable(source))
    assert reused(audit) == ["read", "stage", "errors"] and audit.count("read") == 4
    now = result.output.filter("is_current = 1") if kind == "scd2" else result.output
    assert rows(now.select("k", "v")) == [(1, "c"), (2, "x")]
    version = dim.version()
    again, audit = run(unreadable(source))
    assert reused(audit) == ["read", "stage", "errors", "publish"] and dim.version() == version
    assert rows(again.output) == rows(result.output) and again.metrics == result.metrics


def test_a_fact_load_keeps_its_counts_and_keys(spark, tmp_shared, monkeypatch):
    detail = spark.range(20).select(F.col("id").alias("o"), (F.col("id") % 4).alias("q"))
    primary = spark.range(15).select(F.col("id").alias("o"), F.lit("p").alias("name"))

    def run(d, p):
        audit = AuditTrail("fact", batch_id="b")
        return loads.load_fact(spark, d, p, join_on="o", path=f"{tmp_shared}/f", audit=audit, once=True,
                               steps_path=f"{tmp_shared}/steps")

    with monkeypatch.context() as m:
        m.setattr(loads, "append_batch", killed)
        with pytest.raises(RuntimeError, match="killed"):
            run(detail, primary)
    got = run(unreadable(detail), unreadable(primary))
    assert got.metrics == {"detail": 20, "primary": 15, "joined": 15, "dropped": 5, "errors": 0, "written": 15}
    assert sorted(r.fact_sk for r in got.output.collect()) == list(range(1, 16))
