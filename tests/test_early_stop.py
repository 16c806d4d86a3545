"""A load is stopped while it is staged once its bad rows pass the limit."""

import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from loadkit.operators.routing import ErrorLimitExceeded
from loadkit.plans import loads
from loadkit.plans.audit import AuditTrail
from loadkit.plans.early_stop import rows_by_partition
from loadkit.session import path_exists


def rules(bound):
    return [{"name": "low", "condition": F.col("id") < bound, "message": "too low"}]


def generic(spark, root, source, bound, limit, **kw):
    audit = AuditTrail("generic", batch_id="b")
    kw = {"stop_early": True} | kw
    return loads.load_generic(spark, source, path=f"{root}/target", rules=rules(bound), error_limit=limit,
                              error_path=f"{root}/errors", audit=audit, **kw), audit


def counted_tasks(spark, slow=0.0):
    """(a step that counts the tasks that ran through it, the count)"""
    ran = spark.sparkContext.accumulator(0)

    def through(batches):
        for b in batches:
            time.sleep(slow)
            yield b
        ran.add(1)

    return (lambda df: df.mapInArrow(through, df.schema)), ran


def test_bad_rows_first_stop_the_load_after_few_tasks(spark, tmp_shared):
    step, ran = counted_tasks(spark, slow=0.2)
    source = spark.range(0, 4000, 1, 200)  # 200 tasks of 20 rows, the first 10 all bad
    audit = AuditTrail("generic", batch_id="b")
    with pytest.raises(ErrorLimitExceeded, match="stopped early"):
        loads.load_generic(spark, source, steps=[step], path=f"{tmp_shared}/target", rules=rules(200), error_limit=50,
                           error_path=f"{tmp_shared}/errors", stop_early=True, audit=audit,
                           audit_path=f"{tmp_shared}/audit")
    assert ran.value < 60
    assert not path_exists(spark, f"{tmp_shared}/target") and not path_exists(spark, f"{tmp_shared}/errors")
    assert audit.status == "failed"
    last = spark.read.parquet(f"{tmp_shared}/audit").orderBy(F.desc("seq")).first()
    assert last.status == "failed" and "stopped early" in last.message


@pytest.mark.parametrize("limit", [10, 25])
def test_within_the_limit_it_changes_nothing(spark, tmp_shared, limit):
    got, audit = generic(spark, tmp_shared, spark.range(0, 100, 1, 7), 10, limit)
    assert got.metrics == {"read": 100, "errors": 10, "written": 90} and audit.status == "complete"
    assert sorted(r.id for r in got.output.collect()) == list(range(10, 100))
    assert spark.read.parquet(f"{tmp_shared}/errors").count() == 10


def test_a_limit_passed_by_the_last_task_is_refused_all_the_same(spark, tmp_shared):
    with pytest.raises(ErrorLimitExceeded):
        generic(spark, tmp_shared, spark.range(0, 20, 1, 1), 5, 4)
    assert not path_exists(spark, f"{tmp_shared}/target")


def test_other_failures_stay_what_they_are(spark, tmp_shared):
    with pytest.raises(Exception, match="broken row"):
        generic(spark, tmp_shared, spark.range(5).filter(F.raise_error(F.lit("broken row")).isNull()), 3, 100)


def test_a_task_that_runs_again_is_counted_once(tmp_path):
    """On a session of its own whose tasks may fail: each task fails once, after its rows were counted."""
    code = f"""
import os
from pyspark import TaskContext
from pyspark.sql import functions as F
from loadkit.session import build_session
from loadkit.plans.staging import route_and_stage
from loadkit.plans import early_stop
spark = build_session("t", master="local[2,3]", extra={{"spark.checkpoint.dir": {str(tmp_path)!r}}})
found = []
real = early_stop.EarlyStop.__init__
early_stop.EarlyStop.__init__ = lambda self, *a: (real(self, *a), found.append(self))[0]
def once(batches):
    yield from batches
    mark = {str(tmp_path)!r} + f"/ran-{{TaskContext.get().partitionId()}}"
    if not os.path.exists(mark):
        open(mark, "w").close()
        raise RuntimeError("a lost task")
df = spark.range(0, 40, 1, 4).mapInArrow(once, "id long")
rules = [dict(name="low", condition=F.col("id") % 2 == 0, message="even")]
routed, _ = route_and_stage(df, rules, "t", stop_over=20)
print("FOUND", routed.rows, routed.error_rows, found[0].errors)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert "FOUND 40 20 20" in out.stdout, out.stderr[-2000:]


def test_flat_files_stop_early(spark, tmp_shared):
    spark.range(0, 400, 1, 20).select(F.concat(F.lit("x"), "id").alias("a")).write.csv(f"{tmp_shared}/in")
    audit = AuditTrail("flat", batch_id="b")
    with pytest.raises(ErrorLimitExceeded):
        loads.load_flat_file(spark, f"{tmp_shared}/in", ["a"], path=f"{tmp_shared}/target", header=False,
                             conversions={"a": "int"}, error_limit=30, stop_early=True, audit=audit)
    assert audit.status == "failed" and not path_exists(spark, f"{tmp_shared}/target")


def test_a_repeated_count_is_taken_by_partition(spark):
    found = rows_by_partition(spark)
    for n in ({1: 5}, {1: 5}, {2: 3}, {1: 2}):
        found.add(n)
    assert found.value == {1: 5, 2: 3}
