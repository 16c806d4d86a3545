"""Read counts come from committed files: a task that runs again, or a source that changes, does not alter them."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from loadkit.plans.loads import load_fact, load_flat_file, load_generic
from loadkit.plans.reads import counted_read, reads_files, rows_per_file
from loadkit.plans.steps import Steps

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

#: A detail whose first task attempts fail after all their rows went through, and which gives one row more each time
#: it is run as a whole.  Run with retries allowed, which the tests' own session has not.
RETRIES = """
import os, sys
from pyspark import TaskContext
from pyspark.sql import functions as F
from loadkit.session import build_session
from loadkit.plans.loads import load_dimension_scd1, load_fact

root = sys.argv[1]
spark = build_session("retries", master="local[2,4]", shuffle_partitions=3,
                      extra={"spark.checkpoint.dir": root + "/shared", "spark.sql.autoBroadcastJoinThreshold": "-1"})
spark.sparkContext.setLogLevel("OFF")

def flaky(frames):
    task = TaskContext.get()
    yield from frames
    if task.attemptNumber() == 0:
        raise RuntimeError("after the rows were counted")
    if task.partitionId() == 0:
        import pandas as pd
        runs = sum(n.startswith("run") for n in os.listdir(root))
        open(f"{root}/run{runs}", "w").close()
        yield pd.DataFrame({"k": [1] * runs})

detail = spark.range(0, 1000, 1, 4).selectExpr("id % 10 as k").mapInPandas(flaky, "k long")
primary = spark.range(0, 9, 1, 2).selectExpr("id as k", "id * 2 as v")
found = load_fact(spark, detail, primary, join_on="k", path=root + "/fact").metrics
assert len([n for n in os.listdir(root) if n.startswith("run")]) == 1, "the source was run once"
assert found == {"detail": 1000, "primary": 9, "joined": 900, "dropped": 100, "errors": 0, "written": 900}, found
spark.sql("create table dim using parquet as select 1L as k, 0L as created_date where false")
source = detail.withColumn("created_date", F.lit(0).cast("long"))
found = load_dimension_scd1(spark, source, table="dim", root=root + "/dim", keys=["k"],
                            order_columns=["created_date"]).metrics
assert (found["read"], found["dropped"], found["valid"]) == (1001, 991, 10), found
print("exact")
"""


def test_failed_tasks_and_changing_sources_do_not_alter_counts(tmp_path):
    done = subprocess.run([sys.executable, "-c", RETRIES, str(tmp_path)], cwd=tmp_path, capture_output=True, text=True,
                          timeout=300, env={**os.environ, "PYTHONPATH": ROOT})
    assert done.stdout.strip().endswith("exact"), done.stderr[-3000:]


def two_files(spark, path):
    spark.range(3).coalesce(1).write.parquet(f"{path}/a")
    spark.range(10, 15).coalesce(1).write.parquet(f"{path}/b")
    return spark.read.parquet(f"{path}/a", f"{path}/b")


def test_rows_of_each_file(spark, tmp_shared):
    df = two_files(spark, tmp_shared)
    found = rows_per_file(df.filter("id <> 11").withColumn("x", F.lit(1)), "feed").collect()
    assert sorted((r.source, r.file_path.split("/")[-2], r.rows) for r in found) == [("feed", "a", 3), ("feed", "b", 4)]


def test_a_count_of_parquet_reads_footers_only(spark, tmp_shared):
    plan = two_files(spark, tmp_shared).groupBy().count()._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan


def test_what_is_written_first(spark, tmp_shared):
    df, steps = two_files(spark, tmp_shared), Steps(spark, None, "b")
    assert reads_files(df) and reads_files(df.select((F.col("id") + 1).alias("n")).filter("n > 2"))
    other = [spark.range(3), df.union(df), df.groupBy("id").count(), df.join(df.withColumnRenamed("id", "j"), F.expr("id = j"))]
    for frame in other:
        assert not reads_files(frame)
    assert counted_read(df, "s", steps).staged == []
    taken = counted_read(df.union(df), "s", steps)
    assert taken.rows == 16 and len(taken.staged) == 1 and taken.frame.count() == 16
    assert [tuple(r) for r in taken.files.collect()] == [("s", None, 16)]
    assert counted_read(df.union(df), "s", steps, snapshot=False).staged == []
    assert counted_read(df, "s", steps, snapshot=True).rows == 8
    empty = counted_read(spark.range(0), "s", steps)
    assert empty.rows == 0 and empty.frame.columns == ["id"] and empty.frame.count() == 0


def test_own_column_named_like_the_metadata(spark):
    df = spark.createDataFrame([("x", 1)], "_metadata string, id int")
    assert counted_read(df, "s", Steps(spark, None, "b")).rows == 1


def test_a_load_tells_its_files(spark, tmp_path, tmp_shared):
    (tmp_path / "a.csv").write_text("k,v\n1,2\n3,x\n")
    (tmp_path / "b.csv").write_text("k,v\n5,6\n")
    result = load_flat_file(spark, str(tmp_path), ["k", "v"], path=f"{tmp_shared}/t", conversions={"v": "int"})
    found = sorted((r.source, r.file_path.split("/")[-1], r.rows) for r in result.read_files.collect())
    assert found == [("file", "a.csv", 2), ("file", "b.csv", 1)] and result.metrics["errors"] == 1
    df = two_files(spark, f"{tmp_shared}/in")
    result = load_fact(spark, df, spark.range(3), join_on="id", path=f"{tmp_shared}/fact")
    found = sorted(((r.source, r.file_path and r.file_path.split("/")[-2], r.rows) for r in result.read_files.collect()))
    assert found == [("detail", "a", 3), ("detail", "b", 5), ("primary", None, 3)]
    assert result.metrics["dropped"] == 5 and len(result.staged) == 2


@pytest.mark.parametrize("bad, rows", [("true", 0), ("false", 8), ("id > 10", 4)])
def test_routes_are_counted_from_the_staged_files(spark, tmp_shared, bad, rows):
    rules = [{"name": "bad", "condition": F.expr(bad), "message": "bad"}]
    result = load_generic(spark, two_files(spark, tmp_shared), path=f"{tmp_shared}/t", rules=rules)
    assert result.metrics == {"read": 8, "errors": 8 - rows, "written": rows}


def test_null_join_keys_are_dropped_before_the_join(spark, tmp_shared):
    detail = spark.sql("select if(id < 60, null, id % 10) k, if(id % 2 = 0, 'a', null) j, id from range(90)")
    primary = spark.sql("select id k, 'a' j from range(9) union all select null, null")
    result = load_fact(spark, detail, primary, join_on=["k", "j"], path=f"{tmp_shared}/fact")
    expected = detail.filter("k is not null and j is not null and k < 9").count()
    assert result.metrics["written"] == expected == result.output.count()
    assert result.metrics["dropped"] == 90 - expected and result.audit.count("read", "detail") == 90
    result = load_fact(spark, detail.filter("k is null"), primary.drop("j"), join_on="k", path=f"{tmp_shared}/none")
    assert (result.metrics["dropped"], result.metrics["written"]) == (60, 0)
