"""One key holding a third of the rows: results stay whole, plans split or pre-reduce it."""

import pytest
from pyspark.sql import functions as F

from loadkit.operators import checks, lookups, transforms

SKEW_CONF = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
}


@pytest.fixture
def skewed(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    n = 30_000
    facts = spark.range(n).select(
        F.col("id").alias("fid"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 97 + 1).alias("fk"),
        (F.col("id") % 11).alias("ts"))
    yield facts, n
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_shuffle_lookup_splits_hot_key(spark, skewed):
    facts, n = skewed
    dim = spark.range(0, 98).select(F.col("id").alias("dk"), (F.col("id") * 10).alias("v"))
    lab = lookups.lookup_labelled(facts, dim, {"fk": "dk"}, ["v"], broadcast=False)
    plan = final_plan(lab)
    assert "SortMergeJoin" in plan and "skew=true" in plan
    assert lab.count() == n and lab.filter("_lookup_hit").count() == n


def test_dedup_and_duplicate_check_pre_reduce_hot_key(spark, skewed):
    facts, n = skewed
    d = transforms.deduplicate(facts, ["fk"], ["ts"], keep="last")
    plan = final_plan(d)
    assert plan.count("WindowGroupLimit") >= 2
    assert d.count() == 98
    dup = checks.duplicate_check(facts, ["fk"])
    assert dup.filter("fk = 0").first()["dup_count"] == n // 3
    assert "partial_count" in final_plan(dup)
