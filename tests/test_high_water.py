"""Extracts with a high-water mark."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loadkit.plans.high_water import MarkConflict, extract_new, last_mark
from loadkit.sinks.ledger import key_name


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def versions(spark, pairs, kind="date"):
    return spark.createDataFrame([(k, t, "x") for k, t in pairs], "k long, m string, v string").withColumn(
        "m", F.col("m").cast(kind))


def extract(df, state, source="s", **kw):
    return extract_new(df, state, source, keys=["k"], modified_column="m", **kw)


def keys(got):
    return sorted(r.k for r in got.rows.select(F.coalesce("k", F.lit(-1)).alias("k")).collect())


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz"])
def test_three_runs_with_late_rows_deliver_each_version_once(spark, tmp_shared, kind):
    one = [(1, "2024-01-01"), (2, "2024-01-09"), (3, "2024-01-10"), (None, "2024-01-10"), (9, None)]
    two = [*one, (2, "2024-01-10"), (4, "2024-01-08"), (5, "2024-01-05"), (6, "2024-01-12"), (None, "2024-01-09")]
    three = [*two, (7, "2024-01-09"), (8, "2024-01-08"), (6, "2024-01-13")]
    got = []
    for pairs in (one, two, three):
        got.append(extract(versions(spark, pairs, kind), tmp_shared))
        got[-1].commit()
    assert keys(got[0]) == [-1, 1, 2, 3]
    assert keys(got[1]) == [-1, 2, 4, 6]  # 5 came later than the look-back of three days
    assert keys(got[2]) == [6, 7]  # 8 is a day too late, the rest was delivered before
    assert got[2].rows.schema == versions(spark, one, kind).schema
    assert extract(versions(spark, three, kind), tmp_shared).count == 0


def test_nothing_moves_before_the_commit(spark, tmp_shared):
    df = versions(spark, [(1, "2024-01-01"), (2, "2024-01-02")])
    first, again = extract(df, tmp_shared), extract(df, tmp_shared)
    assert keys(first) == keys(again) == [1, 2]
    again.commit()
    with pytest.raises(MarkConflict):
        first.commit()
    assert extract(df, tmp_shared).count == 0
    assert keys(extract(df, tmp_shared, "another source")) == [1, 2]


def test_empty_extracts_leave_the_mark(spark, tmp_shared):
    empty = extract(versions(spark, []), tmp_shared)
    empty.commit()
    assert empty.count == 0 and empty.rows.count() == 0 and empty.mark is None
    extract(versions(spark, [(1, "2024-01-05")]), tmp_shared).commit()
    late = extract(versions(spark, [(2, "2024-01-04")]), tmp_shared)
    late.commit()
    number, mark = last_mark(spark, f"{tmp_shared}/{key_name('s')}/marks")
    assert number == 2 and dt.date(1970, 1, 1) + dt.timedelta(mark["high"]) == dt.date(2024, 1, 5)  # a late row: as before


def test_repeated_rows_and_the_time_zone(spark, tmp_shared):
    df = versions(spark, [(1, "2024-01-05 10:00:00.000001"), (1, "2024-01-05 10:00:00.000001")], "timestamp").cache()
    assert df.count() == 2
    first = extract(df, tmp_shared)
    first.commit()
    assert first.count == 2
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert extract(df, tmp_shared).count == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
        df.unpersist()


def test_pairs_kept_are_those_of_the_look_back(spark, tmp_shared):
    df = spark.range(1000).select(F.col("id").alias("k"), F.date_add(F.lit("2020-01-01").cast("date"),
                                                                    F.col("id").cast("int")).alias("m"))
    got = extract(df, tmp_shared)
    assert got.count == 1000 and spark.read.parquet(got.mark["pairs"]).count() == 4


def test_the_bound_reaches_the_scan(spark, tmp_shared, monkeypatch):
    versions(spark, [(1, "2024-01-05")], "timestamp_ntz").write.parquet(f"{tmp_shared}/in")
    source = spark.read.parquet(f"{tmp_shared}/in")
    extract(source, f"{tmp_shared}/state").commit()
    plans = []
    from loadkit.plans import high_water
    real = high_water.stage

    def seen(df, *a, **kw):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, *a, **kw)

    monkeypatch.setattr(high_water, "stage", seen)
    extract(source, f"{tmp_shared}/state")
    assert "GreaterThanOrEqual(m,2024-01-02T00:00" in plans[0]


def test_other_types_are_refused(spark, tmp_shared):
    with pytest.raises(TypeError, match="neither a date"):
        extract_new(spark.range(1), tmp_shared, "s", keys=["id"], modified_column="id")
