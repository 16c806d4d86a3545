"""A job written against the generated-job call names runs through loadkit.compat."""

import datetime as dt

from pyspark.sql import functions as F

from loadkit import compat as C
from loadkit.catalog import inputs as I
from loadkit.operators import scd
from loadkit.sinks import tables as sinks
from tests.conftest import SF_SMALL


def test_dimension_job_with_compat_names(spark, tmp_shared):
    name = "dim_compat_" + tmp_shared.rsplit("-", 1)[-1]
    sinks.publish_version(spark, I.scd2_target(spark, SF_SMALL), name, tmp_shared)
    source = I.scd2_source(spark, SF_SMALL).withColumn("modified_date", F.lit(1))
    audit = C.AuditTracker(name, environment="qa")
    audit.start()
    df = C.apply_derived_columns(source, {"source_system": F.lit("SOURCE_DB")})
    df = C.apply_null_handling(df, defaults={})
    df = C.deduplicate(df, ["business_key"], ["modified_date"], "last")
    valid, errors = C.route_errors(df, [{"name": "null_key",
                                         "condition": F.col("business_key").isNull(),
                                         "message": "key missing"}])
    audit.record_errors("validation", errors.count())
    C.scd_type2_merge(spark, valid, name, ["business_key"], I.SCD2_TRACKED, as_of=I.AS_OF)
    audit.complete()
    want = scd.scd2_merge(I.scd2_target(spark, SF_SMALL), I.scd2_source(spark, SF_SMALL),
                          ["business_key"], I.SCD2_TRACKED, I.AS_OF)
    got = spark.table(name)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert audit.records[0][9] == "environment=qa" and audit.status == "complete"


def test_flat_file_job_with_compat_names(spark, tmp_shared):
    I.table(spark, SF_SMALL, "part").select(
        F.col("p_partkey").cast("string").alias("p_partkey"),
        F.col("p_size").cast("string").alias("p_size")).write.option("header", "true") \
        .csv(f"{tmp_shared}/in")
    raw = C.read_csv(spark, f"{tmp_shared}/in", delimiter=",", header=True, encoding="UTF-8")
    typed = C.apply_type_conversions(raw, {"p_partkey": "bigint", "p_size": "int"})
    out = C.apply_derived_columns(typed, {"load_timestamp": F.lit(dt.datetime(2024, 6, 1))})
    C.write_delta(out.drop("_corrupt_record"), f"{tmp_shared}/out", mode="append")
    back = spark.read.parquet(f"{tmp_shared}/out")
    assert back.count() == I.table(spark, SF_SMALL, "part").count()
    assert dict(back.dtypes)["p_size"] == "int"
