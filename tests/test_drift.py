"""Files whose columns differ from the others are named."""

import os

from pyspark.sql import types as T

from loadkit.operators.drift import schema_drift


def rows(df):
    return sorted(((os.path.basename(r.file_path), r.column_name, r.expected_type, r.file_type, r.status, r.file_rows)
                   for r in df.collect()), key=str)


def parquet(spark, folder, name, sql):
    spark.sql(sql).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
    return f"{folder}/{name}"


def by_folder(df, folder):
    return sorted((r.file_path[len("file:" + folder) + 1:].split("/")[0], r.column_name, r.expected_type, r.file_type,
                   r.status, r.file_rows) for r in df.collect())


def test_widened_and_lost_columns_are_named(spark, tmp_shared):
    folder = tmp_shared.removeprefix("file:")
    paths = [parquet(spark, folder, "a", "select id, cast(id as int) n, 'x' s from range(3)"),
             parquet(spark, folder, "b", "select id, id n, 'x' s from range(4)"),
             parquet(spark, folder, "c", "select id, cast(id as int) n from range(5)")]
    assert by_folder(schema_drift(spark, paths), folder) == [("b", "n", "int", "bigint", "type_differs", 4),
                                                             ("c", "s", "string", None, "missing", 5)]
    assert by_folder(schema_drift(spark, paths[:1]), folder) == []


def test_against_a_schema(spark, tmp_shared):
    folder = tmp_shared.removeprefix("file:")
    paths = [parquet(spark, folder, "a", """select id, timestamp_ntz '2024-01-01 00:00:00' t, cast(1.5 as decimal(9,2)) d,
                                            array(named_struct('k', 1)) xs, date '2024-01-01' day from range(2)"""),
             parquet(spark, folder, "b", "select id ID, 1.5d d, 1 more from range(2) where id < 0")]
    schema = T.StructType.fromDDL("id bigint, t timestamp_ntz, d decimal(9,2), xs array<struct<k:int>>, day date")
    assert by_folder(schema_drift(spark, paths[:1], schema), folder) == []
    assert by_folder(schema_drift(spark, paths, schema), folder) == [
        ("b", "d", "decimal(9,2)", "double", "type_differs", 0), ("b", "day", "date", None, "missing", 0),
        ("b", "more", None, "int", "unexpected", 0), ("b", "t", "timestamp_ntz", None, "missing", 0),
        ("b", "xs", "array<struct<k:int>>", None, "missing", 0)]


def test_types_spark_writes_read_as_they_are(spark, tmp_shared):
    path = tmp_shared.removeprefix("file:")
    df = spark.sql("""select timestamp '2024-01-01 00:00:00' t, timestamp_ntz '2024-01-01 00:00:00' n, cast(1 as tinyint) b,
                      cast(1 as smallint) s, 1f f, X'00' x, map('k', 1) m, true y from range(1)""")
    for kind in ("INT96", "TIMESTAMP_MICROS"):
        spark.conf.set("spark.sql.parquet.outputTimestampType", kind)
        try:
            df.write.parquet(f"{path}/{kind}")
        finally:
            spark.conf.unset("spark.sql.parquet.outputTimestampType")
        assert rows(schema_drift(spark, f"{path}/{kind}", df.schema)) == []


def test_csv_headers(spark, tmp_path):
    for name, text in {"a": "k,v,w\n1,2,3\n", "b": "k,v,w\n", "c": "v,k,w\n1,2,3\n", "d": "k,v\n1,2\n",
                       "e": 'k,v,w,"x,\ny"\n', "f": "\n", "g": ""}.items():
        (tmp_path / f"{name}.csv").write_text(text)
    found = rows(schema_drift(spark, str(tmp_path), fmt="csv"))
    assert found == sorted([("c.csv", "k", None, None, "moved", None), ("c.csv", "v", None, None, "moved", None),
                            ("d.csv", "w", None, None, "missing", None), ("e.csv", "x,\ny", None, None, "unexpected", None),
                            *[("f.csv", c, None, None, "missing", None) for c in "kvw"]], key=str)  # one blank line


def test_broken_files_and_empty_folders(spark, tmp_path):
    good = str(tmp_path / "good")
    spark.range(3).coalesce(1).write.parquet(good)
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "x.parquet").write_bytes(b"PAR1 but not really")
    (broken / "y.parquet").write_bytes(b"")
    assert rows(schema_drift(spark, [good, str(broken)])) == [("x.parquet", None, None, None, "unreadable", None)]
    empty = tmp_path / "empty"
    empty.mkdir()
    assert rows(schema_drift(spark, str(empty))) == []
    assert rows(schema_drift(spark, str(empty), T.StructType.fromDDL("a int"))) == []
