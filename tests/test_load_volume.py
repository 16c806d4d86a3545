"""What a load moves and writes: no sort by route, compressed tables, shuffled lookups before the join."""

import glob
import re

import pyarrow.parquet as pq
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from loadkit.operators.lookups import join_with_lookups, merge_join, multi_lookup
from loadkit.plans.staging import route_and_stage
from loadkit.session import CODEC_SETTING, OPEN_SETTING, files_side_by_side
from loadkit.sinks.tables import append


def rules():
    return [{"name": "odd", "condition": F.col("k") % 2 == 1, "message": "odd"}]


def codecs(path):
    files = glob.glob(f"{path.removeprefix('file:')}/**/*.parquet", recursive=True)
    return {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files}


def test_staging_does_not_sort_by_route(spark, monkeypatch):
    """The write keeps one file a route open; the session's setting is as before after it."""
    seen, save = [], DataFrameWriter.save

    def watched(writer, *a, **kw):
        seen.append(int(spark.conf.get(OPEN_SETTING)))
        return save(writer, *a, **kw)

    monkeypatch.setattr(DataFrameWriter, "save", watched)
    before = spark.conf.get(OPEN_SETTING, None)
    routed, _ = route_and_stage(spark.range(100).toDF("k"), rules(), "volume")
    assert seen and min(seen) > 1
    assert spark.conf.get(OPEN_SETTING, None) == before
    assert (routed.valid_rows, routed.error_rows) == (50, 50)
    assert sorted(r.k for r in routed.valid.collect()) == list(range(0, 100, 2))


def test_writes_at_once_put_the_setting_back_once(spark):
    before = spark.conf.get(OPEN_SETTING, None)
    with files_side_by_side(spark):
        with files_side_by_side(spark):
            pass
        assert int(spark.conf.get(OPEN_SETTING)) > 1
    assert spark.conf.get(OPEN_SETTING, None) == before


def test_tables_are_compressed_unless_the_session_names_a_codec(spark, tmp_shared):
    routed, _ = route_and_stage(spark.range(100).toDF("k"), rules(), "volume")
    append(routed.valid, f"{tmp_shared}/a")
    assert codecs(routed.path) == codecs(f"{tmp_shared}/a") == {"ZSTD"}
    spark.conf.set(CODEC_SETTING, "gzip")
    try:
        append(routed.valid, f"{tmp_shared}/b")
    finally:
        spark.conf.unset(CODEC_SETTING)
    assert codecs(f"{tmp_shared}/b") == {"GZIP"}


def test_shuffled_lookups_come_before_the_join(spark):
    detail = spark.createDataFrame([(1, 7, 5), (1, 8, 6), (2, None, 5), (3, 7, None), (9, 7, 5)],
                                   "o int, part int, supp int")
    primary = spark.createDataFrame([(1, 4), (1, 4), (2, None), (3, 5)], "o int, cust int")
    dims = {"cust": [(4, "c4"), (None, "no")], "part": [(7, "p7"), (6, "p6")], "supp": [(5, "s5")]}

    def specs(**kw):
        return [{"name": n, "dim": spark.createDataFrame(rows, f"{n}_id int, {n}_name string"),
                 "on": {n: f"{n}_id"}, "columns": [f"{n}_name"], "broadcast": kw.get(n, False)}
                for n, rows in dims.items()]

    for how in ("inner", "left"):
        want = multi_lookup(merge_join(detail, primary, "o", how), specs())
        got = join_with_lookups(detail, primary, "o", specs(supp=True), how)
        assert got.columns == want.columns
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))

    depth = {m[2]: len(m[1]) for m in re.finditer(r"^([ :+-]*)Join \w+, .*?\((\w+)#", got._jdf.queryExecution()
                                                  .optimizedPlan().toString(), re.M)}
    assert depth["supp"] < depth["o"] < min(depth["cust"], depth["part"])
