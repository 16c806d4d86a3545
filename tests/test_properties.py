"""Operators against brute-force Python models on random small frames,
and conservation laws on the given tables."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loadkit.catalog import inputs as I
from loadkit.operators import lookups, routing, scd, transforms
from tests.conftest import SF_SMALL
from tests.test_edges import DIM, SRC, rows

OPEN = dt.date(9999, 12, 31)
EFF = dt.date(2020, 1, 1)
OLD = dt.date(2019, 1, 1)
AS_OF = dt.date(2024, 6, 1)
VALS = st.sampled_from([None, "x", "y"])
PROPS = settings(max_examples=15, deadline=None,
                 suppress_health_check=[HealthCheck.function_scoped_fixture])


@st.composite
def scd2_inputs(draw):
    target, source = [], []
    for k in range(draw(st.integers(1, 12))):
        state = draw(st.sampled_from(["absent", "current", "closed", "both"]))
        if state in ("closed", "both"):
            target.append((k, draw(VALS), draw(VALS), OLD, EFF, 0))
        if state in ("current", "both"):
            target.append((k, draw(VALS), draw(VALS), EFF, OPEN, 1))
        if draw(st.booleans()):
            source.append((k, draw(VALS), draw(VALS)))
    return target, source


def scd2_model(target, source, tracked=(1,)):
    cur = {r[0]: r for r in target if r[5] == 1}
    out = [r for r in target if r[5] != 1]
    src = {r[0]: r for r in source}
    for k, t in cur.items():
        s = src.get(k)
        if s is not None and any(t[i] != s[i] for i in tracked):
            out += [(k, t[1], t[2], t[3], AS_OF, 0), (k, s[1], s[2], AS_OF, OPEN, 1)]
        else:
            out.append(t)
    out += [(k, s[1], s[2], AS_OF, OPEN, 1) for k, s in src.items() if k not in cur]
    return out


@PROPS
@given(data=scd2_inputs(), bcast=st.booleans())
def test_scd2_matches_model(spark, data, bcast):
    target, source = data
    t = spark.createDataFrame(target, DIM)
    s = spark.createDataFrame(source, SRC)
    got = rows(scd.scd2_merge(t, s, ["k"], ["a"], AS_OF, broadcast_source=bcast))
    want = sorted(scd2_model(target, source), key=lambda r: tuple((x is None, str(x)) for x in r))
    assert got == want


@PROPS
@given(data=st.lists(st.tuples(st.integers(0, 4), st.one_of(st.none(), st.integers(0, 3)),
                               VALS), min_size=0, max_size=25),
       keep=st.sampled_from(["last", "first"]))
def test_dedup_matches_model(spark, data, keep):
    df = spark.createDataFrame(data, "k long, ts long, v string")
    got = rows(transforms.deduplicate(df, ["k"], ["ts"], keep=keep))

    def rank(r):  # nulls lowest on both columns
        return (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "")

    best = {}
    for r in data:
        cur = best.get(r[0])
        if cur is None or (rank(r) > rank(cur) if keep == "last" else rank(r) < rank(cur)):
            best[r[0]] = r
    assert got == sorted(best.values(), key=lambda r: tuple((x is None, str(x)) for x in r))


# ------------------------------------------------------------------ conservation on tables
def test_routing_split_lookup_conserve_rows(spark):
    customer = I.table(spark, SF_SMALL, "customer")
    n = customer.count()
    valid, errors = routing.route_errors(customer, I.customer_rules())
    assert valid.count() + errors.count() == n
    outs = routing.conditional_split(customer, [("neg", F.col("c_acctbal") < 0),
                                                ("auto", F.col("c_mktsegment") == "AUTOMOBILE")])
    assert sum(o.count() for o in outs.values()) == n
    li = I.table(spark, SF_SMALL, "lineitem")
    sup = I.table(spark, SF_SMALL, "supplier").filter(F.col("s_acctbal") >= 0)
    m, u = lookups.lookup(li, sup, {"l_suppkey": "s_suppkey"}, ["s_name"])
    assert m.count() + u.count() == li.count()


def test_scd2_one_current_row_per_key_on_tables(spark):
    out = scd.scd2_merge(I.scd2_target(spark, SF_SMALL), I.scd2_source(spark, SF_SMALL),
                         ["business_key"], I.SCD2_TRACKED, I.AS_OF)
    per_key = out.filter("is_current = 1").groupBy("business_key").count()
    assert per_key.filter("count > 1").count() == 0
    again = scd.scd2_merge(out, I.scd2_source(spark, SF_SMALL), ["business_key"],
                           I.SCD2_TRACKED, dt.date(2024, 7, 1))
    assert again.exceptAll(out).count() == 0 and out.exceptAll(again).count() == 0


def test_dimension_load_audit_counts_exact(spark):
    from loadkit.catalog.load_queries import SCD2_LOAD_SOURCE_SQL, run_scd2_load
    from tests.oracle import duck
    con = duck(SF_SMALL)
    total, null_keys, keys = con.execute(
        f"SELECT count(*), count(*) FILTER (WHERE business_key IS NULL), "
        f"count(DISTINCT business_key) FROM ({SCD2_LOAD_SOURCE_SQL}) r").fetchone()
    bad = con.execute(
        f"""SELECT count(*) FROM (SELECT * FROM ({SCD2_LOAD_SOURCE_SQL}) r
            WHERE business_key IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY business_key ORDER BY modified_date DESC) = 1)
            WHERE c_mktsegment = 'BAD'""").fetchone()[0]
    m = run_scd2_load(spark, SF_SMALL).metrics
    assert m["read"] == total
    assert m["dropped"] == total - null_keys - keys
    assert m["errors"] == null_keys + bad
    assert m["valid"] == keys - bad


@st.composite
def scd1_inputs(draw):
    keys = range(draw(st.integers(1, 10)))
    target = [(k, draw(VALS), draw(VALS)) for k in keys if draw(st.booleans())]
    source = [(k, draw(VALS), draw(VALS)) for k in keys if draw(st.booleans())]
    return target, source


@PROPS
@given(data=scd1_inputs(), bcast=st.booleans())
def test_scd1_matches_model(spark, data, bcast):
    target, source = data
    schema = "k long, v string, keep string"
    out = scd.scd1_merge(spark.createDataFrame(target, schema),
                         spark.createDataFrame(source, schema), ["k"],
                         exclude_columns=["keep"], broadcast_source=bcast)
    t, s = {r[0]: r for r in target}, {r[0]: r for r in source}
    want = []
    for k in sorted(set(t) | set(s)):
        if k in t and k in s:
            want.append((k, s[k][1], t[k][2]))     # update; excluded column kept
        else:
            want.append(t.get(k) or s[k])
    assert rows(out) == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))


@PROPS
@given(data=st.lists(st.tuples(st.integers(0, 50), st.one_of(st.none(), st.integers(-5, 5))),
                     max_size=30))
def test_route_errors_matches_model(spark, data):
    df = spark.createDataFrame(data, "k long, x long")
    rules = [{"name": "neg", "condition": F.col("x") < 0},
             {"name": "big_key", "condition": F.col("k") > 40}]
    valid, errors = routing.route_errors(df, rules)

    def failed(r):
        return [n for n, hit in (("neg", r[1] is not None and r[1] < 0), ("big_key", r[0] > 40))
                if hit]

    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert rows(valid) == sorted([r for r in data if not failed(r)], key=key)
    got = sorted(((r.k, r.x, tuple(r.error_rules)) for r in errors.collect()), key=key)
    assert got == sorted([(*r, tuple(failed(r))) for r in data if failed(r)], key=key)
