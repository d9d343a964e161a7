"""Plan shape checks and the DuckDB oracle on the smallest driver tables."""

import datetime as dt
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from tablescope.operators import correlate, profile as pr
from tablescope.plans import questions
from tablescope.plans.oracles import ORACLES
from tablescope.plans.registry import QUERIES, TABLES

from .conftest import SF001


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_and_no_cross_join_in_registered_queries(spark):
    for key, fn in QUERIES.items():
        text = plan_text(fn(spark, SF001))
        # the pair sums of the correlations are matrix products over Arrow batches
        python = () if "correlation" in key or key == "full_report" else ("InArrow",)
        assert not any(x in text for x in ("EvalPython", "InPandas", *python, "CartesianProduct", "BroadcastNestedLoopJoin")), key


def test_aggregate_count_does_not_grow_per_column(spark):
    wide = spark.range(100).selectExpr(*[f"id * {i} AS c{i}" for i in range(60)])
    facts = pr.column_facts(wide)
    facts.collect()
    text = facts._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    groups = pr._fact_groups(pr.column_specs(wide))
    assert len(groups) <= 60 // 8 + 1
    # one partial and one final aggregate per group of columns, never per column
    aggs = [ln for ln in text.splitlines() if "HashAggregate(" in ln or "SortAggregate(" in ln]
    assert len(aggs) == 2 * len(groups)
    # every aggregate stays inside whole-stage code generation
    assert all("*(" in ln for ln in aggs), aggs
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark):
    df = spark.read.parquet(f"{SF001}/orders.parquet")
    filtered = questions.year_filter(df, "o_orderdate", 1996).select("o_totalprice")
    text = plan_text(filtered)
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in text
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz>" in text
    stats = plan_text(pr.numeric_stats(spark.read.parquet(f"{SF001}/lineitem.parquet")))
    assert "l_returnflag" not in stats.split("ReadSchema")[1].split("\n")[0]


@pytest.mark.parametrize("name", ["orders", "documents", "events"])
def test_fixed_width_facts_stay_in_generated_code(spark, name):
    facts = pr.column_facts(spark.read.parquet(f"{SF001}/{name}.parquet"))
    facts.collect()
    text = plan_text(facts).split("== Initial Plan ==")[0]
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text
    assert all("*(" in ln for ln in text.splitlines() if "HashAggregate(" in ln)


def test_correlations_take_two_scans_whatever_the_width(spark, tmp_path):
    df = spark.range(500).selectExpr(*[f"CAST(pmod(xxhash64(id, {i}), {i + 7}) AS DOUBLE) AS c{i}" for i in range(60)])
    df.write.csv(f"{tmp_path}/wide", header=True)
    wide = spark.read.schema(df.schema).csv(f"{tmp_path}/wide", header=True)
    jobs = []
    facts = pr.column_facts
    pr.column_facts = lambda d, *a, **k: jobs.append(facts(d, *a, **k)) or jobs[-1]
    try:
        got = correlate.correlations(wide)
    finally:
        pr.column_facts = facts
    assert plan_text(got).count("FileScan csv") == 1 and len(jobs) == 1
    rows = {(r.col1, r.col2): r.corr for r in got.collect()}
    assert len(rows) == 3600 and rows["c3", "c3"] == 1.0 and rows["c5", "c9"] == rows["c9", "c5"]
    want = df.selectExpr("corr(c5, c9) AS r").first().r
    assert abs(rows["c5", "c9"] - want) <= 0.0005


def _norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", list(ORACLES))
def test_query_matches_oracle(spark, duck, key):
    df = QUERIES[key](spark, SF001)
    got = [tuple(r) for r in df.collect()]
    cur = duck.execute(ORACLES[key])
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert _rows(df.columns, got) == _rows(names, want)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() == 6
    assert df.columns[:4] == ["ordinal", "column_name", "dtype", "count"]


def test_value_counts_scan_once(spark):
    from tablescope.operators import values

    v = values.value_counts(spark.read.parquet(f"{SF001}/orders.parquet"), "o_orderpriority")
    v.collect()
    text = v._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert text.count("FileScan parquet") == 1


def test_quantile_scratch_table_is_removed(spark):
    import glob

    from tablescope.session import checkpoint_root

    root = checkpoint_root(spark).replace("file:", "")
    before = set(glob.glob(f"{root}/tablescope-ranked-values-*"))
    q = pr.quantiles(spark.read.parquet(f"{SF001}/lineitem.parquet")).collect()
    assert len(q) == 8
    assert set(glob.glob(f"{root}/tablescope-ranked-values-*")) == before
