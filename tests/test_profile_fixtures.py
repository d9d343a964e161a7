"""Edge fixtures for the profiling operators (FIXTURES.md §3)."""

import datetime as dt
import decimal
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablescope.operators import correlate, profile as pr, summarize, values


def stats_by_name(df):
    return {r.column_name: r for r in pr.statistics(df).collect()}


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    s = stats_by_name(df)
    assert s["a"]["count"] == 0 and s["a"].unique_count == 0
    assert s["a"].mean is None and s["a"].median is None
    assert s["b"].top_value is None
    nulls = {r.column_name: r for r in pr.null_columns(df).collect()}
    assert nulls["a"].null_percentage == 0.0
    assert pr.null_totals(df).first().total_null_percentage == 0.0
    card = {r.column_name: r.cardinality for r in pr.cardinality(df).collect()}
    assert card == {"a": "unique", "b": "unique"}


def test_one_row_std_is_null(spark):
    df = spark.createDataFrame([(3.5, "x")], "v double, t string")
    s = stats_by_name(df)
    assert s["v"].std is None
    assert s["v"].mean == 3.5 and s["v"].median == 3.5 and s["v"].q25 == 3.5
    assert s["t"].top_value == "x" and s["t"].top_frequency == 1


def test_all_null_columns(spark):
    df = spark.createDataFrame([(None, None)] * 4, "d double, s string")
    s = stats_by_name(df)
    assert s["d"].mean is None and s["d"].min_num is None and s["d"].median is None
    assert s["s"].top_value is None and s["s"].top_frequency is None
    assert s["d"].unique_count == 0
    nulls = {r.column_name: r.null_percentage for r in pr.null_columns(df).collect()}
    assert nulls == {"d": 100.0, "s": 100.0}


def test_constant_column_correlation_is_null(spark):
    df = spark.createDataFrame([(5.1, float(i)) for i in range(10)], "c double, v double")
    rows = {(r.col1, r.col2): r.corr for r in correlate.correlations(df).collect()}
    assert rows[("c", "v")] is None and rows[("v", "c")] is None and rows[("c", "c")] is None
    assert rows[("v", "v")] == 1.0


def test_pairwise_nulls(spark):
    data = [(1.0, 2.0), (2.0, None), (3.0, 6.5), (None, 1.0), (4.0, 8.0), (5.0, 9.0)]
    df = spark.createDataFrame(data, "x double, y double")
    got = correlate.pair_correlation(df, "x", "y", digits=None).first().corr
    both = [(a, b) for a, b in data if a is not None and b is not None]
    n = len(both)
    mx, my = sum(a for a, _ in both) / n, sum(b for _, b in both) / n
    cov = sum((a - mx) * (b - my) for a, b in both)
    sx = math.sqrt(sum((a - mx) ** 2 for a, _ in both))
    sy = math.sqrt(sum((b - my) ** 2 for _, b in both))
    assert got == pytest.approx(cov / (sx * sy), rel=1e-12)


def test_nan_values(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (float("nan"),)], "v double")
    s = stats_by_name(df)["v"]
    assert math.isnan(s.mean) and math.isnan(s.max_num)
    assert s.min_num == 1.0
    assert s.unique_count == 2


def test_ties_top_value_and_value_counts(spark):
    df = spark.createDataFrame([(v,) for v in "aabbc"], "v string")
    s = stats_by_name(df)["v"]
    assert (s.top_value, s.top_frequency) == ("b", 2)
    vc = [(r.value, r["count"]) for r in values.value_counts(df, "v").collect()]
    assert vc == [("a", 2), ("b", 2), ("c", 1)]


def test_null_group_in_value_counts(spark):
    df = spark.createDataFrame([("x",), ("x",), (None,), (None,), (None,)], "v string")
    vc = [(r.value, r["count"], r.percentage) for r in values.value_counts(df, "v").collect()]
    assert vc == [(None, 3, 60.0), ("x", 2, 40.0)]
    assert stats_by_name(df)["v"].top_value == "x"


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, 2.0, "q", True)], ["a.b", "a b", 'a"b', "select"])
    s = stats_by_name(df)
    assert set(s) == {"a.b", "a b", 'a"b', "select"}
    assert s["a.b"].mean == 1.0 and s["select"].top_value == "True"
    assert len(pr.null_columns(df).collect()) == 4
    assert len(summarize.summarize(df).collect()) == 4
    assert len(values.value_counts(df, "a b").collect()) == 1


def test_all_types(spark):
    df = spark.sql(
        """SELECT true AS b, CAST(1 AS TINYINT) AS t, CAST(2 AS SMALLINT) AS s, 3 AS i, CAST(4 AS BIGINT) AS l,
                  CAST(1.5 AS FLOAT) AS f, 2.5D AS d, CAST(3.25 AS DECIMAL(10,2)) AS dec,
                  DATE'2024-02-03' AS dt, TIMESTAMP'2024-02-03 04:05:06' AS ts,
                  TIMESTAMP_NTZ'2024-02-03 04:05:06' AS ntz, X'0102' AS bin, array(1, 2) AS arr,
                  named_struct('a', 1) AS st, map('k', 1) AS m, INTERVAL '1' DAY AS iv"""
    )
    s = stats_by_name(df)
    assert s["dec"].mean == 3.25 and s["f"].mean == 1.5
    assert s["dt"].min_text == "2024-02-03" and s["ntz"].max_text == "2024-02-03 04:05:06"
    for nested in ("arr", "st", "m", "iv"):
        r = s[nested]
        assert r["count"] == 1 and r.unique_count == 1
        assert r.top_value is None and r.mean is None and r.min_text is None
    assert s["b"].top_value == "True"
    assert s["ntz"].dtype == "TIMESTAMP" and s["arr"].dtype == "INTEGER[]"
    schema = {r.column_name: (r.dtype, r.category) for r in pr.schema_info(df).collect()}
    assert schema["m"] == ("MAP(VARCHAR, INTEGER)", "other")
    assert schema["iv"] == ("INTERVAL", "other")
    assert len(summarize.summarize(df).collect()) == 16


def test_decimal_quartile_is_interpolated(spark):
    vals = [decimal.Decimal(x) for x in ("1.00", "1.01", "1.05", "1.10")]
    df = spark.createDataFrame([(v,) for v in vals], "v decimal(10,2)")
    s = stats_by_name(df)["v"]
    assert s.q25 == pytest.approx(1.0075, abs=1e-12)
    assert s.median == pytest.approx(1.03, abs=1e-12)


def test_quantiles_match_interpolation_on_many_partitions(spark):
    import random

    rnd = random.Random(7)
    data = [rnd.choice([None, rnd.randint(-50, 50), rnd.random() * 1000]) for _ in range(5000)]
    df = spark.createDataFrame([(None if v is None else float(v),) for v in data], "v double").repartition(7)
    q = pr.quantiles(df).first()
    xs = sorted(v for v in data if v is not None)
    for p, got in ((0.25, q.q25), (0.5, q.median), (0.75, q.q75)):
        h = (len(xs) - 1) * p
        lo, hi = math.floor(h), math.ceil(h)
        want = xs[lo] + (xs[hi] - xs[lo]) * (h - lo)
        assert got == pytest.approx(want, rel=1e-12)
    approx = pr.quantiles(df, approx=True).first()
    assert approx.median == pytest.approx(q.median, rel=0.05, abs=5)


def test_hot_value_skew(spark):
    # one value holds a third of the rows
    rows = [(0 if i % 3 == 0 else i, "hot" if i % 3 == 0 else f"v{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "k bigint, s string")
    s = stats_by_name(df)
    assert (s["s"].top_value, s["s"].top_frequency) == ("hot", 1000)
    assert s["k"].unique_count == 2001
    values_in_order = sorted(r[0] for r in rows)
    assert s["k"].median == (values_in_order[1499] + values_in_order[1500]) / 2


def test_invariants_on_orders(spark):
    from tablescope.plans.registry import orders_with_nulls

    df = orders_with_nulls(spark, "/root/testdata/sf0.001")
    stats = pr.statistics(df).collect()
    nulls = pr.null_columns(df).collect()
    rows = df.count()
    for n in nulls:
        assert n.null_count + n.non_null_count == rows
    for s in stats:
        assert s.unique_count <= rows
        if s.q25 is not None:
            assert s.q25 <= s.median <= s.q75
            assert s.min_num <= s.q25 and s.q75 <= s.max_num
        if s.top_frequency is not None:
            assert s.top_frequency <= s["count"]
    corr = {(r.col1, r.col2): r.corr for r in correlate.correlations(df).collect()}
    for (a, b), v in corr.items():
        assert corr[(b, a)] == v
        if a == b:
            assert v == 1.0


def test_filtered_summary_year_bounds(spark):
    from tablescope.plans.questions import year_filter

    df = spark.createDataFrame(
        [(dt.datetime(2022, 12, 31, 23, 59),), (dt.datetime(2023, 1, 1),), (dt.datetime(2023, 12, 31, 23, 59, 59),), (dt.datetime(2024, 1, 1),)],
        "ts timestamp_ntz",
    )
    assert year_filter(df, "ts", 2023).count() == 2
    d = df.select(F.to_date("ts").alias("d"))
    assert year_filter(d, "d", 2023).count() == 2


def test_approx_statistics_close_to_exact(spark):
    from tablescope.plans.registry import orders_with_nulls

    df = orders_with_nulls(spark, "/root/testdata/sf0.01")
    exact = {r.column_name: r for r in pr.statistics(df).collect()}
    approx = {r.column_name: r for r in pr.statistics(df, approx=True).collect()}
    assert set(exact) == set(approx)
    for name, e in exact.items():
        a = approx[name]
        assert a["count"] == e["count"] and a.mean == e.mean and a.top_value == e.top_value
        # HyperLogLog++ with the default 5 % relative standard error: allow 3 sigma
        assert abs(a.unique_count - e.unique_count) <= max(2, 0.15 * e.unique_count)
        if e.median is not None:
            spread = e.q75 - e.q25 or 1.0
            assert abs(a.median - e.median) <= 0.02 * spread + 1e-9


def test_distinct_counts_exact_and_approx(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "b", None), (2, None, None)], "i int, s string, n double")
    exact = {r.column_name: (r["count"], r.unique_count) for r in pr.distinct_counts(df).collect()}
    assert exact == {"i": (3, 2), "s": (3, 2), "n": (3, 0)}
    approx = {r.column_name: r.unique_count for r in pr.distinct_counts(df, approx=True).collect()}
    assert approx == {"i": 2, "s": 2, "n": 0}


def test_mean_of_decimals_is_a_double(spark):
    rows = [(decimal.Decimal("1.00"),), (decimal.Decimal("1.00"),), (decimal.Decimal("1.01"),)]
    df = spark.createDataFrame(rows, "v decimal(10,2)")
    assert pr.numeric_stats(df).first()["mean"] == pytest.approx(3.01 / 3, rel=1e-12)
    assert stats_by_name(df)["v"]["mean"] == pytest.approx(3.01 / 3, rel=1e-12)


def test_zoned_timestamps_are_distinct_by_instant(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        # the two instants of 01:30 on the day the clocks go back
        df = spark.range(3).selectExpr("timestamp_seconds(1730622600 + IF(id = 0, 0, 3600)) AS at", "id")
        assert df.selectExpr("count(DISTINCT CAST(at AS STRING)) AS n").first().n == 1
        s = stats_by_name(df)["at"]
        assert (s.unique_count, s.top_frequency, s.top_value) == (2, 2, "2024-11-03 01:30:00")
        assert {r.column_name: r.unique_count for r in pr.distinct_counts(df).collect()} == {"at": 2, "id": 3}
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_tables_without_columns_of_a_class(spark):
    texts, numbers = spark.createDataFrame([("a",)], "s string"), spark.createDataFrame([(1,)], "n int")
    assert pr.numeric_stats(texts).collect() == [] and pr.temporal_range(texts).collect() == []
    assert pr.temporal_range(numbers).collect() == [] and pr.quantiles(texts).collect() == []
    assert values.top_values(numbers).collect() == []
    bare = spark.range(3).select()
    assert pr.null_columns(bare).collect() == [] and summarize.summarize(bare).collect() == []
    assert pr.distinct_counts(bare).collect() == []


def test_rounding_never_overflows(spark):
    from tablescope.functions.numeric import round_half_up, round_sql

    values_ = [1e13, 9e14, 9.2e12, 9007199254.740991, 9007199254.740993, 1.5, -2.5, 1e300, float("nan"), float("inf"), 0.0000005]
    df = spark.createDataFrame([(v,) for v in values_], "v double")
    got = [r.r for r in df.select(round_half_up("v", 6).alias("r")).collect()]
    assert got[:3] == values_[:3] and got[5:8] == [1.5, -2.5, 1e300] and math.isnan(got[8]) and got[9:] == [float("inf"), 0.000001]
    import duckdb

    for v, g in zip(values_[:8], got):
        assert duckdb.sql(f"SELECT {round_sql(f'CAST({v!r} AS DOUBLE)', 6)}").fetchall()[0][0] == g
        assert spark.sql(f"SELECT {round_sql(f'CAST({v!r}D AS DOUBLE)', 6)} AS r").first().r == g


@pytest.mark.parametrize("far", [1e8, 1e10, 1e200, float("inf"), float("nan")])
def test_an_extreme_value_beside_a_null_plays_no_part(spark, far):
    rows = [(i % 17 / 17, (i % 17 + i % 3) / 20, 5.1) for i in range(30_000)]
    rows += [(far, None, 5.1), (None, -far, None), (None, None, 7.0)]
    df = spark.createDataFrame(rows, "x double, y double, c double").repartition(3)
    got = {(r.col1, r.col2): r.corr for r in correlate.correlations(df).collect()}
    assert got[("x", "y")] == got[("y", "x")] == correlate.pair_correlation(df, "x", "y").first().corr
    assert got[("x", "y")] > 0.9
    assert got[("x", "c")] is None or math.isnan(far - far)
    assert got[("y", "c")] is None and got[("c", "c")] == 1.0
    strong = {(r.col1, r.col2) for r in correlate.strong_correlations(correlate.correlations(df)).collect()}
    assert ("x", "y") in strong


def test_dates_and_local_timestamps_are_grouped_before_they_are_text(spark):
    """One text for each distinct value, not for each row; years beyond four digits and NULLs included."""
    df = spark.range(24).selectExpr(
        "IF(id % 6 = 5, NULL, date_add(DATE'9999-12-30', CAST(id % 4 AS INT))) AS d",
        "IF(id % 7 = 6, NULL, TIMESTAMP_NTZ'2020-03-29 02:30:00.000001' + make_dt_interval(0, 0, 0, id % 3)) AS n",
        "IF(id % 2 = 0, '2020-03-29', 'x') AS s",
    )
    freq = pr.value_frequencies(df)
    plan = freq._jdf.queryExecution().executedPlan().toString()
    assert [x for x in plan.splitlines() if "Generate" in x] and not [x for x in plan.splitlines() if "Generate" in x and "as string" in x]
    want = Counter((k, v) for r in df.selectExpr("CAST(d AS STRING) AS d", "CAST(n AS STRING) AS n", "s").collect() for k, v in enumerate(r, 1) if v is not None)
    assert freq.schema.simpleString() == "struct<ord:int,vi:bigint,vf:double,vs:string,vb:binary,freq:bigint>"
    assert {(r.ord, r.vs): r.freq for r in freq.collect()} == want and {(r.vi, r.vf, r.vb) for r in freq.collect()} == {(None, None, None)}
    assert [tuple(r)[2:] for r in pr.distinct_counts(df).collect()] == [(24, 4), (24, 3), (24, 2)]
