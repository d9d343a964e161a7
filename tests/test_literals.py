import math

from tablescope.functions.literals import literal_rows


def test_values_come_back_as_they_are(spark):
    rows = [(1, "it's", True, 1.5, None), (None, "back\\slash\n\"q\" ${x}", False, float("inf"), 7), (3, "", None, float("nan"), 2**40)]
    df = literal_rows(spark, rows, "a int, b string, c boolean, d double, e bigint")
    got = [tuple(r) for r in df.collect()]
    assert got[:2] == rows[:2] and got[2][:3] == rows[2][:3] and math.isnan(got[2][3]) and got[2][4] == 2**40
    assert "LocalTableScan" in df._jdf.queryExecution().executedPlan().toString()


def test_no_rows(spark):
    df = literal_rows(spark, [], "a int, b string")
    assert df.collect() == [] and df.dtypes == [("a", "int"), ("b", "string")]
