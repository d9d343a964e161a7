import pytest

from tablescope.llm import hotjoin


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("given", [False, True])
def test_hot_keys_join_like_all_others(spark, monkeypatch, how, given):
    monkeypatch.setattr(hotjoin, "HOT_ROWS", 5)
    monkeypatch.setattr(hotjoin, "HOT_KEYS", 20)
    rows = [(7, i) for i in range(60)] + [(8, i) for i in range(40)] + [(i % 30, i) for i in range(60)] + [(99, i) for i in range(30)]
    left = spark.createDataFrame(rows, "k long, v long")
    right = spark.createDataFrame([(k, k * 10) for k in range(25)], "k long, w long")
    counts = left.groupBy("k").count().withColumnRenamed("count", "size") if given else None
    out = hotjoin.join_hot(left, right, ["k"], how, counts, **({"size": "size"} if given else {}))
    want = [(k, v, k * 10 if k < 25 else None) for k, v in rows if how == "left" or k < 25]
    assert sorted(map(str, map(tuple, out.select("k", "v", "w").collect()))) == sorted(map(str, want))
    assert "BroadcastExchange" in out._jdf.queryExecution().executedPlan().toString()


def test_only_members_loses_none(spark):
    rows = spark.range(5000).selectExpr("id * 7919 AS u", "concat('t', id) AS t")
    members = spark.range(0, 5000, 50).selectExpr("id * 7919 AS u")
    kept = {r.u for r in hotjoin.only_members(rows, members, "u").collect()}
    assert {r.u for r in members.collect()} <= kept and len(kept) < 600
    assert hotjoin.only_members(rows, members.limit(0), "u").collect() == []
