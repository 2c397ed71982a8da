import numpy as np
import pytest
from pyspark.sql import functions as F

from airzone.operators import sketches
from airzone.operators.quantiles import grouped_quantiles


def check(spark, groups, quantiles):
    data = [(k, None if v is None else float(v)) for k, values in groups.items() for v in values]
    got = {r["k"]: r for r in grouped_quantiles(
        spark.createDataFrame(data, "k string, v double"), ["k"], "v", quantiles).collect()}
    for k, values in groups.items():
        known = [v for v in values if v is not None]
        if not known:
            assert k not in got
            continue
        for name, q in quantiles.items():
            assert got[k][name] == pytest.approx(np.quantile(known, q), rel=1e-12, abs=1e-12), (k, name)


@pytest.mark.parametrize("broadcast", [True, False])
def test_against_numpy(spark, broadcast, no_broadcast):
    if not broadcast:
        no_broadcast()
    rng = np.random.default_rng(5)
    check(spark, {
        "normal": rng.normal(40, 15, 3001), "negative": -rng.exponential(5, 500), "signs": rng.normal(0, 1e-3, 777),
        "one": [3.25], "two": [1, 2], "equal": [7] * 50, "nulls": [None, None], "mixed": [None, 5, 1, None],
        "wide": 10.0 ** rng.uniform(-12, 12, 999), "steps": rng.integers(-3, 90, 5000),
    }, {"lo": 0.0, "median": 0.5, "p998": 0.998, "hi": 1.0})


def test_group_with_a_third_of_the_rows_is_split(spark):
    """The group's values spread over many (group, bucket) keys."""
    frame = spark.range(60000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.concat(F.lit("g"), F.col("id") % 50)).alias("k"), (F.col("id") % 9973 / 7).alias("v"))
    hot = frame.filter("k = 'hot'").agg(F.percentile("v", 0.998)).first()[0]
    got = grouped_quantiles(frame, ["k"], "v", {"p": 0.998}).filter("k = 'hot'").first()["p"]
    assert got == pytest.approx(hot)


def test_wanted_values_are_shuffled_once(spark):
    frame = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").cast("double").alias("v"))
    result = grouped_quantiles(frame, ["k"], "v", {"p": 0.5})
    result.collect()
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan and "CartesianProduct" not in plan


def test_rows_are_pruned_before_they_are_shuffled(spark):
    """A short list of buckets goes to the rows, below the count of values."""
    frame = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").cast("double").alias("v"))
    plan = grouped_quantiles(frame, ["k"], "v", {"p": 0.5})._jdf.queryExecution().executedPlan().toString()
    at = plan.index("LeftSemi")
    assert "BroadcastHashJoin" in plan[:at].splitlines()[-1]
    assert "Exchange hashpartitioning" not in plan[at:].split("BroadcastExchange")[0]


def test_many_distinct_values_in_one_coarse_bucket(spark):
    """A continuous, narrow, crowded group: the second level splits it."""
    frame = spark.range(90000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("k"),
        F.when(F.col("id") % 3 == 0, 400 + F.rand(7) / 4).otherwise(F.rand(8) * 1e-4).alias("v"))
    want = {r["k"]: r["p"] for r in frame.groupBy("k").agg(F.percentile("v", 0.37).alias("p")).collect()}
    got = {r["k"]: r["p"] for r in grouped_quantiles(frame, ["k"], "v", {"p": 0.37}).collect()}
    assert got == pytest.approx(want, rel=1e-14)


def test_not_a_number_and_infinity_sort_last(spark):
    inf, nan = float("inf"), float("nan")
    frame = spark.createDataFrame([("a", v) for v in (-inf, 1.0, 2.0, inf, nan)], "k string, v double")
    got = grouped_quantiles(frame, ["k"], "v", {"lo": 0.0, "q1": 0.25, "q3": 0.75, "hi": 1.0}).first()
    assert (got["q1"], got["q3"]) == (1.0, inf)


def test_null_is_a_key_like_any_other(spark, no_broadcast):
    data = [(None, "x", 1.0), (None, "x", 3.0), ("a", None, 5.0), (None, None, 7.0), ("a", "x", None), ("a", None, 6.0)]
    frame = spark.createDataFrame(data, "k string, m string, v double")
    for _ in range(2):
        got = {(r["k"], r["m"]): r["p"] for r in grouped_quantiles(frame, ["k", "m"], "v", {"p": 0.5}).collect()}
        assert got == {(None, "x"): 2.0, ("a", None): 5.5, (None, None): 7.0}
        no_broadcast()


def test_sketches_stay_within_their_error_and_merge(spark):
    rng = np.random.default_rng(9)
    values = {(g, m): rng.gamma(2, 20, n) for g, m, n in [("a", 1, 9000), ("a", 2, 40_000), ("b", 1, 3), ("b", 2, 700), ("c", 1, 25_000)]}
    frame = spark.createDataFrame([(g, m, float(v)) for (g, m), many in values.items() for v in many] + [("c", 1, None), ("c", 1, float("nan")), ("d", 1, None)],
                                  "g string, m int, v double").repartition(6)
    for k in (200, sketches.K):
        fine = sketches.sketched(frame, ["g", "m"], "v", k=k)
        rows = sketches.quantiles(sketches.merged(fine, ["g"]), ["g"], {"median": 0.5, "p998": 0.998}).collect()
        assert {r["g"]: r["n"] for r in rows} == {"a": 49_000, "b": 703, "c": 25_000}
        for r in rows:
            whole = np.sort(np.concatenate([v for (g, _), v in values.items() if g == r["g"]]))
            for name, q in (("median", 0.5), ("p998", 0.998)):
                low, high = np.searchsorted(whole, r[name], "left"), np.searchsorted(whole, r[name], "right")
                room = 1 + 1.5 * sketches.rank_error(k) * len(whole)      # the error holds for 99 of 100 sketches
                assert low - room <= q * len(whole) <= high + room, (k, r["g"], name)
    assert sketches.rank_error(sketches.K) < 0.001
