import math
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from inkwell.operators.skew import frequent_keys, hot_keys, key_quantiles, salted_join, select_ranks
from inkwell.operators.order import with_positions
from pyspark.sql import functions as F


def _nearest(values, p):
    v = sorted(values)
    return v[max(1, math.ceil(p * len(v) / 100)) - 1]


@pytest.mark.parametrize("leaf", [1, 10, 65_536])
def test_key_quantiles_equal_sorted_values(spark, leaf):
    random.seed(leaf)
    data = [("hot", random.choice([random.randint(-(10**12), 10**12), 7])) for _ in range(3000)]
    data += [(random.choice("abc"), random.randint(0, 5)) for _ in range(200)] + [("only_null", None), (None, 3), ("a", None)]
    out = key_quantiles(spark.createDataFrame(data, "k string, v bigint"), "k", "v", [1, 50, 95, 100], leaf_rows=leaf)
    by = defaultdict(list)
    for k, v in data:
        if k is not None:
            by[k].append(v)
    got = {r["k"]: r for r in out.collect()}
    assert got.keys() == by.keys()
    for k, vs in by.items():
        present = [v for v in vs if v is not None]
        assert (got[k]["n_rows"], got[k]["n_values"]) == (len(vs), len(present))
        for p in (1, 50, 95, 100):
            assert got[k][f"p{p}"] == (_nearest(present, p) if present else None)


def test_select_ranks_with_weights_and_missing_ranks(spark):
    rows = spark.createDataFrame([("g", 10, 5), ("g", 20, 0), ("g", 30, 1), ("h", -4, 2), ("h", None, 9), (None, 1, 1)], "g string, v bigint, w bigint")
    ranks = spark.createDataFrame([("g", 1, 1), ("g", 5, 5), ("g", 6, 6), ("g", 7, 7), ("h", 1, 2), ("none", 1, 1)], "g string, rank_id int, rank bigint")
    got = {(r[0], r[1]): r[2] for r in select_ranks(rows, ranks, ["g"], "v", "w", leaf_rows=1).collect()}
    assert got == {("g", 1): 10, ("g", 5): 10, ("g", 6): 30, ("h", 1): -4}


def test_select_ranks_of_an_empty_table(spark):
    rows = spark.createDataFrame([], "g string, v bigint")
    ranks = spark.createDataFrame([("g", 1, 1)], "g string, rank_id int, rank bigint")
    assert select_ranks(rows, ranks, ["g"], "v").collect() == []


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["x", "y", "", "z", None, "ключ"]), max_size=60))
def test_frequent_keys_equal_counts(spark, keys):
    share = 5
    df = spark.createDataFrame([("f", k, 1) for k in keys], "field string, key string, extra int")
    want = {k: n for k, n in Counter(keys).items() if k is not None and n * share >= len(keys)}
    assert {r["key"]: r["n_rows"] for r in frequent_keys(df, "field", "key", share).collect()} == want


def test_frequent_keys_of_an_empty_table(spark):
    assert frequent_keys(spark.createDataFrame([], "field string, key string"), "field", "key").count() == 0


def test_salted_join_equals_join(spark):
    left = spark.createDataFrame([(1, i) for i in range(100)] + [(2, 0), (None, 5), (9, 1)], "k int, v int")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "k int, w string")
    hot = hot_keys(left, ["k"], 0.5)
    assert [r[0] for r in hot.collect()] == [1]
    for how in ("left", "inner"):
        got = salted_join(left, right, ["k"], hot, how, salts=4).select("k", "v", "w").collect()
        assert sorted(map(str, got)) == sorted(map(str, left.join(right, "k", how).select("k", "v", "w").collect()))


def test_clashing_names_and_nulls(spark):
    df = spark.createDataFrame([("a", 1, None, 3), ("a", None, "x", 3), (None, 2, "y", None)], "count string, v bigint, k string, n bigint")
    assert [r[0] for r in hot_keys(df, ["count"], 0.5).collect()] == ["a"]
    got = key_quantiles(df, "count", "n", [50]).collect()
    assert [tuple(r) for r in got] == [("a", 2, 2, 3)]
    named = frequent_keys(df.withColumn("grp", F.lit("g")).withColumn("h", F.lit(0)), "grp", "count", 2).collect()
    assert [(r["grp"], r["count"], r["n_rows"]) for r in named] == [("g", "a", 2)]


def test_positions_are_a_total_order(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(500)], "a int, b int")
    got = [r["rank"] for r in with_positions(df, [F.desc("a"), F.asc("b")]).orderBy(F.desc("a"), "b").collect()]
    assert got == list(range(1, 501))
    assert with_positions(df.limit(0), [F.asc("a")]).count() == 0
