"""What the plans of the queries must look like: pruned scans, pushed filters, no product of tables, no Python in the core."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from inkwell.plans import reference

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_views_read_three_columns(spark):
    plan = _plan(entry.queries()["pageviews_by_title"](spark, SF))
    assert re.search(r"ReadSchema: struct<project:string,title:string,view_count:bigint>", plan) and "PushedFilters: [" in plan and "GreaterThan(view_count" in plan
    assert "partial_sum" in plan


@pytest.mark.parametrize("name", ["link_graph", "backlinks_by_title", "backlinks_by_id", "signal_merge", "restricted_edges", "text_links", "overlap_sets", "coverage_report", "latency_nearest_rank"])
def test_core_plans_stay_in_the_jvm(spark, name):
    plan = _plan(entry.queries()[name](spark, SF))
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)


@pytest.mark.parametrize("name", ["coverage_report", "backlink_buckets", "signal_2x2", "health"])
def test_coverage_is_one_pass(spark, name):
    assert _plan(entry.queries()[name](spark, SF)).count("FileScan") == 1


@pytest.mark.parametrize(("change", "same"), [("id", True), ("id + CASE WHEN rank = 32 THEN 1 ELSE 0 END", False)])
def test_runs_that_differ_are_seen(spark, monkeypatch, change, same):
    search, calls = reference.V.search_exact, []

    def second_differs(*args):
        calls.append(args)
        found = search(*args)
        return found if len(calls) == 1 else found.withColumn("id", F.expr(change))

    monkeypatch.setattr(reference.V, "search_exact", second_differs)
    assert tuple(entry.queries()["identical_runs"](spark, SF).first()) == (2, same)


def test_connectivity_asks_every_member(spark, tmp_path):
    rng = np.random.default_rng(3)
    vectors, labels = rng.normal(size=(120, 8)), [i % 3 for i in range(120)]
    made = spark.createDataFrame([(i, v.tolist(), g) for i, (v, g) in enumerate(zip(vectors, labels, strict=True))], "vec_id bigint, embedding array<double>, label int")
    made.write.parquet(f"{tmp_path}/embeddings.parquet")
    units = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    scores = units @ units.T
    np.fill_diagonal(scores, -np.inf)
    found = Counter(labels[i] for i in range(120) for j in np.argsort(-scores[i])[:10] if labels[i] == labels[j])
    got = {r["label"]: r for r in entry.queries()["domain_connectivity"](spark, str(tmp_path)).collect()}
    assert {g: (r["n"], r["found"]) for g, r in got.items()} == {g: (40, found[g]) for g in range(3)}
    assert all(r["connectivity"] == round(found[g] / (40 * 39), 6) for g, r in got.items())
