"""Cumulated weights, incremental orphans with deletions, paths, look-alikes, reports and search on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from inkwell.functions.lookalike import look_key, look_keys, with_key
from inkwell.functions.vectors import hash_encoder
from inkwell.operators import articles as A
from inkwell.operators import graph as G
from inkwell.operators import quality as Q
from inkwell.operators.order import cumulated
from inkwell.operators.orphans import ALWAYS, PARENT_SCHEMA, REF_SCHEMA, OrphanTracker, track
from inkwell.operators.ranking import Service
from inkwell.operators.report import bars, comparison, html_report
from inkwell.session import scratch

DAY = 86_400_000_000
AT = 19_730 * DAY  # 2024-01-08


def _refs(spark, *rows):
    return spark.createDataFrame([("t", k, i, k, at) for i, (k, at) in enumerate(rows)], REF_SCHEMA)


def _parents(spark, *rows):
    return spark.createDataFrame([("t", *r) for r in rows], PARENT_SCHEMA)


def test_cumulated_equals_brute_force(spark):
    random.seed(4)
    rows = [(random.choice(["hot", "hot", "a", None]), random.randint(0, 9), i, random.choice([None, 0, 1, 5])) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, v int, i int, w int").repartition(5)
    got = {r["i"]: (r["upto"], r["total"]) for r in cumulated(df, ["g"], [F.asc("v"), F.asc("i")], "w").collect()}
    for g in ("hot", "a", None):
        mine, run = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])), 0
        total = sum(r[3] or 0 for r in mine)
        for r in mine:
            run += r[3] or 0
            assert got[r[2]] == (run, total)
    assert cumulated(df.limit(0), ["g"], [F.asc("v")]).count() == 0


def test_group_statistics_equal_numpy(spark):
    import numpy as np

    random.seed(5)
    rows = [("hot" if i % 3 else "a", float(random.randint(0, 50)), i) for i in range(500)] + [("n", None, 900)]
    df = spark.createDataFrame(rows, "g string, v double, i int").repartition(6)
    for r in Q.linear_percentiles(df, "g", "v").collect():
        x = [v for g, v, _ in rows if g == r["g"] and v is not None]
        if not x:
            assert r["p50"] is None
            continue
        assert [r["p50"], r["p95"], r["p99"]] == pytest.approx([np.percentile(x, p) for p in (50, 95, 99)], abs=1e-6) and r["mean"] == pytest.approx(np.mean(x), abs=1e-6)
    for r in Q.halves(df.where("v IS NOT NULL"), "g", [F.asc("i")], "v").collect():
        x = [v for g, v, _ in rows if g == r["g"]]
        assert (r["first_half"], r["second_half"]) == (pytest.approx(np.mean(x[: len(x) // 2]), abs=1e-6), pytest.approx(np.mean(x[len(x) // 2 :]), abs=1e-6))
    gaps = {r["i"]: r["gap"] for r in Q.gaps(df.where("g = 'a'"), "g", "v", "i").collect()}
    order = sorted((r for r in rows if r[0] == "a"), key=lambda r: (-r[1], r[2]))
    assert gaps == {a[2]: (a[1] - b[1] if b else None) for a, b in zip(order, [*order[1:], None], strict=True)}


@pytest.mark.parametrize("live", [1, 3, 99])
def test_replay_and_batches_agree(spark, live):
    random.seed(live)
    refs = _refs(spark, *[(random.choice(["hot", "hot", *"abcdef"]), AT + random.randint(0, 150) * DAY) for _ in range(200)])
    parents = _parents(spark, ("hot", AT + 70 * DAY), ("a", ALWAYS), ("b", AT + 400 * DAY), ("c", AT + 31 * DAY))
    shots = []
    late, absent = track(refs, parents, hot_share=0.2, snapshots=shots, live=live)
    got = {(r["batch"], r["period"], r["pending"]) for s in shots for r in s.collect()}
    one = []
    late1, absent1 = track(refs, parents, hot_share=0.2, snapshots=one, live=1)
    assert got == {(r["batch"], r["period"], r["pending"]) for s in one for r in s.collect()}
    assert sorted(r["source_id"] for r in late.collect()) == sorted(r["source_id"] for r in late1.collect())
    assert sorted(r["source_id"] for r in absent.collect()) == sorted(r["source_id"] for r in absent1.collect())


def test_deletions_in_history(spark):
    refs = _refs(spark, ("a", AT), ("a", AT + 40 * DAY), ("b", AT), ("b", AT + 70 * DAY))
    gone = spark.createDataFrame([("t", "a", AT + 35 * DAY), ("t", None, AT)], "ref_table string, key string, at bigint")
    shots = []
    late, absent = track(refs, _parents(spark, ("a", ALWAYS), ("b", ALWAYS)), snapshots=shots, deletions=gone)
    assert late.count() == 0 and sorted(r["source_id"] for r in absent.collect()) == [0, 1]
    assert {(r["batch"], r["pending"]) for s in shots for r in s.collect() if r["period"] == "2024-01"} == {("2024-02", 1), ("2024-03", 1)}
    with pytest.raises(ValueError, match="keep_resolved"):
        OrphanTracker(spark).advance(refs, _parents(spark), gone)


def test_look_alikes_with_accents_and_small_capitals():
    assert look_key("Ν̃dure") == look_key("ñdure") and look_key("ʀᴏᴍᴇ") == "rome" and look_key("ᎪᏴc") == "abc"
    assert look_keys(["Ａ b", "", "  x\t", "Ёж", "a\x00b"]) == [look_key(t) for t in ("Ａ b", "", "  x\t", "Ёж", "a\x00b")]
    assert look_keys([]) == []


def test_keys_of_a_hot_title(spark):
    df = spark.createDataFrame([("Ｈot", i) for i in range(300)] + [("plain x", 1), (None, 2), ("", 3)], "t string, key int").repartition(4)
    got = with_key(df, "t", "link", "k").collect()
    assert len(got) == 303 and {r["t"]: r["k"] for r in got} == {"Ｈot": "hot", "plain x": "plain_x", None: None, "": None}


def test_find_path(spark):
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 5), (3, None)], "source_id bigint, target_id bigint")
    assert tuple(G.find_path(edges, 0, 4).first()) == (True, 3, [0, 1, 3, 4])
    assert tuple(G.find_path(edges, 0, 0).first()) == (True, 0, [0])
    assert tuple(G.find_path(edges, 0, 5).first()) == (False, None, None) and tuple(G.find_path(edges.limit(0), 1, 2).first()) == (False, None, None)


def test_updates_of_hot_and_null_keys(spark):
    df = spark.createDataFrame([("hot", i, 7) for i in range(200)] + [(None, 900, 7), ("b", 901, 7)], "k string, i int, x int")
    new = spark.createDataFrame([("hot", 1), ("c", 3)], "k string, x int")
    got = {r["i"]: r["x"] for r in A.update_by_key(df, new, "k", {"x": 0}).collect()}
    assert len(got) == 202 and {got[i] for i in range(200)} == {1} and got[900] == got[901] == 0
    assert {r["i"]: r["x"] for r in A.update_by_key(df, new, "k", {"x": 0}, reset=False).collect()}[900] == 7


def test_text_search(spark):
    titles = [(1, "Deep_learning"), (2, "Steam_engine"), (3, "Deep_sea"), (4, "Engine_oil")]
    articles = spark.createDataFrame(titles, "article_id bigint, title string")
    encode = hash_encoder(256)
    index = articles.select(F.col("article_id").alias("id"), encode("title").alias("unit"))
    s = Service(articles, index)
    assert [(r["rank"], r["title"]) for r in s.search("steam engine", encode, 1).collect()] == [(1, "Steam_engine")]
    assert s.search("deep learning", encode).first()["title"] == "Deep_learning" and s.search("", encode).count() == 0


def test_comparison_and_bars(spark, tmp_path):
    new = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("<c>", 3.0)], "name string, latency double")
    old = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "name string, latency double")
    part = comparison("Runs", Q.compare_runs(new, old, "name", {"latency": True}), "name", ["latency"])
    html_report(str(tmp_path / "r.html"), "R", {"New": new}, [part, bars("Shares", new.withColumn("s", F.col("latency") / 2), "name", "s")])
    text = (tmp_path / "r.html").read_text()
    assert "-1.000" in text and "+1.000" in text and "&lt;c&gt;" in text and "width:20.0em" in text


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    class Elsewhere:
        sparkContext = type("C", (), {"master": "spark://x:7077", "applicationId": "a", "getConf": lambda self=None: type("D", (), {"get": lambda self, k, d: d})()})()

    with pytest.raises(RuntimeError, match="share"):
        scratch(Elsewhere())
