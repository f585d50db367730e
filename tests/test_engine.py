"""Articles, graph, vectors, ranking, quality, sources, history and streaming on small fixtures."""

import bz2
import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.functions.vectors import hash_encoder, l2_normalize, random_unit
from inkwell.operators import articles as A
from inkwell.operators import graph as G
from inkwell.operators import index as V
from inkwell.operators import quality as Q
from inkwell.operators.probe import measure
from inkwell.operators.ranking import Service
from inkwell.operators.report import html_report, json_report
from inkwell.sources import wiki as W
from inkwell.sources.runs import History
from inkwell.streaming.views import ingest_views, total_views

LONG = "word " * 30
XML = f"""<mediawiki>
<page><title>Alpha beta</title><ns>0</ns><id>1</id><revision><id>9</id><timestamp>2024-01-01T00:00:00Z</timestamp><text bytes="5">{LONG}[[Gamma]] [[Gamma]] [[Alpha beta]]</text></revision></page>
<page><title>Redirected</title><ns>0</ns><id>2</id><redirect title="x"/><revision><id>9</id><text>{LONG}</text></revision></page>
<page><title>Talk:Alpha</title><ns>1</ns><id>3</id><revision><id>9</id><text>{LONG}</text></revision></page>
<page><title>List of things</title><ns>0</ns><id>4</id><revision><id>9</id><text>{LONG}</text></revision></page>
<page><title>Mercury (disambiguation)</title><ns>0</ns><id>5</id><revision><id>9</id><text>{LONG}</text></revision></page>
<page><title>Short</title><ns>0</ns><id>6</id><revision><id>9</id><text>{"x" * 99}</text></revision></page>
<page><title>Empty</title><ns>0</ns><id>7</id><revision><id>9</id></revision></page>
<page><title>Gamma</title><id>8</id><revision><id>9</id><text>{"y" * 100}</text></revision></page>
</mediawiki>"""


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("xml")
    (folder / "dump.xml.bz2").write_bytes(bz2.compress(XML.encode()))
    return W.read_pages(spark, str(folder)).cache()


def test_admission(pages):
    got = A.admit(pages).orderBy("article_id").collect()
    assert [(r["article_id"], r["title"], r["lookup_title"]) for r in got] == [(1, "Alpha_beta", "alpha_beta"), (8, "Gamma", "gamma")]
    assert got[1]["model_text"].startswith("Gamma. yyy")
    counts = {r["reason"]: r["pages"] for r in A.skip_counts(pages).collect()}
    assert counts == {"admitted": 2, "redirect": 1, "namespace": 1, "list": 1, "disambiguation": 1, "short": 1, "no_text": 1}


def test_features_and_backlinks(pages):
    got = {r["article_id"]: r for r in A.features(pages).collect()}
    assert set(got) == {1, 6, 8} and got[1]["wikilink_count"] == 3 and got[1]["title_word_count"] == 2
    assert {r[0]: r[1] for r in A.backlinks_from_text(pages).collect()} == {"gamma": 2, "alpha_beta": 1}
    edges = G.resolve_links(G.page_links(pages), A.admit(pages))
    assert sorted(tuple(r) for r in edges.collect()) == [(1, 1), (1, 8)]


def test_xml_chunks(spark, pages, tmp_path):
    W.write_pages(pages, str(tmp_path / "out"), 3)
    assert len(list((tmp_path / "out").glob("part*"))) == 3
    assert W.read_pages(spark, str(tmp_path / "out")).count() == 8


def test_sql_tuples(spark, tmp_path):
    line = "INSERT INTO `pagelinks` VALUES (1939,0,2),(5,0,2),(7,1,2),(9,0,3);"
    with gzip.open(tmp_path / "links.sql.gz", "wt") as f:
        f.write(f"-- (1,0,2)\n{line}\nINSERT INTO `other` VALUES (1,0,2);\n")
    tuples = W.read_link_tuples(spark, str(tmp_path / "links.sql.gz"))
    assert {r[0]: r[1] for r in A.backlinks_from_tuples(tuples).collect()} == {2: 2, 3: 1}
    assert tuple(W.probe_dump(spark, str(tmp_path / "links.sql.gz")).first()) == (1, 4, 4)


VIEWS = """en.wikipedia Main_Page 1 desktop 10 A10
en Main_Page - mobile 5 A5
de.wikipedia Main_Page 1 desktop 9 A9
en.wikipedia Talk:X 1 desktop 3 A3
en.wikipedia - 1 desktop 3 A3
en.wikipedia C%2B%2B 2 desktop 7 A7
en.wikipedia a+b 3 desktop 2 A2
en.wikipedia Bad 1 desktop x A
en.wikipedia Short 1
en.wikipedia Zero 1 desktop 0 A
"""


def test_page_views(spark, tmp_path):
    (tmp_path / "v1").write_text(VIEWS)
    assert {r[0]: r[1] for r in W.read_views(spark, str(tmp_path / "v1")).collect()} == {"main_page": 15, "c++": 7, "a+b": 2}


def test_incremental_views(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    (folder / "day1").write_text(VIEWS)
    ingest_views(spark, str(folder), out, state)
    (folder / "day2").write_text("en Main_Page - mobile 1 A1\n")
    ingest_views(spark, str(folder), out, state)
    ingest_views(spark, str(folder), out, state)
    assert {r[0]: r[1] for r in total_views(spark, out).collect()}["main_page"] == 16


def test_keyed_updates(spark):
    base = spark.createDataFrame([(1, "a", 5), (2, "a", 6), (3, None, 7)], "id int, lookup_title string, n int")
    up = spark.createDataFrame([("a", 9)], "lookup_title string, n int")
    assert sorted(A.update_by_key(base, up, "lookup_title", {"n": 0}).select("id", "n").collect()) == [(1, 9), (2, 9), (3, 0)]
    assert sorted(A.update_by_key(base, up, "lookup_title", {"n": 0}, reset=False).select("id", "n").collect()) == [(1, 9), (2, 9), (3, 7)]
    assert A.add_column(base, "n", "int", 0) is base and A.add_column(base, "m", "int", 4).first()["m"] == 4
    assert A.available(base, ["n", "nope"]).columns == ["n"] and A.missing_columns(base, ["n", "nope"]) == ["nope"]


def test_lookups(spark):
    base = spark.createDataFrame([(1, "Foo"), (2, "foo"), (3, "bar")], "id int, t string")
    assert A.first_match(base, "foo", [F.col("t") == "foo", F.lower("t") == "foo"], "id").first()["id"] == 2
    assert A.first_match(base, "x", [F.col("t") == "x"], "id").count() == 0
    assert A.unprocessed(base, base.where("id = 1"), "id").count() == 2
    assert A.one_per_key(base.withColumn("k", F.lit(1)), ["k"], [F.desc("id")]).first()["id"] == 3


@pytest.mark.parametrize(
    ("extra", "rounds", "raw", "scaled"),
    [([], 3, [0.338948, 0.232138, 0.390126, 0.038789], [85.4334, 55.0323, 100, 0]), ([], None, [0.375046, 0.203606, 0.382570, 0.038778], [97.8116, 47.9440, 100, 0]), ([(1, 99)], 3, [0.364153, 0.213154, 0.377213, 0.045480], [96.0633, 50.5448, 100, 0]), ([(1, 99)], None, [0.410021, 0.181612, 0.364049, 0.044318], [100, 37.5426, 87.4293, 0])],
)
def test_pagerank(spark, extra, rounds, raw, scaled):
    v = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "article_id bigint")
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 1), *extra], "source_id bigint, target_id bigint")
    out = G.pagerank(v, e, iterations=rounds or 50, tolerance=1e-6 if rounds is None else None).orderBy("article_id").collect()
    assert [r["rank"] for r in out] == pytest.approx(raw, abs=2e-6)
    assert [r["pagerank"] for r in out] == pytest.approx(scaled, abs=2e-3)
    assert sum(r["rank"] for r in out) == pytest.approx(1)


def test_graph_edges_of_nothing(spark):
    v, e = spark.createDataFrame([], "article_id bigint"), spark.createDataFrame([], "source_id bigint, target_id bigint")
    assert G.pagerank(v, e).count() == 0 and G.graph_stats(e).first()["edges"] == 0


def test_expansion(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (2, 1)], "source_id bigint, target_id bigint")
    start = spark.createDataFrame([(1,)], "id bigint")
    assert sorted(tuple(r) for r in G.expand(e, start, 3).collect()) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    scored = spark.createDataFrame([(1, i, float(i)) for i in range(2, 8)], "source_id bigint, target_id bigint, s double")
    assert sorted(r["id"] for r in G.beam(scored, start, "s", depth=1).collect()) == [1, 5, 6, 7]


@pytest.fixture(scope="module")
def flat(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 32))
    x = centres[rng.integers(0, 12, 900)] + 0.4 * rng.standard_normal((900, 32))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5000, None), (5001, [0.0] * 32), (5002, [float("nan")] * 32), (None, [1.0] * 32)]
    return V.flat_index(spark.createDataFrame(rows, "id bigint, v array<double>"), "id", "v").cache()


def test_exact_search_is_brute_force(flat):
    assert flat.count() == 900
    rows = sorted(flat.collect())
    m = np.array([r["unit"] for r in rows])
    got = V.search_exact(flat, flat.where("id % 50 = 0").select(F.col("id").alias("query"), "unit"), 7)
    by = {}
    for r in got.collect():
        by.setdefault(r["query"], {})[r["rank"]] = r["id"]
    for q, near in by.items():
        s = m @ m[q]
        s[q] = -9
        assert [near[i] for i in range(1, 8)] == list(np.argsort(-s, kind="stable")[:7])


def test_index_recall_and_storage(spark, flat, tmp_path, monkeypatch):
    queries = flat.where("id % 50 = 0").select(F.col("id").alias("query"), "unit")
    truth = V.search_exact(flat, queries, 10)
    built = V.IvfPq.train(flat, parts=8).add(flat)
    assert V.recall(built.search(queries, 10), truth).first()[0] >= 0.9
    built.save(str(tmp_path / "index"))
    again = V.IvfPq.load(spark, str(tmp_path / "index"))
    monkeypatch.setattr(V, "QUERY_BLOCK", 5)  # several blocks of queries
    everything = again.search(queries, 10, probes=10_000, pool=900)
    assert sorted((r["query"], r["id"]) for r in everything.collect()) == sorted((r["query"], r["id"]) for r in truth.collect())
    assert again.search(queries.limit(0), 10).count() == 0


def test_index_recall_does_not_shrink_with_size(spark, tmp_path):
    units = np.random.default_rng(5).normal(size=(20_000, 64))  # no clusters: a fixed number of lists finds three quarters
    made = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(units)], "id bigint, v array<double>")
    index = V.flat_index(made, "id", "v").cache()
    queries = index.where("id % 100 = 0").select(F.col("id").alias("query"), "unit")
    built = V.IvfPq.train(index).add(index)
    assert V.recall(built.search(queries, 10), V.search_exact(index, queries, 10)).first()[0] >= 0.9
    built.save(str(tmp_path / "index"))
    again = V.IvfPq.load(spark, str(tmp_path / "index"))
    assert (again.probes, again.pool) == (built.probes, built.pool) and again.probes > 32


def test_small_indexes_stay_flat(spark, flat):
    assert V.build(flat) is None
    queries = flat.where("id = 3").select(F.col("id").alias("query"), "unit")
    assert V.search(flat, None, queries, 2).count() == 2
    assert [r["id"] for r in V.reconstruct(flat, spark.createDataFrame([(3,), (3,), (77_777,)], "id bigint")).collect()] == [3]
    row = V.consistency(spark.createDataFrame([(3,), (4,), (88_888,), (None,)], "article_id bigint"), flat).first()
    assert (row["without_vector"], row["without_article"], row["consistent"]) == (1, 898, False)


def test_probe(spark):
    def call(i):
        if i == 2:
            raise ValueError

    out = measure(spark, "x", call, 4, workers=2, rate=1000)
    assert sorted((r["i"], r["success"]) for r in out.collect()) == [(0, True), (1, True), (2, False), (3, True)]
    assert Q.throughput(out, "name", "latency_ms", "success").first()["success_rate"] == 75


def test_inlinks(spark):
    tuples = spark.createDataFrame([(1, 0, 2), (9, 1, 2), (5, 0, 3)], "pl_from bigint, pl_from_namespace int, pl_target_id bigint")
    pages = spark.createDataFrame([(1, "A"), (1, "A")], "page_id bigint, page_title string")
    assert sorted((r["page_id"], r["title"]) for r in G.inlinks(tuples, pages, 2).collect()) == [(1, "A"), (9, None)]


def test_encoder(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta"), (3, None), (4, "")], "id int, t string")
    got = {r["id"]: r["v"] for r in df.select("id", hash_encoder(64)(F.col("t")).alias("v")).collect()}
    assert got[1] == got[2] and sum(x * x for x in got[1]) == pytest.approx(1) and set(got[3]) == {0.0}
    assert sum(x * x for x in random_unit(8, 3)) == pytest.approx(1)
    assert spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(l2_normalize(F.col("v"))).first()[0] is None


def test_service(spark):
    units = {1: [1.0, 0.0], 2: [0.8, 0.6], 3: [0.6, 0.8], 4: [0.0, 1.0]}
    index = spark.createDataFrame(list(units.items()), "id bigint, unit array<double>")
    articles = spark.createDataFrame([(1, "Paris", "paris", 100.0, 10**6), (2, "Big_city", "big_city", 50.0, 1000), (3, "Talk:x", "talk:x", 50.0, 1000), (9, "Gone", "gone", 1.0, 1)], "article_id bigint, title string, lookup_title string, pagerank double, pageviews bigint")
    s = Service(articles, index)
    results, edges = s.related([1.0, 0.0], "paris", debug=True)
    assert [r["title"] for r in results.collect()] == ["Big_city"]
    results, edges = s.related([1.0, 0.0], "city", context="Paris, Nowhere", ranking="semantic")
    assert [(r["title"], r["score"]) for r in results.collect()] == [("Paris", 100), ("Big_city", 80)]
    assert {(r["source"], r["target"]) for r in edges.collect()} == {("Paris", "Big_city"), ("Big_city", "Paris")}
    assert s.related([1.0, 0.0], "city", k=-3)[0].count() == 0
    assert s.article("big city").first()["pagerank_norm"] == pytest.approx(0.574349, abs=1e-6) and s.article("none").count() == 0
    assert s.signals() == {"pagerank": True, "pageviews": True, "backlinks": False}
    assert s.health().first()["pagerank_coverage"] == 100.0


def test_quality(spark):
    lat = spark.createDataFrame([("a", float(x)) for x in (10, 20, 30, 40)] + [("b", 1.0)], "g string, v double")
    r = {x["g"]: x for x in Q.nearest_rank(lat, "g", "v").collect()}
    assert (r["a"]["p50"], r["a"]["p95"], r["a"]["p99"]) == (30, 40, 40) and r["b"]["p50"] == 1
    assert {x["g"]: x["p50"] for x in Q.linear_percentiles(lat, "g", "v").collect()}["a"] == 25
    found = spark.createDataFrame([("q", "Deep learning"), ("r", "x")], "query string, title string")
    wanted = spark.createDataFrame([("q", "LEARNING"), ("q", "cat"), ("s", "y")], "query string, wanted string")
    assert {x["query"]: (x["recall"], x["success"]) for x in Q.substring_recall(found, wanted).collect()} == {"q": (0.5, True), "s": (0.0, False)}
    ranks = Q.length_rank(spark.createDataFrame([(1, 5), (2, 9), (3, 5), (4, None)], "id int, n int"), "id", "n")
    assert {x["id"]: x["rank"] for x in ranks.collect()} == {2: 1, 1: 2, 3: 3, 4: 4}
    assert Q.correlation(lat.withColumn("w", F.col("v")), "v", "w").first()["verdict"] == "none"
    assert Q.import_complete(90, 100) == "complete" and G.sparsity(0, 0) == 0


def test_samples_and_rates(spark):
    df = spark.range(100)
    first = [r[0] for r in Q.sample_rows(df, 5, "id", 3).collect()]
    assert first == [r[0] for r in Q.sample_rows(df.repartition(7), 5, "id", 3).collect()] and len(set(first)) == 5
    assert [r[0] for r in Q.last_rows(df, 2, "id").collect()] == [99, 98]
    results = spark.createDataFrame([("q", 1, "Bank of x"), ("q", 9, "River"), ("r", 1, "Other")], "query string, rank int, title string")
    expected = spark.createDataFrame([("g", "q", "bank"), ("g", "r", "bank"), ("h", "q", "river"), ("h", "s", "x")], "g string, query string, wanted string")
    assert {r["g"]: r["rate"] for r in Q.hit_rate(results, expected, "g", 3).collect()} == {"g": 0.5, "h": 0.0}
    got = spark.createDataFrame([("clustering", 0.7), ("disambiguation", 0.9), ("x", 0.1)], "k string, v double").select(Q.quality_verdict(F.col("k"), F.col("v"))).collect()
    assert [r[0] for r in got] == [False, True, True]
    names = spark.createDataFrame([("b",), ("Query Type: a",)], "name string")
    assert Q.query_type_benchmarks(names).count() == 1 and Q.query_type_benchmarks(names.where("name = 'b'")).count() == 1


def test_history_and_reports(spark, tmp_path):
    h = History(spark, str(tmp_path / "h"))
    assert h.create_run("one", at=5) == 1 and h.create_run("two") == 2 and h.previous(2) == 1 and h.previous(1) is None
    h.log("quality", 1, spark.createDataFrame([("graph", "x", True, 0.5, '{"hops": 3}')], "test_type string, test_name string, success boolean, value double, details string"))
    assert h.details(1, "graph", "hops int").first()["hops"] == 3 and h.facts("api").count() == 0
    html_report(str(tmp_path / "r.html"), "Run <1>", {"Quality": h.facts("quality", 1)})
    json_report(str(tmp_path / "r.json"), h.runs().orderBy("run_id"))
    assert "Run &lt;1&gt;" in (tmp_path / "r.html").read_text() and '"run_id": 1' in (tmp_path / "r.json").read_text()


def test_files_and_versions(spark, tmp_path):
    assert W.resolve_files(["b.bz2", "b", "a.bz2"], {"a.bz2"}) == ["b"]
    with pytest.raises(FileNotFoundError):
        W.resolve_files([])
    assert len(W.day_files(2024, 2)) == 29 and W.padded_name("checkpoint_", 7, 9) == "checkpoint_000000007"
    assert W.next_version(None) == "v0.0.1" and W.next_version("v1.2.9") == "v1.2.10"
    with pytest.raises(ValueError, match="malformed"):
        W.next_version("v1.x")
    for n in range(5):
        W.save_snapshot(spark.range(n), str(tmp_path), n)
    assert len(list(tmp_path.glob("checkpoint_*"))) == 3 and W.newest_snapshot(str(tmp_path)).endswith("000000004")
