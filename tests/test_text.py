import pytest
from pyspark.sql import functions as F

from inkwell.functions import scoring as S
from inkwell.functions import text as T


def _one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("'''A''' is [[Foo|bar]] and [[Baz]].{{cite}}", "'''A''' is bar and Baz."),
        ("x{{a{{b}}c}}y", "xc}}y"),
        ("A<ref name=q/> keep <ref>z</ref>B", "AB"),
        ("[[File:a.jpg|thumb|cap]] t", "thumb|cap t"),
        ("see [http://e.org link] <b>b</b>\xa0\n c", "see b c"),
        ("", ""),
        (None, None),
    ],
)
def test_clean_wikitext(spark, raw, clean):
    assert _one(spark, raw, T.clean_wikitext) == clean


def test_strict_cleaning(spark):
    assert _one(spark, "A<ref name=q/> keep <ref>z</ref>B [[File:a.jpg|thumb|a [[b]] c]]", lambda c: T.clean_wikitext(c, strict=True)) == "A keep B"


def test_links_and_titles(spark):
    text = "[[United States|US]] [[World War II#Causes]] [[ ]] [[#sec]] [[Category:X]] [[:Category:Y]] [[Draft:Z]] [[Foo]] [[foo]]"
    got = spark.createDataFrame([(text,)], "x string").select(F.explode(T.wikilinks(F.col("x"))).alias("t")).select(T.normalize_title(F.col("t")).alias("n")).select("n", T.is_special_page(F.col("n"), False), T.is_special_page(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [
        ("united_states", False, False), ("world_war_ii", False, False), (None, True, True), (None, True, True), ("category:x", True, True),
        (":category:y", False, False), ("draft:z", False, True), ("foo", False, False), ("foo", False, False),
    ]


@pytest.mark.parametrize("title", ["List_of_x", "2025_NSWRL_Feeder", "Bankruptcy_act_law_1900", "Revision_Act_of_law", "Birthday_Honours", "Sport_in_1999", "History_of_X", "Commemorative_coin_x", "Foo_(disambiguation)"])
def test_skipped(spark, title):
    assert _one(spark, title, T.should_skip_article)


def test_kept(spark):
    assert not _one(spark, "1984", T.should_skip_article) and not _one(spark, "Python", T.should_skip_article) and not _one(spark, None, T.should_skip_article)


@pytest.mark.parametrize(
    ("title", "query", "score"),
    [("Machine_learning", "machine learning", 1.0), ("Machine_learning", "Machine_learning", 0.0), ("Education_in_Nigeria", "education", 0.5), ("Education_in_India", "education", 0.25), ("2023_in_science", "science", 0.2), ("List_of_cities_in_Japan", "cities", 0.045), ("Paris", "capital of France", 0.0), ("History_of_France", "France", 0.15), ("", "x", 0.0)],
)
def test_title_match(spark, title, query, score):
    assert _one(spark, title, lambda c: T.title_match(c, F.lit(query))) == pytest.approx(score)


@pytest.mark.parametrize(("p", "want"), [(None, 0), (-1.0, 0), (0.0, 0), (10.0, 0.158489), (50.0, 0.574349), (100.0, 1)])
def test_pagerank_norm(spark, p, want):
    assert _one(spark, p, S.normalize_pagerank, "double") == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize(("v", "want"), [(None, 0), (0, 0), (1, 0), (10, 0), (1000, 1 / 3), (10_000_000, 1), (1_000_000_000, 1)])
def test_views_norm(spark, v, want):
    assert _one(spark, v, S.normalize_pageviews, "bigint") == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize(
    ("sem", "pr", "pv", "title", "query", "want", "shown"),
    [(0.8, 50.0, 100000, "Machine_learning", "machine learning", 0.702119, 70), (0.8, 0.0, 100000, "Machine_learning", "machine learning", 0.000553, 0), (-0.1, 50.0, 1000, "Paris", "paris", 0.000076, 0), (0.9, 100.0, 10_000_000, "Paris", "Paris", 0.948683, 94)],
)
def test_multisignal(spark, sem, pr, pv, title, query, want, shown):
    row = spark.createDataFrame([(sem, pr, pv, title)], "s double, p double, v bigint, t string")
    score = S.multisignal(F.col("s"), S.normalize_pagerank(F.col("p")), S.normalize_pageviews(F.col("v")), T.title_match(F.col("t"), F.lit(query)))
    got = row.select(score.alias("x")).select("x", S.percent_score(F.col("x"))).first()
    assert got[0] == pytest.approx(want, abs=1e-6) and got[1] == shown


def test_percent_decode(spark):
    assert [_one(spark, x, T.percent_decode) for x in ("a+b", "C%2B%2B", "a%zz", "a%zz%20b%", "%E9x", None)] == ["a+b", "C++", "a%zz", "a%zz b%", "\ufffdx", None]


def test_small_functions(spark):
    assert _one(spark, " a_b , ,c", T.parse_context) == ["a b", "c"]
    assert _one(spark, "aB_c", T.query_variations) == ["aB_c", "ab_c", "AB_C", "aB c", "aB_c"]
    assert [_one(spark, x, T.format_bytes, "bigint") for x in (0, 1023, 1024, 5 * 1024**3)] == ["0.00 B", "1023.00 B", "1.00 KB", "5.00 GB"]
    assert _one(spark, "  ", T.words) == []
    assert _one(spark, 5.0, lambda c: S.minmax100(c, F.lit(5.0), F.lit(5.0)), "double") == 0
    assert _one(spark, 5.0, lambda c: S.change_kind(c, F.lit(4.0), True), "double") == "worse"
