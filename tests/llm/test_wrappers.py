"""Wrappers: alignment of token streams, their rendering against the parser's, awkward rows."""

import pytest

from inkwell.llm.markup import clean
from inkwell.llm.wrappers import PRIVATE, Wrapped, host, infer, learn_wrappers, merged, tag_counts, tokens, units, wrapped_texts

LIST = "<ul>{}</ul>"


def _streams(*texts):
    return [tokens(t)[0] for t in texts]


def test_repeats_become_groups():
    (w,) = infer(_streams(LIST.format("<li>Some words here</li>" * 3)))
    assert w.pattern() == "<ul> ( <li> # </li> )+ </ul>" and w.marked
    for n in (1, 2, 7):
        text = LIST.format("".join(f"<li>item number {i}</li>" for i in range(n)))
        stream, filled = tokens(text)
        got = "".join(filled[x] if isinstance(x, int) else x for x in w.render(stream))
        assert got == clean(text)[0]


def test_what_one_side_lacks_is_optional():
    ws = infer(_streams("'''Aaa bbb''' is a [[Ccc ddd]] of old", "'''Aaa bbb''' is a [[Ccc ddd|Eee fff]] of old"))
    assert [w.pattern() for w in ws] == ["''' # ''' · # · [[ # ( | # )? ]] · #"]
    assert [w.streams for w in ws] == [2]


def test_one_turn_joins_a_repeat():
    ws = infer(_streams("{{cite|aaa|bbb|ccc}} end", "{{cite|aaa}} end"))
    assert len(ws) == 1 and ws[0].streams == 2 and ")+" in ws[0].pattern()


def test_slots_take_any_words_but_not_markup():
    (w,) = infer(_streams("**Aaa bbb** and more."))
    assert w.render(tokens("**Other words** or fewer.")[0]) is not None
    assert w.render(tokens("**Other** [[words]] or fewer.")[0]) is None


def test_ordinary_signs_are_their_own_wrappers():
    ws = infer(_streams("2 * 3 * 4 equals 24", "**Aaa bbb** and more."))
    assert sorted(w.marked for w in ws) == [False, True]


def test_units_keep_constructs_whole():
    text = "one\n\n```\na\n\nb\n```\n\ntwo {{x\n\ny}} z\n\n{{never closed\n\nlast"
    assert [u for _, u in units(text)] == ["one", "```\na\n\nb\n```", "two {{x\n\ny}} z", "{{never closed", "last"]
    assert "".join(g + u for g, u in units(text)) == text


@pytest.mark.parametrize("text", ["", "plain", "a [[b]] c", "''x'' http://a.b/c_d_e [http://x.y label] z", "&nbsp;" * 3, "# x\n# y", LIST.format("<li>a</li>"), "[" * 2000 + "x" + "]" * 2000, "<b>" * 3000, "| a | b |\n|---|---|\n| 1 | 2 |"])
def test_tokens_and_parser_agree_without_wrappers(text):
    got = Wrapped({}).text(text)
    assert got[0].strip() == clean(text)[0].strip() and (got[1] > 0) == (clean(text)[1] > 0)


def test_a_fitting_wrapper_equals_the_parser():
    texts = ["'''Aaa bbb''' is a [[Ccc ddd|eee]].", "*  one thing\n*  two things\n*  three things", "A&nbsp;word &amp; more", "[^3]: A note.", "{| class=\"x\"\n! Year !! Count\n|-\n| 1803 || 180\n|}", "\\section{One two}\nText\\cite{abc} here", "thumb|left|285px|The work."]
    found = {}
    for t in texts:
        s = tokens(t)[0]
        found.setdefault(host(s), []).extend(infer([s]))
    apply = Wrapped(found)
    for t in texts:
        assert apply.text(t) == (clean(t)[0], 1, 0)


def test_awkward_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "'''b'''" * 3000, "x"), (None, "[[a]] b", "x"), (3, "plain", "x"), (3, "plain", "x"), (4, "a long text " * 20_000 + "<b>x</b>", "x"), (5, "[[" * 3000 + "{{" * 3000, "x"), (6, f"<b>{chr(0x13000)}</b>", "y"), (7, "a\n\n<!-- b\n\nc --> d", "y")]
    df = spark.createDataFrame(rows, "page_id bigint, text string, clean string")
    out = wrapped_texts(df, "page_id", "text").collect()
    got = {(r["page_id"], r["marks"] > 0): r["clean"] for r in out}
    assert len(out) == 10 and got[1, False] is None and got[2, False] == "" and got[None, True] == "a b" and got[3, False] == "plain"
    assert got[4, True] == "a long text " * 20_000 + "x" and (5, True) in got and PRIVATE.search(got[6, True]) and got[7, True] == "a\n\n d"
    assert wrapped_texts(df.limit(0), "page_id", "text").count() == 0 and learn_wrappers(df.limit(0), "text") == []
    assert {(r["tag"], r["n"]) for r in tag_counts(df, "text").collect()} == {("<b>"[:2], 2), ("</b", 2)}


def test_a_hot_text_is_one_stream(spark):
    df = spark.createDataFrame([(i, "== Same ==\nText of it" if i % 3 else f"''w{i} x'' y") for i in range(300)], "page_id bigint, text string").repartition(6)
    found = {w.pattern(): w for _, w in learn_wrappers(df, "text")}
    assert "== # · == ¶ #" in found and sum(w.streams for w in found.values()) <= 6
    assert wrapped_texts(df, "page_id", "text", fit_rows=10).where("marks > 0").count() == 300


TAGGED = [f"''Aaa bbb'' and <{t}>ccc ddd</{t}> eee" for t in ("b", "i", "u", "s", "sub", "sup", "small", "big", "strong", "em", "code", "span")]


def _parsed(df, **options):
    return {(r["page_id"], r["clean"], r["marks"]) for r in wrapped_texts(df, "page_id", "text", **options).where("marks > 0").collect()}, wrapped_texts(df, "page_id", "text", **options).agg({"parsed": "sum"}).first()[0]


def test_wrappers_come_from_all_rows(spark):
    marked = spark.createDataFrame(list(enumerate(TAGGED)), "page_id bigint, text string")
    df = marked.unionByName(spark.range(100, 40_100).selectExpr("id AS page_id", "concat('plain words ', id) AS text"))
    assert sum(w.streams for _, w in learn_wrappers(df, "text")) == len(TAGGED)
    assert _parsed(df) == ({(i, clean(t)[0], 1) for i, t in enumerate(TAGGED)}, 0)


def test_every_stream_of_a_host_has_its_part(spark, monkeypatch):
    monkeypatch.setattr("inkwell.llm.wrappers.HOST_STREAMS", 5)
    df = spark.createDataFrame([(100 * i + j, t) for i, t in enumerate(TAGGED) for j in range(1 + i % 3)], "page_id bigint, text string")
    assert {host(tokens(t)[0]) for t in TAGGED} == {"''"}
    assert sum(w.streams for _, w in learn_wrappers(df, "text")) == len(TAGGED)
    got, parsed = _parsed(df)
    assert parsed == 0 and got == {(100 * i + j, clean(t)[0], 1) for i, t in enumerate(TAGGED) for j in range(1 + i % 3)}


def test_equal_wrappers_are_one():
    (a,), (b,) = infer(_streams("[[Aaa bbb]] ccc")), infer(_streams("[[Ddd eee]] fff"))
    assert [w.streams for w in merged([a, b])] == [2]
