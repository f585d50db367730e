"""Text and title functions of the corpus, as Column expressions (contracts C1-C6, C13, C15 of the survey)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Title prefixes of pages that are no articles.
SPECIAL_PREFIXES = ("file:", "image:", "category:", "template:", "wikipedia:", "help:", "portal:", "user:", "talk:", "mediawiki:", "special:")
SPECIAL_PREFIXES_DRAFT = (*SPECIAL_PREFIXES, "draft:")
META_PREFIXES = ("wikipedia:", "template:", "category:", "portal:", "help:", "user:", "talk:", "file:", "mediawiki:")
SKIPPED_PREFIXES = ("list_of_", "index_of_", "glossary_of_", "outline_of_", "timeline_of_", "rosters_of_", "history_of_", "bibliography_of_", "discography_of_")
LISTING_STARTS = ("list of", "index of", "glossary of", "timeline of", "outline of", "history of")
PLACE_WORDS = (
    "africa", "asia", "europe", "america", "states", "kingdom", "china", "india", "russia", "france", "germany", "japan",
    "canada", "australia", "brazil", "mexico", "italy", "spain", "california", "texas", "york", "london", "paris", "tokyo",
)
# The cleaning steps of C1, pattern and replacement, in their order.
CLEANING = (
    (r"\{\{[^}]*\}\}", ""),
    (r"(?s)<ref[^>]*>.*?</ref>", ""),
    (r"<ref[^>]*/>", ""),
    (r"\[\[(?:[^|\]]*\|)?([^\]]+)\]\]", "$1"),
    (r"\[http[^\]]*\]", ""),
    (r"<[^>]+>", ""),
    (r"(?i)\[\[File:.*?\]\]", ""),
    (r"(?i)\[\[Image:.*?\]\]", ""),
    (r"(?U)\s+", " "),
)
WIKILINK = r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"
_BLANKS = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends (trim() takes only U+0020)."""
    return F.regexp_replace(c, _BLANKS, "")


def clean_wikitext(c: Column, strict: bool = False) -> Column:
    """C1. strict: media links go before links are unwrapped, and a self-closing ref never swallows the text after it."""
    steps = list(CLEANING)
    if strict:
        steps = [steps[0], steps[2], steps[1], (r"(?i)\[\[(?:File|Image):[^\[\]]*(?:\[\[[^\[\]]*\]\][^\[\]]*)*\]\]", ""), *steps[3:6], steps[8]]
    return strip(reduce(lambda x, s: F.regexp_replace(x, F.lit(s[0]), F.lit(s[1])), steps, c))


def wikilinks(c: Column) -> Column:
    """C4: targets of all links of the raw text, in order."""
    return F.regexp_extract_all(c, F.lit(WIKILINK), F.lit(1))


def normalize_title(c: Column) -> Column:
    """Stripped, cut at the first '#', blanks as underscores, lower case; null where nothing is left."""
    t = strip(F.substring_index(strip(c), "#", 1))
    return F.nullif(F.lower(F.replace(t, F.lit(" "), F.lit("_"))), F.lit(""))


def is_special_page(norm: Column, draft: bool = True) -> Column:
    """C6 of a normalised title; null and empty ones are special."""
    prefixes = SPECIAL_PREFIXES_DRAFT if draft else SPECIAL_PREFIXES
    return F.coalesce((norm == "") | norm.rlike("^(" + "|".join(prefixes) + ")"), F.lit(True))


def should_skip_article(title: Column) -> Column:
    """Titles that the metadata pass leaves out; null titles stay."""
    t = F.lower(title)
    has = lambda *words: t.rlike("|".join(words))
    return F.coalesce(
        t.rlike("^(" + "|".join(SKIPPED_PREFIXES) + ")")
        | title.rlike(r"^[0-9]{4}[-_]")
        | (has("revision_act", "_act_") & has("statute", "law", "revision"))
        | (has("honours", "awards") & has("birthday", "new_year", "queens", "kings"))
        | t.rlike(r"_in_[0-9]{4}$")
        | (t.contains("commemorative") & t.contains("coin"))
        | t.contains("(disambiguation)"),
        F.lit(False),
    )


def is_meta_page(title: Column) -> Column:
    """C15."""
    t = F.lower(title)
    return t.rlike("^(" + "|".join(META_PREFIXES) + ")") | t.contains("(disambiguation)")


def words(c: Column) -> Column:
    """Tokens between white space; an empty text has none."""
    s = strip(c)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, r"(?U)\s+"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared tokens over all tokens of two token lists; 0 if both are empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def title_match(title: Column, query: Column) -> Column:
    """How well a title fits a query, in [0, 1]."""
    t, q = F.lower(F.replace(title, F.lit("_"), F.lit(" "))), F.lower(query)
    tokens = jaccard(F.array_distinct(words(t)), F.array_distinct(words(q)))
    base = F.when(t.contains(q), F.least(F.lit(1.0), tokens * 1.5)).otherwise(tokens)
    halves = F.split(t, " in ")
    place = (F.size(halves) == 2) & F.element_at(halves, -1).rlike("|".join(PLACE_WORDS))
    score = base * F.when(place, 0.5).otherwise(1.0) * F.when(t.rlike("^[0-9]{4}"), 0.4).otherwise(1.0) * F.when(t.rlike("^(" + "|".join(LISTING_STARTS) + ")"), 0.3).otherwise(1.0)
    return F.when(F.coalesce(strip(t), F.lit("")) == "", 0.0).when(t == q, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def percent_decode(c: Column) -> Column:
    """'+' and malformed escapes stay, bytes that aren't UTF-8 become replacement characters."""
    safe = F.regexp_replace(F.replace(c, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(safe), c)


def parse_context(c: Column) -> Column:
    """entries of a comma-separated list, stripped, without empty ones, underscores as blanks."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.replace(strip(x), F.lit("_"), F.lit(" "))), lambda x: x != "")


def query_variations(c: Column) -> Column:
    """F15."""
    return F.array(c, F.lower(c), F.upper(c), F.replace(c, F.lit("_"), F.lit(" ")), F.replace(c, F.lit(" "), F.lit("_")))


def format_bytes(n: Column) -> Column:
    """F16: human-readable size, 1,024 to a step."""
    x = n.cast("double")
    out = F.format_string("%.2f PB", x / 1024.0**5)
    for p, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        out = F.when(x < 1024.0 ** (p + 1), F.format_string(f"%.2f {unit}", x / 1024.0**p)).otherwise(out)
    return out


def bar(share: Column, width: int = 20) -> Column:
    """F18."""
    return F.repeat(F.lit("█"), F.floor(share * width).cast("int"))


def thousands(n: Column) -> Column:
    """a whole number with commas between thousands."""
    return F.format_number(n, 0)


def json_set(c: Column) -> Column:
    """An aggregate: the distinct non-null values of a group as a sorted JSON list."""
    return F.to_json(F.array_sort(F.collect_set(c)))
