"""One key for titles that look the same: compatibility form, case, blanks, invisible and look-alike characters."""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from inkwell.functions.text import SPECIAL_PREFIXES_DRAFT

# Letters of other scripts and the Latin letters they look like, as capitals and as small letters.
GREEK_CAPITALS = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX", strict=True))
GREEK_SMALL = dict(zip("αβεικνορυχγ", "abeikvopuxy", strict=True))
CYRILLIC_CAPITALS = dict(zip("АВЕЅІЈКМНОРСТУХҺԀԚԜӀҮѴ", "ABESIJKMHOPCTYXHDQWIYV", strict=True))
CYRILLIC_SMALL = dict(zip("авеѕіјкмнорстухһԁԛԝӏүѵ", "abesijkmhopctyxhdqwiyv", strict=True))
ARMENIAN_SMALL = dict(zip("օսոհցզյ", "ounhgqj", strict=True))
ARMENIAN_CAPITALS = dict(zip("ՕՍԼ", "OUL", strict=True))
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᎩᏃ", "ABCDEGHJKLMPRSTVWYZ", strict=True))
LATIN_FORMS = dict(zip("ɑɡı", "agi", strict=True))
HYPHENS = "\u2010\u2011\u2012\u2013\u2212\u2043\u02d7\ufe58"
# Unicode's default-ignorable code points, first and last of each range.
DEFAULT_IGNORABLE = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F),
    (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)

#: Small capitals look like the capitals they are named after: LATIN LETTER SMALL CAPITAL A.
SMALL_CAPITALS = {chr(c): m[1].lower() for c in range(0x250, 0xAB70) if (m := re.fullmatch("LATIN LETTER SMALL CAPITAL ([A-Z])", unicodedata.name(chr(c), "")))}
#: Small letters once case is gone; a Greek ζ, η, μ or τ looks like a Latin letter only as its capital does.
SMALL = {**{k.lower(): v.lower() for k, v in GREEK_CAPITALS.items()}, **GREEK_SMALL, **{k.lower(): v.lower() for k, v in {**CYRILLIC_CAPITALS, **ARMENIAN_CAPITALS}.items()}, **CYRILLIC_SMALL, **ARMENIAN_SMALL, **{k: v.lower() for k, v in CHEROKEE.items()}, **LATIN_FORMS, **SMALL_CAPITALS}
CAPITALS = {**GREEK_CAPITALS, **CYRILLIC_CAPITALS, **ARMENIAN_CAPITALS, **CHEROKEE}

_SMALL = str.maketrans(SMALL)
_CAPITALS = str.maketrans(CAPITALS)
_HYPHENS = str.maketrans(dict.fromkeys(HYPHENS, "-"))
_IGNORABLE = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in DEFAULT_IGNORABLE) + "]+")
_GREEK_OWN = re.compile("[ΓΔΘΛΞΠΣΦΨΩδθλξπσςφψω]")
_LATIN = re.compile("[A-Za-z]")
#: Words with the accents that stand apart from their letters.
_WORD = re.compile("(?:[^\\W_]|[\u0300-\u036f])+")
_ANY_CAPITAL = re.compile(f"[{''.join(CAPITALS)}]")
#: What keeps values apart while they are converted together.
_APART = "\x00"
_ROUND_APART = re.compile(rf"(?<!\s)\s*+{_APART}\s*+")
_BLANK = re.compile(r"\s")


def _word(m: re.Match) -> str:
    """Capitals that look Latin become so in a Latin word only: in a Greek one Ν must stay the capital of ν."""
    w = m[0]
    return w.translate(_CAPITALS) if _LATIN.search(w) and not _GREEK_OWN.search(w) else w


def look_keys(texts: list[str]) -> list[str]:
    """The consistent forms of texts: equal for two texts exactly if these look the same ignoring case.

    Compatibility forms, full case folding, blanks as underscores, nothing invisible, look-alike letters as Latin ones.
    Letters are compared without their accents, which are put back: Cyrillic ё looks like ë, й like nothing Latin.
    All texts are converted as one, so each step runs once for all of them.
    """
    if not texts:
        return []
    t = _IGNORABLE.sub("", unicodedata.normalize("NFKD", _APART.join(x.replace(_APART, "") for x in texts))).translate(_HYPHENS)
    t = _ROUND_APART.sub(_APART, t.strip())
    if _ANY_CAPITAL.search(t):
        t = _WORD.sub(_word, t)
    t = unicodedata.normalize("NFKD", t.casefold()).translate(_SMALL)
    return _BLANK.sub("_", unicodedata.normalize("NFC", t)).split(_APART)


def look_key(text: str) -> str:
    return look_keys([text])[0]


def link_target(raw: str) -> tuple[str | None, str | None]:
    """Contract C5 of a raw link target: cut text in its own case, and its normalised form; None where it is dropped."""
    t = raw.strip().split("#", 1)[0].strip()
    norm = t.replace(" ", "_").lower()
    return (None, None) if not norm or norm.startswith(SPECIAL_PREFIXES_DRAFT) else (t, norm)


def view_title(raw: str) -> tuple[str, str]:
    """Contract C10's key of a page-view title: percent-decoded text in its own case, and lower-cased."""
    t = unquote(raw)
    return t, t.lower().replace(" ", "_")


def stored_title(raw: str) -> tuple[str, str]:
    return raw, raw.replace(" ", "_")


KINDS = {"link": link_target, "view": view_title, "title": stored_title}
_OUT = StructType([StructField("norm", StringType()), StructField("key", StringType())])


def _forms(values: list[str], kind: str) -> list[tuple[str | None, str | None]]:
    """norm and key of values, in order; nulls for dropped link targets."""
    cut = [KINDS[kind](v) for v in values]
    keys = iter(look_keys([raw for raw, _ in cut if raw is not None]))
    return [(None, None) if raw is None else (norm, next(keys)) for raw, norm in cut]


def _udf(kind: str):  # noqa: ANN202
    @F.pandas_udf(_OUT)
    def forms(values: pd.Series) -> pd.DataFrame:
        # a batch converts each of its distinct values once
        codes, distinct = pd.factorize(values)
        return pd.DataFrame([*_forms(list(distinct), kind), (None, None)], columns=["norm", "key"]).iloc[codes].reset_index(drop=True)

    return forms


def plain(value: Column) -> Column:
    """Values of visible ASCII without escapes, whose forms need no Python."""
    return value.rlike(r"^[\x20-\x7e]*$") & ~value.contains("%")


def _plain_forms(v: Column, kind: str) -> tuple[Column, Column]:
    """norm and key of plain values."""
    if kind == "link":
        norm = F.translate(F.lower(F.trim(F.substring_index(F.trim(v), "#", 1))), " ", "_")
        kept = F.when(~((norm == "") | norm.rlike("^(" + "|".join(SPECIAL_PREFIXES_DRAFT) + ")")), norm)
        return kept, kept
    norm = F.translate(F.lower(v) if kind == "view" else v, " ", "_")
    return norm, F.translate(F.lower(F.trim(v)), " ", "_")


def distinct_keys(df: DataFrame, column: str, kind: str) -> DataFrame:
    """value, norm and key of every distinct non-null value; dropped link targets have nulls.

    Plain ASCII values are done in the JVM. Only the other ones go through Python, each distinct value once.
    kind: link (C5 and C6's twelve prefixes), view (C10's decoding) or title (as stored).
    """
    v = F.col("value")
    values = df.select(F.col(column).alias("value")).where(F.col(column).isNotNull()).distinct()
    norm, key = _plain_forms(v, kind)
    other = values.where(~plain(v)).withColumn("f", _udf(kind)(v)).select("value", "f.*")
    return values.where(plain(v)).select("value", norm.alias("norm"), key.alias("key")).unionByName(other)


def with_key(df: DataFrame, column: str, kind: str, into: str = "key") -> DataFrame:
    """df with the look key of a column, null for null values and dropped link targets.

    Every row gets its key where it is, plain values in the JVM and others in Arrow batches, which convert each of their
    distinct values once: nothing is shuffled, so a value of a third of all rows costs nothing more.
    """
    v = F.col(column)
    is_plain = F.coalesce(plain(v), F.lit(True))
    here = df.where(is_plain).withColumn(into, _plain_forms(v, kind)[1])
    return here.unionByName(df.where(~is_plain).withColumn(into, _udf(kind)(v)["key"]))
