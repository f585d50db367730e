"""Ranking signals and numbers: contracts C11, C12 and C14 of the survey, scaling and formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The weights of the four signals, and the floor of each.
WEIGHTS = {"semantic": 0.50, "pagerank": 0.40, "pageviews": 0.05, "title": 0.05}
FLOOR = 1e-8


def normalize_pagerank(p: Column) -> Column:
    """C11: 0..100 to 0..1, raised at the low end; null and non-positive give 0."""
    return F.when(p > 0, F.pow(p / 100.0, F.lit(0.8))).otherwise(0.0)


def normalize_pageviews(v: Column) -> Column:
    """Log scale from 10 to 10 million, clamped; null and less than 1 give 0."""
    return F.when(v >= 1, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.log10(v.cast("double")) - 1.0) / 6.0))).otherwise(0.0)


def multisignal(semantic: Column, pagerank: Column, pageviews: Column, title: Column, weights: dict[str, float] | None = None, floor: float = FLOOR) -> Column:
    """C14: weighted geometric mean of normalised signals, none below the floor; null signals count as 0."""
    w = weights or WEIGHTS
    signals = {"semantic": semantic, "pagerank": pagerank, "pageviews": pageviews, "title": title}
    out = F.lit(1.0)
    for name, c in signals.items():
        out = out * F.pow(F.greatest(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(floor)), F.lit(w[name]))
    return out


def percent_score(x: Column) -> Column:
    """M4: 100 times a score, cut to a whole number."""
    return (x * F.lit(100.0)).cast("int")


def minmax100(x: Column, least: Column, most: Column) -> Column:
    """M5: scaled to 0..100 between two bounds; 0 where these are equal."""
    return F.when(most > least, (x - least) / (most - least) * 100.0).otherwise(0.0)


def percent(part: Column, total: Column) -> Column:
    """M9: percentage with 0 for an empty total."""
    return F.when(total > 0, part * 100.0 / total).otherwise(0.0)


def change(new: Column, old: Column, band: float = 0.001) -> Column:
    """Signed difference, 0 within the dead band."""
    d = new - old
    return F.when(F.abs(d) < band, 0.0).otherwise(d)


def change_kind(new: Column, old: Column, lower_is_better: bool = False, band: float = 0.001) -> Column:
    d = change(new, old, band)
    good = d < 0 if lower_is_better else d > 0
    return F.when(old.isNull() | new.isNull(), "none").when(d == 0, "same").when(good, "better").otherwise("worse")


def ratio(a: Column, b: Column) -> Column:
    """A / b, 0 where b isn't above 0; null if either is."""
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b > 0, a / b).otherwise(0.0)


def parse_int(c: Column) -> Column:
    """A whole number, null where the text isn't one."""
    return F.when(c.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(c).try_cast("bigint"))
