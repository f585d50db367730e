"""Article tables: admission, features, keyed updates and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators.skew import hot_keys, salted_join

#: Shortest clean text that is an article, and characters of it that are stored.
LEAST_CHARS, STORED_CHARS = 100, 20_000


def skip_reason(title: Column, page_id: Column, redirect: Column, text: Column, ns: Column, clean: Column) -> Column:
    """Why C2 rejects a page, the first reason of its order; null for admitted ones."""
    return (
        F.when(F.coalesce(T.strip(title), F.lit("")) == "", "no_title")
        .when(page_id.isNull(), "no_id")
        .when(redirect.isNotNull(), "redirect")
        .when(F.coalesce(text, F.lit("")) == "", "no_text")
        .when(F.coalesce(ns, F.lit(0)) != 0, "namespace")
        .when(title.startswith("List of ") | title.startswith("List_of_"), "list")
        .when(F.lower(title).contains("(disambiguation)"), "disambiguation")
        .when(F.length(clean) < LEAST_CHARS, "short")
    )


def admit(pages: DataFrame, strict: bool = False) -> DataFrame:
    """Pages of the XML source to articles; cheap rejections come before the text is cleaned.

    Columns: article_id, title (underscores), namespace, char_count, stored_chars, text, lookup_title, model_text.
    """
    raw = pages.select("title", F.coalesce("ns", F.lit(0)).alias("namespace"), F.col("id").alias("article_id"), "redirect", F.col("revision.text._VALUE").alias("raw"))
    none = F.lit("x" * LEAST_CHARS)
    cheap = raw.where(skip_reason(F.col("title"), F.col("article_id"), F.col("redirect"), F.col("raw"), F.col("namespace"), none).isNull())
    kept = cheap.withColumn("clean", T.clean_wikitext(F.col("raw"), strict)).where(F.length("clean") >= LEAST_CHARS)
    title = F.replace(T.strip(F.col("title")), F.lit(" "), F.lit("_"))
    out = kept.select("article_id", title.alias("title"), "namespace", F.length("clean").alias("char_count"), F.substring("clean", 1, STORED_CHARS).alias("text"))
    stored = out.withColumn("stored_chars", F.length("text")).withColumn("lookup_title", F.lower("title"))
    return stored.withColumn("model_text", F.concat(F.replace("title", F.lit("_"), F.lit(" ")), F.lit(". "), F.substring("text", 1, 2000)))


def skip_counts(pages: DataFrame) -> DataFrame:
    """Pages by reason of rejection, admitted ones under 'admitted'."""
    text = F.col("revision.text._VALUE")
    reason = skip_reason(F.col("title"), F.col("id"), F.col("redirect"), text, F.col("ns"), T.clean_wikitext(text))
    return pages.groupBy(F.coalesce(reason, F.lit("admitted")).alias("reason")).agg(F.count(F.lit(1)).alias("pages"))


def features(pages: DataFrame) -> DataFrame:
    """Link count, title words, length and revision time of pages passing C3 (ns 0, no redirect, text)."""
    raw = F.col("revision.text._VALUE")
    title = F.replace(T.strip(F.col("title")), F.lit(" "), F.lit("_"))
    rows = pages.where((F.coalesce("ns", F.lit(0)) == 0) & F.col("redirect").isNull() & (F.coalesce(raw, F.lit("")) != "")).where(~T.should_skip_article(title))
    return rows.select(
        F.col("id").alias("article_id"),
        F.length(T.clean_wikitext(raw)).alias("char_count"),
        F.size(T.wikilinks(raw)).alias("wikilink_count"),
        F.col("revision.timestamp").alias("last_revision_timestamp"),
        F.size(T.words(F.replace(title, F.lit("_"), F.lit(" ")))).alias("title_word_count"),
    )


def add_column(df: DataFrame, name: str, kind: str, default: object = None) -> DataFrame:
    """K6: a column with a default, unless it is there."""
    return df if name in df.columns else df.withColumn(name, F.lit(default).cast(kind))


def available(df: DataFrame, names: list[str]) -> DataFrame:
    """Those of the named columns that df has."""
    return df.select(*[n for n in names if n in df.columns])


def one_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """K1 and K3: the first row of each key in an order (the latest, with a descending one). The window sees a key's rows
    only, and Spark prunes them to the first before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def add_counts(old: DataFrame, new: DataFrame, key: str, count: str) -> DataFrame:
    """K2: counts of both tables, summed by key."""
    return old.select(key, count).unionByName(new.select(key, count)).groupBy(key).agg(F.sum(count).alias(count))


def update_by_key(df: DataFrame, updates: DataFrame, key: str, columns: dict[str, object], reset: bool = True) -> DataFrame:
    """Columns of the row of `updates` with the same key, on every row having that key.

    reset: rows without an update get the default given for the column, else they keep their value. updates has one row
    a key; null keys match nothing. Columns that df lacks are added. Rows of a hot or null key are spread over tasks.
    """
    for c, default in columns.items():
        if c not in df.columns:
            df = df.withColumn(c, F.lit(default).cast(dict(updates.dtypes)[c]))
    new = updates.select(F.col(key).alias("__key"), F.lit(True).alias("__hit"), *[F.col(c).alias(f"__new_{c}") for c in columns])
    joined = salted_join(df.withColumn("__key", F.col(key)), new, ["__key"], hot_keys(df, [key]).withColumnRenamed(key, "__key"))
    for c, default in columns.items():
        other = F.lit(default) if reset else F.col(c)
        joined = joined.withColumn(c, F.coalesce(F.when(F.col("__hit"), F.col(f"__new_{c}")), other))
    return joined.drop("__key", "__hit", *[f"__new_{c}" for c in columns])


def unprocessed(batch: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done yet; null keys stay."""
    return batch.join(done.select(key).distinct(), key, "left_anti")


def first_match(df: DataFrame, query: str, strategies: list[Column], order: str) -> DataFrame:
    """The row found by the first strategy that finds any, in one pass; among its rows the least `order`."""
    rank = F.coalesce(*[F.when(s, i) for i, s in enumerate(strategies)])
    return df.withColumn("__rank", rank).where("__rank IS NOT NULL").orderBy("__rank", order).limit(1).drop("__rank")


def backlinks_from_text(pages: DataFrame, draft: bool = False) -> DataFrame:
    """A2, C7-X: how often each normalised target is linked from main articles; repeated links count."""
    raw = F.col("revision.text._VALUE")
    main = pages.where((F.coalesce("ns", F.lit(0)) == 0) & F.col("redirect").isNull())
    targets = main.select(F.explode(T.wikilinks(raw)).alias("target"))
    return targets.select(T.normalize_title(F.col("target")).alias("lookup_title")).where(~T.is_special_page(F.col("lookup_title"), draft)).groupBy("lookup_title").agg(F.count(F.lit(1)).alias("backlinks"))


def backlinks_from_tuples(tuples: DataFrame) -> DataFrame:
    """A3, C7-S: links from namespace 0 by target id."""
    return tuples.where("pl_from_namespace = 0").groupBy(F.col("pl_target_id").alias("article_id")).agg(F.count(F.lit(1)).alias("backlinks"))


def missing_columns(df: DataFrame, names: list[str]) -> list[str]:
    """Required columns that df lacks."""
    return [n for n in names if n not in df.columns]
