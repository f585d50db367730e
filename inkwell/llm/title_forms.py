"""Titles in one consistent form, so that links and views meet their article (problem 3).

Compatibility normalisation in composed form, full case folding, mapped white space, removal of default-ignorable
characters and look-alike letters as Latin ones. Distinct values are converted together, a whole Arrow batch in each
step; values of plain ASCII stay in the JVM. Which titles look the same is known to the core, too, which needs it for
orphan references: the form is the core's look key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions.lookalike import distinct_keys, with_key


def distinct_forms(df: DataFrame, column: str, kind: str = "title") -> DataFrame:
    """value, norm, form of every distinct non-null value: as the reference normalises it, and in the consistent form.

    Null in both for link targets that the reference drops. An empty text has an empty form.
    """
    return distinct_keys(df, column, kind).withColumnRenamed("key", "form")


def consistent_form(df: DataFrame, column: str, kind: str = "title", into: str = "form") -> DataFrame:
    """df with one more column: the consistent form of `column`; null texts and dropped link targets have null.

    A column that is named `into` already gives way; others may have any names. An empty text has an empty form, a text
    of any length comes whole, repeated rows stay. Rows get their form where they are, each Arrow batch converting its
    distinct values together; nothing is shuffled, so a value of a third of all rows does no harm.
    """
    kept = [c for c in df.columns if c != into or c == column]
    return with_key(df.select(*kept), column, kind, into)


def article_index(articles: DataFrame) -> DataFrame:
    """form, article_id, title: the smallest article_id of all rows with a lookup_title of that form, and its title."""
    forms = distinct_forms(articles, "lookup_title").select(F.col("value").alias("lookup_title"), "norm", "form")
    rows = articles.where("article_id IS NOT NULL").groupBy("lookup_title").agg(F.min("article_id").alias("article_id"))
    return rows.join(forms, "lookup_title").groupBy("form").agg(F.min(F.struct("article_id", F.col("norm").alias("title"))).alias("m")).select("form", "m.*")


def disguised_titles(df: DataFrame, column: str, kind: str, index: DataFrame) -> DataFrame:
    """value, article_id of every distinct value whose form is that of an article but that differs in a character."""
    forms = distinct_forms(df, column, kind).where(F.col("form").isNotNull())
    return forms.join(index, "form").where(F.col("norm") != F.col("title")).select("value", "article_id")
