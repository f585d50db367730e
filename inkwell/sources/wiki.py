"""Readers and writers of dumps: XML pages, SQL tuples, page-view lines."""

from __future__ import annotations

import calendar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from inkwell.functions.text import percent_decode, strip

PAGE = StructType([
    StructField("title", StringType()), StructField("ns", IntegerType()), StructField("id", LongType()),
    StructField("redirect", StructType([StructField("_title", StringType())])),
    StructField("revision", StructType([
        StructField("id", LongType()), StructField("timestamp", StringType()),
        StructField("text", StructType([StructField("_VALUE", StringType()), StructField("_bytes", LongType())])),
    ])),
])
VIEW_PROJECTS = ["en.wikipedia", "en"]


def resolve_files(paths: list[str], done: set[str] | None = None) -> list[str]:
    """Sorted paths, the decompressed twin rather than its compressed one, without those done.

    Raises FileNotFoundError if there are none at all.
    """
    names = set(paths)
    if not names:
        raise FileNotFoundError("no input files")
    kept = {p for p in names if not (p.endswith((".bz2", ".gz")) and p.rsplit(".", 1)[0] in names)}
    return sorted(kept - (done or set()))


def read_pages(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Pages of an XML dump, plain or compressed; broken pages come with nulls and are rejected later."""
    return spark.read.format("xml").schema(PAGE).option("rowTag", "page").option("mode", "PERMISSIVE").load(path)


def write_pages(pages: DataFrame, path: str, pages_per_file: int = 10_000) -> None:
    """XML files of at most so many pages."""
    pages.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").option("maxRecordsPerFile", pages_per_file).mode("overwrite").save(path)


def read_link_tuples(spark: SparkSession, path: str | list[str], table: str = "pagelinks") -> DataFrame:
    """(pl_from, pl_from_namespace, pl_target_id) of the INSERT lines of a SQL dump; other lines are ignored."""
    lines = spark.read.text(path).where(F.col("value").startswith(f"INSERT INTO `{table}` VALUES"))
    found = lines.select(F.explode(F.regexp_extract_all("value", F.lit(r"(\((?:\d+,){2}\d+\))"), F.lit(1))).alias("t"))
    parts = F.split(F.regexp_replace("t", r"[()]", ""), ",")
    return found.select(*[parts[i].cast("bigint").alias(c) for i, c in enumerate(("pl_from", "pl_from_namespace", "pl_target_id"))])


def probe_dump(spark: SparkSession, path: str, table: str = "pagelinks") -> DataFrame:
    """INSERT lines of a dump, tuples in the first one met, and their product as an estimate."""
    lines = spark.read.text(path).where(F.col("value").startswith(f"INSERT INTO `{table}` VALUES"))
    row = lines.select((F.size(F.split("value", r"\),\("))).alias("n")).agg(F.count(F.lit(1)).alias("lines"), F.coalesce(F.first("n"), F.lit(0)).alias("first_tuples"))
    return row.withColumn("estimate", F.col("lines") * F.col("first_tuples"))


def view_lines(lines: DataFrame, projects: list[str] = VIEW_PROJECTS) -> DataFrame:
    """lookup_title, views of the page-view lines (column value) that count."""
    f = F.split(strip(F.col("value")), r"(?U)\s+")
    rows = lines.where(F.size(f) >= 5).select(f[0].alias("project"), f[1].alias("title"), F.try_to_number(f[4], F.lit("999999999999999999")).cast("bigint").alias("views"))
    return count_views(rows, "views", projects)


def count_views(rows: DataFrame, views: str, projects: list[str] = VIEW_PROJECTS) -> DataFrame:
    kept = rows.where(F.col("project").isin(projects) & (F.col(views) > 0) & (F.col("title") != "-") & ~F.col("title").contains(":"))
    return kept.select(F.lower(percent_decode(F.col("title"))).alias("lookup_title"), F.col(views).alias("views"))


def read_views(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Views by lookup_title over all files, plain or compressed."""
    return view_lines(spark.read.text(paths)).groupBy("lookup_title").agg(F.sum("views").alias("pageviews"))


def day_files(year: int, month: int, pattern: str = "pageviews-{day}-user.bz2") -> list[str]:
    """Names of a month's daily files."""
    return [pattern.format(day=f"{year:04d}{month:02d}{d:02d}") for d in range(1, calendar.monthrange(year, month)[1] + 1)]


def padded_name(prefix: str, n: int | Column, width: int) -> str | Column:
    """F19."""
    return f"{prefix}{n:0{width}d}" if isinstance(n, int) else F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0"))


def next_version(current: str | None) -> str:
    """v0.0.1 at first, else the patch number plus one; ValueError if it is malformed."""
    if current is None:
        return "v0.0.1"
    parts = current.removeprefix("v").split(".")
    if len(parts) != 3 or not all(p.isdigit() for p in parts):
        raise ValueError(f"malformed version: {current}")
    return f"v{parts[0]}.{parts[1]}.{int(parts[2]) + 1}"


def replace_table(df: DataFrame, path: str) -> None:
    """K8: drop the table at a path, if there is one, and write it anew."""
    df.write.mode("overwrite").parquet(path)


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def snapshot_names(spark: SparkSession, folder: str, prefix: str = "checkpoint_") -> list[str]:
    """Names of the snapshots in a folder of any file system that Spark knows, in order; none if it isn't there."""
    fs, p = _file_system(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith(prefix)) if fs.exists(p) else []


def newest_snapshot(folder: str, prefix: str = "checkpoint_") -> str | None:
    """The last snapshot by name."""
    names = snapshot_names(SparkSession.getActiveSession(), folder, prefix)
    return f"{folder.rstrip('/')}/{names[-1]}" if names else None


def snapshot_number(path: str) -> int:
    """How far a snapshot got, by its name, where no statistics were written beside it."""
    return int(path.rstrip("/").rsplit("_", 1)[1])


def save_snapshot(df: DataFrame, folder: str, n: int, keep: int = 3) -> str:
    """A Parquet snapshot, of which the last `keep` stay (a folder all executors share)."""
    spark = df.sparkSession
    path = f"{folder.rstrip('/')}/checkpoint_{n:09d}"
    df.write.mode("overwrite").parquet(path)
    for old in snapshot_names(spark, folder)[:-keep]:
        fs, p = _file_system(spark, f"{folder.rstrip('/')}/{old}")
        fs.delete(p, True)
    return path
