"""Session helpers: tables, lineage cuts and partition counts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Most rows that a side of a join may have to be broadcast; beyond it the joins of this library shuffle.
BROADCAST_ROWS = 200_000


def local_session(cpus: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the submitter's session is used as it is."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("inkwell")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir, or one of our own where a local session names none (tests).

    A cluster must name one: what an executor writes to its own disk no other can read, so RuntimeError is raised.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not base:
        base = _OWN.setdefault(spark.sparkContext.applicationId, "")
        if not base:
            base = _OWN[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="inkwell-")
    return base.rstrip("/")


_OWN: dict[str, str] = {}


def cut(df: DataFrame, name: str = "cut", partition_by: list[str] | None = None) -> DataFrame:
    """Write df as a table into the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._inkwell_path = path
    return out


def drop_cut(df: DataFrame | None) -> None:
    """Remove a table written by cut() that no later step reads."""
    path = getattr(df, "_inkwell_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
