"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition, `[\x20\x09-\x0D]`, and its complement.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a local session gets a temporary one; any other is refused, since executors see no folder of the driver's."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{tempfile.gettempdir()}/graphloom-checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/graphloom-{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder; a lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote, once nothing lazy reads them any more."""
    for t in tables:
        _remove(t.sparkSession, t._cut_path)


def clear_shared(spark: SparkSession) -> None:
    """Delete all tables that this application has cut; results that aren't written elsewhere go with them."""
    _remove(spark, f"{shared_dir(spark)}/graphloom-{spark.sparkContext.applicationId}")


def free_name(wanted: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, whatever its case: names of helper columns clash with nothing."""
    taken = {c.lower() for f in frames for c in f.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def join_hot(left: DataFrame, right: DataFrame, on: list[str], count: str, total: int, hot: int = 1_000) -> DataFrame:
    """left joined with right (one row a key; `count` is how many of the `total` rows of left have it). Keys of over 1 / hot of the rows, fewer than `hot` by arithmetic, are broadcast and so never dealt to one task; others meet by shuffle."""
    many = F.col(count) * hot > total
    near = left.join(F.broadcast(right.where(many)), on)
    far = left.join(F.broadcast(right.where(many).select(*on)), on, "left_anti").join(right.where(~many), on)
    return near.unionByName(far)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 2,000 rows from here on where the session has the default: 10,000 texts would be tens of MB for each task, in the JVM and in Python. The setting stays, as lazy results are run later."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "2000")


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def sized_partitions(spark: SparkSession, total: int, each: int, least: int) -> int:
    """Partitions of about `each` units; for small totals as many as the session shuffles to, if they have `least` units."""
    return max(1, -(-total // each), min(parallelism(spark), -(-total // least)))
