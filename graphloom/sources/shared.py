"""A folder that driver and executors share, for tables and files that live as long as a session's results."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset a local session gets a temporary folder; any other is refused, since executors see no folder of the driver's."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{tempfile.gettempdir()}/graphloom-checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/graphloom-{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once however often it is read, and safe from lost executors."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of a task's share of a table that is sorted or counted, by the estimated size (of files that is after compression).
TASK_BYTES = 16 << 20


def enough_partitions(df: DataFrame) -> int:
    """Shuffle partitions for df: the session's number, or more where a task's share would grow with the tables that df reads. Estimates of joins multiply, so twice these tables is the most that counts; tables of unknown size don't."""
    spark = df.sparkSession
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    size = min(int(plan.stats().sizeInBytes()), 2 * sum(x for x in sizes if x < 1 << 60))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / TASK_BYTES))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over enough_partitions(); left to the planner where the session's number is enough. For what groups, joins or windows by these keys next."""
    n = enough_partitions(df)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
