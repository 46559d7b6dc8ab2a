"""A graph derived from relational tables: customers and suppliers in nations, nations in regions, parts of types and brands, suppliers that provide parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.shared import dealt


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commerce_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """head, relation, tail, score. Nation and region are small dimension tables; of lineitem only two keys are shuffled, to the names of parts, and counts of suppliers and names after that: nearly each (supplier, part) is another, names are few."""
    t = lambda n: load(spark, sf_dir, n)
    nation = t("nation").select("n_nationkey", "n_name", "n_regionkey")
    row = lambda df, h, r, x, s: df.select(F.col(h).alias("head"), F.lit(r).alias("relation"), F.col(x).alias("tail"), s.cast("double").alias("score"))
    lines = dealt(t("lineitem").select("l_suppkey", "l_partkey").where("l_suppkey is not null and l_partkey is not null"), "l_partkey")
    counted = lines.join(t("part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey", "p_name").agg(F.count("*").alias("n"))
    named = counted.join(t("supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_name", "p_name").agg(F.sum("n").alias("n"))
    parts = [
        row(t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")), "c_name", "located_at", "n_name", F.lit(0.9)),
        row(t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")), "s_name", "located_at", "n_name", F.lit(0.8)),
        row(nation.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")), "n_name", "part_of", "r_name", F.lit(1.0)),
        row(t("part").select("p_name", "p_type").distinct(), "p_name", "instance_of", "p_type", F.lit(0.7)),
        row(t("part").select("p_name", "p_brand").distinct(), "p_name", "made_of", "p_brand", F.lit(0.6)),
        row(named, "s_name", "provides", "p_name", F.least(F.lit(1.0), F.lit(0.25) * F.col("n"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


EDGES_SQL = """edges AS (
SELECT c_name AS head, 'located_at' AS relation, n_name AS tail, 0.9::DOUBLE AS score FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT s_name, 'located_at', n_name, 0.8::DOUBLE FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT n_name, 'part_of', r_name, 1.0::DOUBLE FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT DISTINCT p_name, 'instance_of', p_type, 0.7::DOUBLE FROM part
UNION ALL SELECT DISTINCT p_name, 'made_of', p_brand, 0.6::DOUBLE FROM part
UNION ALL SELECT s_name, 'provides', p_name, least(1.0::DOUBLE, 0.25::DOUBLE * count(*)) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY s_name, p_name)"""
