"""The driver's tables as the inputs of the operators: spots, features, counts, spikes, trees and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.session import tasks

#: Fixed value: lines that a task adds up to counts, about.
LINES = 2**20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spots: obs_id, block, section, x, y, z, label."""
    v = F.col("vec_id")
    return read(spark, sf_dir, "embeddings").select(
        v.alias("obs_id"),
        F.concat(F.lit("m"), (v % 3).cast("string")).alias("block"),
        F.expr("concat('m', cast(vec_id % 3 as string), '_s', cast((vec_id div 3) % 3 as string))").alias("section"),
        (F.col("embedding")[0].cast("double") * 1000).alias("x"),
        (F.col("embedding")[1].cast("double") * 1000).alias("y"),
        F.expr("cast((vec_id div 3) % 3 as double) * 20.0D").alias("z"),
        F.col("label").cast("bigint").alias("label"),
    )


OBS = """obs AS (SELECT vec_id AS obs_id, 'm' || vec_id % 3 AS block, 'm' || vec_id % 3 || '_s' || (vec_id // 3) % 3 AS section, embedding[1]::DOUBLE * 1000 AS x, embedding[2]::DOUBLE * 1000 AS y,
  ((vec_id // 3) % 3)::DOUBLE * 20 AS z, label::BIGINT AS label FROM embeddings)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs_id, gene_id, value: dimensions 8 to 63, dense."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("g", "v")).where("g >= 8")
    return e.select(F.col("vec_id").alias("obs_id"), F.col("g").cast("bigint").alias("gene_id"), F.col("v").cast("double").alias("value"))


FEATURES = """feat AS (SELECT vec_id AS obs_id, i AS gene_id, embedding[i + 1]::DOUBLE AS value FROM embeddings, range(8, 64) r(i))"""


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs_id, gene_id, count: sparse, integer-valued.

    Few lines share both keys, so sums before the shuffle would only hold a whole split in memory: lines go by cell into tasks of LINES, and what is then done by cell needs no other shuffle."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("obs_id"), F.col("l_partkey").alias("gene_id"), "l_quantity")
    return lines.repartition(tasks(spark, lines.count(), LINES), "obs_id").groupBy("obs_id", "gene_id").agg(F.sum("l_quantity").alias("count"))


COUNTS = "x AS (SELECT l_orderkey AS obs_id, l_partkey AS gene_id, sum(l_quantity) AS count FROM lineitem GROUP BY ALL)"


def obs_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs_id, grp, unit, replicate."""
    o, c, n = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    out = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return out.select(F.col("o_orderkey").alias("obs_id"), F.col("o_orderstatus").alias("grp"), F.col("n_nationkey").cast("bigint").alias("unit"), F.col("n_regionkey").cast("bigint").alias("replicate"))


META = """meta AS (SELECT o_orderkey AS obs_id, o_orderstatus AS grp, n_nationkey::BIGINT AS unit, n_regionkey::BIGINT AS replicate
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def var(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes: gene_id, symbol, panel, category, score."""
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("gene_id"), F.col("p_name").alias("symbol"), F.col("p_brand").alias("panel"), F.col("p_type").alias("category"),
        (F.col("p_retailprice") * (F.col("p_size") - 25)).alias("score"),
    )


VAR = "var AS (SELECT p_partkey AS gene_id, p_name AS symbol, p_brand AS panel, p_type AS category, p_retailprice * (p_size - 25) AS score FROM part)"


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit, t (seconds), event_id, kind."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("unit"), t.alias("t"), "event_id", F.col("event_type").alias("kind"))


SPIKES = "spikes AS (SELECT user_id AS unit, epoch_us(ts) / 1e6 AS t, event_id, event_type AS kind FROM events)"


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regional series: t (bucket of six hours), region, value."""
    s = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(21_600_000_000)).cast("bigint")
    return read(spark, sf_dir, "events").groupBy(s.alias("t"), (F.col("user_id") % 20).alias("region")).agg(F.avg("value").alias("value"))


SIGNAL = "ts AS (SELECT epoch_us(ts) // 21600000000 AS t, user_id % 20 AS region, avg(value) AS value FROM events GROUP BY ALL)"


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A neuron: id, type, x, y, z, parent."""
    p = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        F.lit(0).cast("bigint").alias("neuron"), (p + 1).alias("id"), F.when(p == 0, F.lit(1)).otherwise(2 + p % 3).cast("bigint").alias("type"), F.col("p_size").cast("double").alias("x"),
        F.col("p_retailprice").alias("y"), (p % 7).cast("double").alias("z"), F.expr("if(p_partkey = 0, -1L, (p_partkey - 1) div 2 + 1)").alias("parent"),
    )


TREE = """tree AS (SELECT 0::BIGINT AS neuron, p_partkey + 1 AS id, CASE WHEN p_partkey = 0 THEN 1 ELSE 2 + p_partkey % 3 END::BIGINT AS type, p_size::DOUBLE AS x, p_retailprice AS y, (p_partkey % 7)::DOUBLE AS z,
  CASE WHEN p_partkey = 0 THEN -1 ELSE (p_partkey - 1) // 2 + 1 END::BIGINT AS parent FROM part)"""
