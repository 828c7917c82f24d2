"""The fixture graph that the registered queries run on, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.graph import PropertyGraph
from quern.operators.structure import add_self_loops, normalise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("feat"), "label")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pairs of order and part keys of all line items, folded onto the vertex ids."""
    n = table(spark, sf_dir, "embeddings").count()
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % n).alias("src"), (F.col("l_partkey") % n).alias("dst")).distinct()


def graph(spark: SparkSession, sf_dir: str, norm: str = "symmetric", convention: str = "forward") -> PropertyGraph:
    """With a loop at every vertex."""
    v = vertices(spark, sf_dir)
    return PropertyGraph(v, normalise(add_self_loops(edges(spark, sf_dir), v), norm, convention))


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bipartite multigraph: an edge from supplier to part for every line item."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000).alias("dst"))


def split_number() -> Column:
    bucket = F.col("id") % 10
    return F.when(bucket < 8, 0).when(bucket == 8, 1).otherwise(2)


V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS feat, label FROM embeddings)"
E0 = "e0 AS (SELECT DISTINCT l_orderkey % n AS src, l_partkey % n AS dst FROM lineitem, (SELECT count(*) AS n FROM embeddings))"
E = "e AS (SELECT src, dst FROM e0 UNION ALL SELECT id, id FROM v)"
DEG = "od AS (SELECT src AS id, count(*) AS d FROM e GROUP BY 1), ind AS (SELECT dst AS id, count(*) AS d FROM e GROUP BY 1)"
WEIGHTS = {
    "symmetric": "1.0::DOUBLE / (sqrt(od.d::DOUBLE) * sqrt(ind.d::DOUBLE))",
    "right": "1.0::DOUBLE / ind.d::DOUBLE",
    "left": "1.0::DOUBLE / od.d::DOUBLE",
    "none": "1.0::DOUBLE",
}
X = "x AS (SELECT id, unnest(range(0, len(feat)))::INT AS pos, unnest(feat) AS val FROM v)"


def weighted(norm: str = "symmetric", reverse: bool = False) -> str:
    """CTEs v, e0, e, od, ind, w (src, dst, weight) and x (id, pos, val)."""
    a, b = ("e.dst", "e.src") if reverse else ("e.src", "e.dst")
    w = f"w AS (SELECT e.src, e.dst, {WEIGHTS[norm]} AS weight FROM e JOIN od ON od.id = {a} JOIN ind ON ind.id = {b})"
    return f"WITH {V}, {E0}, {E}, {DEG}, {w}, {X}"
