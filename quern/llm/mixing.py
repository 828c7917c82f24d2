"""Mixing sources to target weights, in DataFrame operations only.

Sizes are added up per source; a water level over the sources gives every source a target; target
over size is the repetition rate. A document is taken floor(rate) times, plus once more if a draw
seeded by its id falls under the fraction. Draws depend on doc_id and seed alone, so reruns agree.

Edge cases: null text has size 0; a null source is a source of its own and comes last; a source
without words has target 0 and rate 0; rows that repeat a doc_id share their draw; a null doc_id
draws as the string 'null'; an empty table gives an empty result. Extra columns pass through,
whatever their names.

Targets, one row for each source, are broadcast up to MOST_SOURCES rows; with more sources the rows
are joined to them by source, those of a source that holds many dealt to many places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import Workspace, spread_join, table, word_count

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CEILING = 2.0
SEED = 17
MOST_SOURCES = 10_000


def draw(id_column: str, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of md5."""
    key = F.concat(F.lit(f"mix:{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, ceiling=CEILING) -> DataFrame:
    """source, source_size, target. One row per source; sizes has source and size.

    Targets are min(ceiling * size, level * weight) at the level where they add up to share times
    all sizes, which is where resharing the excess by weight ends. In the order of ceiling by
    weight, the level is read off at the first source that it leaves unsaturated. The windows hold
    one pre-aggregated row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), rank % len(weights))
    cap = F.col("source_size") * F.lit(float(ceiling))
    ranked = totals.withColumn("weight", weight).withColumn("cap", cap)
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    below = F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - below) / weight_left
    levelled = ranked.withColumn("level", level)
    unsaturated = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    found = levelled.withColumn("level", F.max(unsaturated).over(everything))
    wanted = F.least("cap", F.col("level") * F.col("weight"))
    return found.select("source", "source_size", F.coalesce(wanted, F.col("cap")).alias("target"), "n")


def copies_per_document(sizes: DataFrame, targets: DataFrame, seed: int = SEED, id_column: str = "doc_id") -> DataFrame:
    """sizes with source_size, target and n_copies. targets is a written table."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))
    named, goal = sizes.withColumn("__source", key), targets.withColumn("__source", key).drop("source")
    if targets.count() <= MOST_SOURCES:
        joined = named.join(F.broadcast(goal.drop("n")), "__source", "left").drop("__source")
    else:
        joined = spread_join(named, goal, ["__source"], [id_column], "left").drop("__source")
    whole = F.floor(rate)
    return joined.withColumn("n_copies", whole + F.when(draw(id_column, seed) < rate - whole, 1).otherwise(0))


def mix_report(docs: DataFrame, workspace: Workspace, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    sizes = workspace.materialise(docs.select("doc_id", "source", word_count().alias("size")), "sizes")
    targets = workspace.materialise(source_targets(sizes), "targets")
    counted = copies_per_document(sizes, targets, seed)
    return counted.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))


def mix_documents(docs: DataFrame, workspace: Workspace, seed: int = SEED) -> DataFrame:
    """docs with each row as often as the mix takes it; the columns of docs, in their order."""
    sizes = workspace.materialise(docs.select("doc_id", "source", word_count().alias("size")), "sizes")
    targets = workspace.materialise(source_targets(sizes), "targets")
    row = docs.select("doc_id", "source", F.struct(*[docs[c] for c in docs.columns]).alias("__row"))
    counted = copies_per_document(row, targets, seed)
    repeated = counted.where("n_copies > 0").select("__row", F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int"))).alias("__copy"))
    return repeated.select("__row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"), Workspace(spark, "mixing"))


ORACLE_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), ranked AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS cap,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight
  FROM totals
), levelled AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked
), found AS (
  SELECT source, source_size, cap, weight,
         max(CASE WHEN level * weight <= cap THEN level END) OVER () AS level
  FROM levelled
), targets AS (
  SELECT source, source_size, coalesce(least(cap, level * weight), cap) AS target FROM found
), rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5('mix:17:' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""
