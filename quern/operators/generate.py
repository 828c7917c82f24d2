"""Synthetic graphs. Random ones draw by hash of seed and position, so they are the same for any partitioning."""

from __future__ import annotations

from math import ceil, erf, log, log2, sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.draws import gaussian, uniform
from quern.graph import PropertyGraph
from quern.operators.structure import add_self_loops, normalise
from quern.session import cut

#: Chances of the four quadrants of the R-MAT recursion; the usual values.
RMAT = (0.45, 0.15, 0.15, 0.25)


def tries_needed(mu: float, sigma: float, below: int, miss: float = 1e-12) -> int:
    """How many draws leave none under the bound with a chance of miss at most."""
    accepted = 0.5 * (1 + erf((log(max(below, 1)) - mu) / (sigma * sqrt(2))))
    if accepted <= 0:
        raise ValueError("no draw falls under the bound")
    return 1 if accepted >= 1 else max(1, ceil(log(miss) / log(1 - accepted)))


def lognormal_degree(seed: int, id_: Column, mu: float, sigma: float, below: int) -> Column:
    """Floor of a log-normal draw, drawn again while it isn't under the bound; as many draws as leave one vertex in 10^12 without (which gets none: degree 0)."""
    draws = F.transform(F.sequence(F.lit(0), F.lit(tries_needed(mu, sigma, below) - 1)), lambda k: F.floor(F.exp(mu + sigma * gaussian(seed, id_, k))))
    return F.coalesce(F.get(F.filter(draws, lambda d: d < below), F.lit(0)), F.lit(0))


def lognormal_graph(spark: SparkSession, n: int, mu: float = 4.0, sigma: float = 1.3, seed: int = 1) -> DataFrame:
    """src, dst: log-normal out-degrees, targets uniform."""
    v = spark.range(n).select(F.col("id").alias("src"), lognormal_degree(seed, F.col("id"), mu, sigma, n).alias("deg"))
    rows = v.where("deg > 0").select("src", F.explode(F.sequence(F.lit(1), F.col("deg").cast("int"))).alias("k"))
    return rows.select("src", F.floor(uniform(seed + 1, F.col("src"), F.col("k")) * n).alias("dst"))


def random_graph(spark: SparkSession, n: int, seed: int = 1, width: int = 100, mu: float = 4.0, sigma: float = 1.3, norm: str = "none") -> PropertyGraph:
    """Log-normal graph with a loop at each vertex and features of ones."""
    vertices = spark.range(n).select("id", F.array_repeat(F.lit(1.0), width).alias("feat"))
    return PropertyGraph(vertices, normalise(add_self_loops(lognormal_graph(spark, n, mu, sigma, seed), vertices), norm))


def _lowest(rows: DataFrame, n: int, upper: int, fan: int = 4096) -> DataFrame:
    """The n rows with the lowest of distinct ids below upper: the cut is found by counting in ever smaller ranges, fan counts a round."""
    low, width, left = 0, upper, n
    while width > 1:
        step = -(-width // fan)
        inside = rows.where((F.col("id") >= low) & (F.col("id") < low + width))
        counts = inside.groupBy(F.expr(f"(id - {low}) div {step}").alias("k")).agg(F.count("*").alias("n")).orderBy("k").collect()
        for row in counts:
            if row["n"] >= left:
                low, width = low + row["k"] * step, step
                break
            left -= row["n"]
    return rows.where(F.col("id") <= low)


def rmat_graph(spark: SparkSession, n: int, n_edges: int, seed: int = 1, chances: tuple[float, ...] = RMAT) -> DataFrame:
    """src, dst: n_edges distinct edges over 2^ceil(log2 n) vertices by recursive quadrants.

    Draws are numbered and repeated pairs dropped keeping the lowest number; rounds of draws go on
    until there are enough, then the lowest n_edges stay. The pairs are written once.
    """
    levels = max(1, ceil(log2(n)))
    if n_edges > 1 << (2 * (levels - 1)):
        raise ValueError("more edges than the recursion can tell apart")
    a, b, c, _ = chances
    drawn = n_edges * 2
    while True:
        quadrant = F.transform(
            F.transform(F.sequence(F.lit(1), F.lit(levels)), lambda i: uniform(seed, F.col("id"), i)),
            lambda u: F.when(u < a, 0).when(u < a + b, 1).when(u < a + b + c, 2).otherwise(3),
        )
        bits = spark.range(drawn).select("id", quadrant.alias("q"))
        fold = lambda take: F.aggregate("q", F.lit(0).cast("long"), lambda s, q: s * 2 + take(q))
        src, dst = fold(lambda q: F.floor(q / 2).cast("long")), fold(lambda q: F.pmod(q, F.lit(2)).cast("long"))
        pairs = cut(bits.select("id", src.alias("src"), dst.alias("dst")).groupBy("src", "dst").agg(F.min("id").alias("id")))
        if pairs.count() >= n_edges:
            return _lowest(pairs, n_edges, drawn).select("src", "dst")
        drawn *= 2


def grid_graph(spark: SparkSession, rows: int, cols: int) -> PropertyGraph:
    """Ids in row order, edges to the next row and the next column, weight 1, vertex columns row and col."""
    at = spark.range(rows * cols).select("id", F.expr(f"id div {cols}").alias("row"), F.pmod("id", F.lit(cols)).alias("col"))
    down = at.where(F.col("row") < rows - 1).select(F.col("id").alias("src"), (F.col("id") + cols).alias("dst"))
    right = at.where(F.col("col") < cols - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    return PropertyGraph(at, down.union(right).withColumn("weight", F.lit(1.0)))


def star_graph(spark: SparkSession, n: int) -> PropertyGraph:
    """Edges i to 0 for 1 <= i < n; every vertex has attr 1."""
    vertices = spark.range(n).select("id", F.lit(1).alias("attr"))
    return PropertyGraph(vertices, spark.range(1, n).select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"), F.lit(1.0).alias("weight")))
