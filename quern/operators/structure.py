"""Graph rewrites: loops, directions, degrees, edge weights, neighbourhoods, splits, placement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.draws import uniform
from quern.graph import reverse_edges
from quern.session import cut

NORMS = ("symmetric", "right", "left", "none")
STRATEGIES = ("1d", "2d", "random", "canonical")
#: Hops after which a neighbourhood is written, so that its plan doesn't grow with k.
CUT_AFTER = 3


def with_unit_weight(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", F.lit(1.0).alias("weight"))


def undirected(edges: DataFrame) -> DataFrame:
    """Each pair in both directions, once."""
    return edges.select("src", "dst").union(reverse_edges(edges.select("src", "dst"))).distinct()


def self_loops(vertices: DataFrame) -> DataFrame:
    return vertices.select(F.col("id").alias("src"), F.col("id").alias("dst"))


def add_self_loops(edges: DataFrame, vertices: DataFrame, dedupe: bool = False) -> DataFrame:
    """One loop per vertex row, without a look at loops that exist; dedupe drops repeated pairs afterwards."""
    out = edges.select("src", "dst").unionByName(self_loops(vertices))
    return out.distinct() if dedupe else out


def out_degrees(edges: DataFrame) -> DataFrame:
    """Rows per src: multi-edges and loops count."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_deg"))


def in_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_deg"))


def degrees(vertices: DataFrame, edges: DataFrame, clamp: bool = True) -> DataFrame:
    """id, in_deg, out_deg of every vertex; at least 1 when clamped, as divisors have to be."""
    least = F.lit(1 if clamp else 0)
    joined = vertices.select("id").join(in_degrees(edges), "id", "left").join(out_degrees(edges), "id", "left")
    return joined.select("id", *[F.greatest(F.coalesce(c, F.lit(0)), least).alias(c) for c in ("in_deg", "out_deg")])


def labelled_degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, labelled_deg: sum of the labelled flag over in-neighbours."""
    flags = vertices.select(F.col("id").alias("src"), "labeled")
    return edges.join(flags, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("labeled").alias("labelled_deg"))


def _with_degree(edges: DataFrame, degree: DataFrame, key: str, other: str, salts: int) -> DataFrame:
    """Join a degree onto edges at one end. A hub's edges are dealt out by their other end, and its degree, one number, goes along.

    A plain equality would put a filter of nulls below the degree's edges, and edges that are distinct rows be made anew for each end.
    """
    salted = edges.withColumn("__salt", F.pmod(F.xxhash64(other), F.lit(salts)).cast("int"))
    value = [F.when(F.col(key).isNotNull(), F.col(c)).alias(c) for c in degree.columns if c != key]
    copies = degree.select(F.col(key).alias("__key"), *value, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__copy"))
    return salted.join(copies, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__salt") == F.col("__copy")), "left").drop("__salt", "__key", "__copy")


def normalise(edges: DataFrame, norm: str = "symmetric", degree_convention: str = "forward", salts: int = 8) -> DataFrame:
    """src, dst, weight.

    symmetric 1/sqrt(out(src) in(dst)), right 1/in(dst) (the mean over in-neighbours), left
    1/out(src), none 1. With the reverse convention in and out change places. Edge endpoints have a
    degree of one at least, so nothing needs clamping here.
    """
    if norm not in NORMS:
        raise ValueError(f"norm has to be one of {NORMS}")
    if degree_convention not in ("forward", "reverse"):
        raise ValueError("degree_convention has to be forward or reverse")
    if norm == "none":
        return with_unit_weight(edges)
    swap = degree_convention == "reverse"
    pairs = edges.select("src", "dst")
    of_src = (in_degrees(edges) if swap else out_degrees(edges)).toDF("src", "d_src")
    of_dst = (out_degrees(edges) if swap else in_degrees(edges)).toDF("dst", "d_dst")
    d_src = F.greatest(F.coalesce("d_src", F.lit(1)), F.lit(1)).cast("double")
    d_dst = F.greatest(F.coalesce("d_dst", F.lit(1)), F.lit(1)).cast("double")
    if norm in ("symmetric", "left"):
        pairs = _with_degree(pairs, of_src, "src", "dst", salts)
    if norm in ("symmetric", "right"):
        pairs = _with_degree(pairs, of_dst, "dst", "src", salts)
    weight = {"symmetric": lambda: 1.0 / (F.sqrt(d_src) * F.sqrt(d_dst)), "right": lambda: 1.0 / d_dst, "left": lambda: 1.0 / d_src}[norm]()
    return pairs.select("src", "dst", weight.alias("weight"))


def khop_in(edges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """id, hop: vertices from which a seed (id) is reached over at most k edges, with the least number."""
    pairs = edges.select("src", "dst").distinct()
    if k > CUT_AFTER:
        pairs = cut(pairs)
    reached = seeds.select("id").distinct().withColumn("hop", F.lit(0))
    frontier = reached
    for hop in range(1, k + 1):
        step = pairs.join(frontier.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id")).distinct()
        frontier = step.join(reached.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop))
        if hop % CUT_AFTER == 0 and hop < k:
            frontier, reached = cut(frontier), cut(reached)
        reached = reached.unionByName(frontier)
    return reached


def khop_subgraph(edges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """The edges that lead to seeds within k steps."""
    inside = khop_in(edges, seeds, k - 1).select(F.col("id").alias("dst")) if k else seeds.limit(0).select(F.col("id").alias("dst"))
    return edges.join(inside, "dst", "left_semi")


def split_masks(vertices: DataFrame, split: Column) -> DataFrame:
    """id and the masks of a split column 0, 1, 2; unsplit vertices have all_mask -1 and no mask set.

    labeled is the sum of the three masks.
    """
    masks = [F.when(split == i, 1).otherwise(0).alias(f"{name}_mask") for i, name in enumerate(("train", "valid", "test"))]
    chosen = vertices.select("id", F.coalesce(split, F.lit(-1)).cast("int").alias("all_mask"), *masks)
    return chosen.withColumn("labeled", (F.col("train_mask") + F.col("valid_mask") + F.col("test_mask")).cast("double"))


def hash_split(id_: Column, train: int = 9, of: int = 10) -> Column:
    """0 (train) or 2 (test) by bucket of the id: a random-looking split that reruns the same."""
    bucket = F.pmod(F.pmod(id_, F.lit(1_000_003)) * 7919, F.lit(of))
    return F.when(bucket < train, 0).otherwise(2)


def seeded_split(p: float, seed: int, id_: Column | None = None) -> Column:
    """0 with probability p, else 2, drawn by the id, so that reruns and other partitionings agree."""
    return F.when(uniform(seed, F.col("id") if id_ is None else id_) < p, 0).otherwise(2)


def _spread(x: Column, n: int) -> Column:
    """Placement of an id that can't overflow: reduce, then mix."""
    return F.pmod(F.pmod(x, F.lit(1_000_003)) * 7919, F.lit(n))


def partition_id(strategy: str, n: int, src: Column | None = None, dst: Column | None = None) -> Column:
    """Logical partition of an edge: by source, on a grid of both, by the pair, or by the pair in either direction."""
    src, dst = F.col("src") if src is None else src, F.col("dst") if dst is None else dst
    if strategy == "1d":
        return _spread(src, n)
    if strategy == "2d":
        side = max(1, int(n**0.5))
        return _spread(src, side) * side + _spread(dst, side)
    if strategy in ("random", "canonical"):
        a, b = (src, dst) if strategy == "random" else (F.least(src, dst), F.greatest(src, dst))
        return F.pmod(F.pmod(a, F.lit(1_000_003)) * 7919 + F.pmod(b, F.lit(1_000_003)) * 104_729, F.lit(n))
    raise ValueError(f"strategy has to be one of {STRATEGIES}")


def replication_factor(edges: DataFrame, pid: Column) -> DataFrame:
    """rf_all, rf_src, rf_dst: mean number of partitions that hold a vertex, in one pass over the edges."""
    placed = edges.select(pid.alias("pid"), "src", "dst")
    ends = placed.select("pid", F.col("src").alias("vid"), F.lit(1).alias("s"), F.lit(0).alias("d"))
    ends = ends.union(placed.select("pid", F.col("dst").alias("vid"), F.lit(0).alias("s"), F.lit(1).alias("d")))
    held = ends.groupBy("vid", "pid").agg(F.max("s").alias("s"), F.max("d").alias("d"))
    per = held.groupBy("vid").agg(F.count("*").alias("n"), F.sum("s").alias("ns"), F.sum("d").alias("nd"))
    some = lambda c: F.avg(F.when(F.col(c) > 0, F.col(c)))
    return per.agg(F.avg("n").alias("rf_all"), some("ns").alias("rf_src"), some("nd").alias("rf_dst"))


def place_edges(edges: DataFrame, n: int) -> DataFrame:
    """Physical co-location of edges by source."""
    return edges.repartition(n, "src")
