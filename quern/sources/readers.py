"""Readers for graph inputs. Schemas are stated, never inferred."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.draws import gaussian, uniform
from quern.functions.vectors import to_sparse
from quern.graph import META_SCHEMA, PropertyGraph, reverse_edges
from quern.operators.structure import add_self_loops, normalise, undirected


@dataclass(frozen=True)
class DatasetSpec:
    name: str
    n_features: int
    n_classes: int
    multilabel: bool = False


# Ids, widths and class counts of the known datasets.
DATASETS = {
    0: DatasetSpec("log-normal", 100, 2),
    1: DatasetSpec("products", 100, 47),
    2: DatasetSpec("arxiv", 128, 40),
    3: DatasetSpec("papers100M", 128, 172),
    4: DatasetSpec("yelp", 300, 100, True),
    5: DatasetSpec("reddit", 602, 41),
    6: DatasetSpec("amazon", 300, 22),
}


def read_features(spark: SparkSession, path: str, labelled: bool = False, partitions: int | None = None) -> DataFrame:
    """id, feat (and labeled if the second field is that flag) from lines id,[labeled,]x0,x1,..."""
    parts = spark.read.text(path).select(F.split("value", ",").alias("p"))
    skip = 2 if labelled else 1
    feat = F.transform(F.slice("p", skip + 1, F.size("p") - skip), lambda x: x.cast("double"))
    columns = [F.col("p")[0].cast("long").alias("id"), *([F.col("p")[1].cast("double").alias("labeled")] if labelled else []), feat.alias("feat")]
    out = parts.select(*columns)
    return out.repartition(partitions, "id") if partitions else out


def read_sparse_features(spark: SparkSession, path: str, labelled: bool = False) -> DataFrame:
    """id, size, indices, values of the entries that aren't zero."""
    rows = read_features(spark, path, labelled)
    return rows.select("id", to_sparse(F.col("feat")).alias("s")).select("id", "s.*")


def read_edges(spark: SparkSession, path: str, swapped: bool = False) -> DataFrame:
    """src, dst from lines src,dst; swapped reads them as dst,src."""
    edges = spark.read.schema("src long, dst long").csv(path)
    return reverse_edges(edges) if swapped else edges


def read_meta(spark: SparkSession, path: str, n_labels: int = 1) -> DataFrame:
    """Labels and masks by name; with several labels they come as label_0, label_1, ..."""
    if n_labels == 1:
        return spark.read.schema(META_SCHEMA).csv(path)
    labels = ", ".join(f"label_{i} int" for i in range(n_labels))
    return spark.read.schema(f"id long, {labels}, all_mask int, train_mask int, valid_mask int, test_mask int").csv(path)


def read_plain_graph(spark: SparkSession, edge_path: str, vertex_path: str) -> PropertyGraph:
    """Edge lines src,dst and vertex lines id."""
    return PropertyGraph(spark.read.schema("id long").csv(vertex_path), read_edges(spark, edge_path))


def with_random_features(graph: PropertyGraph, width: int, n_classes: int, seed: int = 1, held_out: int = 20) -> PropertyGraph:
    """Gaussian features and uniform labels by hash; the held_out lowest ids are split off as test."""
    feat = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: gaussian(seed, F.col("id"), i))
    label = F.floor(uniform(seed + 1, F.col("id")) * n_classes).cast("int")
    split = F.when(F.col("id") < held_out, 2).otherwise(0)
    return graph.with_vertices(graph.vertices.select("id", feat.alias("feat"), label.alias("label"), split.alias("split")))


def load_csv_graph(spark: SparkSession, feature_path: str, edge_path: str, norm: str = "symmetric", loops: bool = False, both_ways: bool = False, labelled: bool = False, degree_convention: str = "forward") -> PropertyGraph:
    """Read, add directions and loops, normalise."""
    vertices, edges = read_features(spark, feature_path, labelled), read_edges(spark, edge_path)
    if both_ways:
        edges = undirected(edges)
    if loops:
        edges = add_self_loops(edges, vertices)
    return PropertyGraph(vertices, normalise(edges, norm, degree_convention)).validate()


def load_partitioned(spark: SparkSession, path: str) -> tuple[PropertyGraph, DataFrame]:
    """The graph written by save_partitioned, and its reversed edges."""
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return PropertyGraph(read("vertices"), read("edges")), read("edges_rev")


def load_bucketed(spark: SparkSession, name: str) -> tuple[PropertyGraph, DataFrame]:
    """The graph written by save_bucketed, and its reversed edges."""
    return PropertyGraph(spark.table(f"{name}_vertices"), spark.table(f"{name}_edges")), spark.table(f"{name}_edges_rev")


def load_graph(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> PropertyGraph:
    """fmt parquet (written by save_partitioned) or csv (features.csv and edges.csv in the folder)."""
    if fmt == "parquet":
        return load_partitioned(spark, path)[0]
    if fmt == "csv":
        return load_csv_graph(spark, f"{path}/features.csv", f"{path}/edges.csv", **options)
    raise ValueError("fmt has to be parquet or csv")
