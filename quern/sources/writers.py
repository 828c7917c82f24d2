"""Writers for graphs, tables and model weights."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.graph import PropertyGraph, reverse_edges


def save_partitioned(graph: PropertyGraph, path: str, partitions: int) -> None:
    """vertices by id, edges and edges_rev by their own src: equal keys share a file, so filters on them read little.

    Plain Parquet has no partitioning that a join could use; save_bucketed has.
    """
    keep = [c for c in graph.vertices.columns if c not in ("grad", "messages", "in_deg", "out_deg")]
    graph.vertices.select(*keep).repartition(partitions, "id").write.mode("overwrite").parquet(f"{path}/vertices")
    graph.edges.repartition(partitions, "src").write.mode("overwrite").parquet(f"{path}/edges")
    reverse_edges(graph.edges).repartition(partitions, "src").write.mode("overwrite").parquet(f"{path}/edges_rev")


def save_bucketed(graph: PropertyGraph, name: str, buckets: int) -> None:
    """Tables name_vertices (by id), name_edges and name_edges_rev (by src) in buckets: joins of edges with vertices on src need no shuffle."""
    for suffix, frame, key in (("vertices", graph.vertices, "id"), ("edges", graph.edges, "src"), ("edges_rev", reverse_edges(graph.edges), "src")):
        # One file for each bucket.
        frame.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(f"{name}_{suffix}")


def save_plain(graph: PropertyGraph, edge_path: str, vertex_path: str) -> None:
    graph.edges.select(F.concat_ws(",", "src", "dst")).write.mode("overwrite").text(edge_path)
    graph.vertices.select(F.col("id").cast("string")).write.mode("overwrite").text(vertex_path)


def save_csv(graph: PropertyGraph, meta: DataFrame, path: str) -> None:
    """edges.csv, features.csv (id,labeled,x0,...) and meta.csv, without headers."""
    graph.edges.select("src", "dst").write.mode("overwrite").csv(f"{path}/edges.csv")
    feat = F.transform("feat", lambda x: F.format_string("%.4e", x.cast("double")))
    labeled = F.col("labeled").cast("string") if "labeled" in graph.vertices.columns else F.lit("0.0")
    line = F.concat_ws(",", F.col("id").cast("string"), labeled, feat)
    graph.vertices.select(line).write.mode("overwrite").text(f"{path}/features.csv")
    meta.write.mode("overwrite").csv(f"{path}/meta.csv")


def node_lines(vertices: DataFrame) -> DataFrame:
    """id, label, feature with the entries joined by colons."""
    feature = F.concat_ws(":", F.transform("feat", lambda x: x.cast("string")))
    return vertices.select("id", F.col("label").cast("long").alias("label"), feature.alias("feature"))


def edge_lines(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("src_id"), F.col("dst").alias("dst_id"), F.lit(0.0).alias("weight"))


def split_lines(masks: DataFrame, split: str) -> DataFrame:
    return masks.where(F.col(f"{split}_mask") == 1).select("id", F.lit(1.0).alias("weight"))


def _typed(frame: DataFrame) -> DataFrame:
    """Column names with their types, as name:type."""
    short = {"bigint": "int64", "int": "int64", "double": "float", "float": "float", "string": "string"}
    return frame.toDF(*[f"{name}:{short[kind]}" for name, kind in frame.dtypes])


def save_typed_tsv(graph: PropertyGraph, masks: DataFrame, path: str) -> None:
    """Tab-separated node, edge and split tables under typed headers."""
    tables = {"nodes": node_lines(graph.vertices), "edges": edge_lines(graph.edges)}
    tables |= {s: split_lines(masks, s) for s in ("train", "valid", "test")}
    for name, frame in tables.items():
        _typed(frame).write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{path}/{name}.tsv")


def save_arrays(spark: SparkSession, arrays: dict[str, np.ndarray], path: str, block: int = 1 << 16) -> None:
    """name, part, values: flat arrays in blocks."""
    rows = [(name, part, own[part * block : (part + 1) * block].tolist()) for name, own in arrays.items() for part in range(-(-len(own) // block))]
    spark.createDataFrame(rows, "name string, part int, values array<double>").write.mode("overwrite").parquet(path)


def load_arrays(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """As large as what save_arrays was given: a model's weights and optimizer state, which live on the driver anyway."""
    found: dict[str, dict[int, list[float]]] = {}
    for r in spark.read.parquet(path).collect():
        found.setdefault(r["name"], {})[r["part"]] = r["values"]
    return {name: np.concatenate([parts[i] for i in range(len(parts))]) for name, parts in found.items()}


def save_weights(spark: SparkSession, weights: dict[str, list], path: str) -> None:
    """name, row, col, value."""
    rows = [(name, i, j, float(x)) for name, matrix in weights.items() for i, row in enumerate(matrix) for j, x in enumerate(row)]
    spark.createDataFrame(rows, "name string, row int, col int, value double").write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> dict[str, list[list[float]]]:
    out: dict[str, dict[int, dict[int, float]]] = {}
    for r in spark.read.parquet(path).collect():
        out.setdefault(r["name"], {}).setdefault(r["row"], {})[r["col"]] = r["value"]
    return {name: [[row[j] for j in sorted(row)] for _, row in sorted(rows.items())] for name, rows in out.items()}


def append_metrics(spark: SparkSession, rows: list[tuple[int, str, str, float]], path: str) -> None:
    """epoch, model, name, value"""
    spark.createDataFrame(rows, "epoch int, model string, name string, value double").write.mode("append").parquet(path)
