"""Adapters that land a known dataset as the tables of this engine.

land writes a graph by save_partitioned and meta (id, label..., masks) beside it, from files that
are already there; nothing is fetched. Layouts:

ogb: edge.csv(.gz), node-feat.csv(.gz), node-label.csv(.gz) without headers or ids, row number = id,
  and split/train.csv(.gz), valid, test with one id a line.
saint: adj_full.npz (CSR), feats.npy, class_map.json, role.json (keys tr, va, te).
generated: the log-normal graph with features and labels by hash.

Row numbers of the ogb layout come from the order of lines: a file's splits are counted first, and a
line's number is that within its split plus the lines of the splits before.
"""

from __future__ import annotations

import io
import json
from math import ceil

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.graph import PropertyGraph
from quern.operators.generate import random_graph
from quern.operators.structure import split_masks, with_unit_weight
from quern.sources.readers import DATASETS, load_partitioned, with_random_features
from quern.sources.writers import save_partitioned

SPLITS = ("train", "valid", "test")


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """id (the line's number in the file) and value. As many counts come to the driver as the file has splits."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    shifts, before = [], 0
    for row in lines.groupBy("split").agg(F.min("at").alias("first"), F.count("*").alias("n")).orderBy("split").collect():
        shifts.append((row["split"], before - row["first"]))
        before += row["n"]
    shift = spark.createDataFrame(shifts, "split long, shift long")
    return lines.join(F.broadcast(shift), "split").select((F.col("at") + F.col("shift")).alias("id"), "value")


def _one(spark: SparkSession, folder: str, stem: str) -> str:
    """folder/stem or folder/stem.gz, whichever is there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for name in (f"{folder}/{stem}.gz", f"{folder}/{stem}"):
        at = hadoop.Path(name)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return name
    raise FileNotFoundError(f"{folder}/{stem}")


def _with_splits(spark: SparkSession, vertices: DataFrame, splits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices without the label, and meta with the masks of splits (id, split number)."""
    marked = vertices.join(splits, "id", "left")
    masks = split_masks(marked, F.col("split")).drop("labeled")
    return vertices.drop("label"), vertices.select("id", "label").join(masks, "id")


def read_ogb(spark: SparkSession, folder: str) -> tuple[PropertyGraph, DataFrame]:
    numbers = lambda kind: F.transform(F.split("value", ","), lambda x: F.trim(x).cast(kind))
    feats = _numbered(spark, _one(spark, folder, "node-feat.csv")).select("id", numbers("double").alias("feat"))
    labels = _numbered(spark, _one(spark, folder, "node-label.csv")).select("id", F.expr("try_cast(try_cast(split(value, ',')[0] as double) as int)").alias("label"))
    edges = spark.read.schema("src long, dst long").csv(_one(spark, folder, "edge.csv"))
    splits = None
    for number, name in enumerate(SPLITS):
        own = spark.read.schema("id long").csv(_one(spark, f"{folder}/split", f"{name}.csv")).select("id", F.lit(number).alias("split"))
        splits = own if splits is None else splits.unionByName(own)
    vertices, meta = _with_splits(spark, feats.join(labels, "id"), splits)
    return PropertyGraph(vertices, with_unit_weight(edges)), meta


def read_saint(spark: SparkSession, folder: str, block: int = 50_000) -> tuple[PropertyGraph, DataFrame]:
    """Arrays are read where the driver runs and turned to frames block by block; labels may be numbers or lists of 0 and 1."""
    files = {r["path"].rsplit("/", 1)[1]: r["content"] for r in spark.read.format("binaryFile").load(folder).select("path", "content").toLocalIterator()}
    feats, adjacency = np.load(io.BytesIO(files["feats.npy"])), np.load(io.BytesIO(files["adj_full.npz"]))
    classes, roles = json.loads(files["class_map.json"]), json.loads(files["role.json"])
    split = {i: number for number, name in enumerate(("tr", "va", "te")) for i in roles[name]}
    many = isinstance(next(iter(classes.values())), list)
    label = "array<int>" if many else "int"
    starts, targets = adjacency["indptr"], adjacency["indices"]
    frames: list[tuple[DataFrame, DataFrame]] = []
    for low in range(0, len(feats), block):
        high = min(low + block, len(feats))
        nodes = [(i, feats[i].astype(float).tolist(), classes[str(i)], split.get(i)) for i in range(low, high)]
        source = np.repeat(np.arange(low, high), np.diff(starts[low : high + 1]))
        pairs = list(zip(source.tolist(), targets[starts[low] : starts[high]].tolist(), strict=True))
        frames.append((spark.createDataFrame(nodes, f"id long, feat array<double>, label {label}, split int"), spark.createDataFrame(pairs, "src long, dst long")))
    rows, edges = frames[0]
    for more_rows, more_edges in frames[1:]:
        rows, edges = rows.unionByName(more_rows), edges.unionByName(more_edges)
    vertices, meta = _with_splits(spark, rows.drop("split"), rows.select("id", "split").where("split is not null"))
    return PropertyGraph(vertices, with_unit_weight(edges)), meta


def generated(spark: SparkSession, n: int, width: int, n_classes: int, seed: int = 1) -> tuple[PropertyGraph, DataFrame]:
    graph = with_random_features(random_graph(spark, n, seed, 1), width, n_classes, seed)
    rows = graph.vertices
    vertices, meta = _with_splits(spark, rows.drop("split"), rows.select("id", "split"))
    return graph.with_vertices(vertices), meta


def land(spark: SparkSession, dataset: int, target: str, source: str | None = None, partitions: int = 8, n: int = 10_000_000, force: bool = False) -> tuple[PropertyGraph, DataFrame]:
    """Write dataset (a number of DATASETS) from source under target unless it is there already; the graph and its meta."""
    spec = DATASETS[dataset]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    done = hadoop.Path(f"{target}/meta/_SUCCESS")
    if force or not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        if dataset == 0:
            graph, meta = generated(spark, n, spec.n_features, spec.n_classes)
        elif source is None:
            raise ValueError(f"{spec.name} needs a folder with its files")
        else:
            graph, meta = (read_saint if spec.name in ("yelp", "reddit", "amazon") else read_ogb)(spark, source)
        save_partitioned(graph, target, partitions)
        meta.repartition(max(1, ceil(partitions / 4))).write.mode("overwrite").parquet(f"{target}/meta")
    return load_partitioned(spark, target)[0], spark.read.parquet(f"{target}/meta")
