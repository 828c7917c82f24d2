"""The property graph: two DataFrames and the schemas they follow.

vertices: id LONG and any of feat, emb, grad ARRAY<DOUBLE>, labels and masks.
edges: src LONG, dst LONG, weight DOUBLE; directed, multi-edges and self-loops allowed.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGE_SCHEMA = "src long, dst long, weight double"
SPARSE_SCHEMA = "id long, size int, indices array<int>, values array<double>"
META_SCHEMA = "id long, label int, all_mask int, train_mask int, valid_mask int, test_mask int"


@dataclass(frozen=True)
class PropertyGraph:
    """An immutable graph. Updates return a new one, so state never builds up across layers."""

    vertices: DataFrame
    edges: DataFrame

    def with_vertices(self, vertices: DataFrame) -> PropertyGraph:
        return replace(self, vertices=vertices)

    def with_edges(self, edges: DataFrame) -> PropertyGraph:
        return replace(self, edges=edges)

    def reversed(self) -> PropertyGraph:
        return self.with_edges(reverse_edges(self.edges))

    def counts(self) -> DataFrame:
        """n_vertices, n_edges in one row."""
        v = self.vertices.agg(F.count("*").alias("n_vertices"))
        return v.withColumn("n_edges", self.edges.agg(F.count("*")).scalar())

    def sample(self, n: int = 3) -> tuple[DataFrame, DataFrame]:
        """The first n vertices and edges, in order of id."""
        return self.vertices.orderBy("id").limit(n), self.edges.orderBy("src", "dst").limit(n)

    def validate(self) -> PropertyGraph:
        for frame, wanted in ((self.vertices, {"id"}), (self.edges, {"src", "dst"})):
            if missing := wanted - set(frame.columns):
                raise ValueError(f"missing columns: {sorted(missing)}")
        return self


def reverse_edges(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)
