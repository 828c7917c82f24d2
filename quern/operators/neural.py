"""Per-vertex neural layers as numpy kernels over Arrow batches.

A layer takes the aggregated messages of a vertex. A GCN layer is one linear step, a GIN-like layer
a perceptron of several; each step but the network's last has an activation, and each layer but the
last dropout and normalisation. Several models can share a pass: their vectors lie side by side,
layer 0 reads one shared input, later layers their own slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import cycle, islice, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("gcn", "gin")


@dataclass(frozen=True)
class ModelSpec:
    """Shape and training options of a model."""

    widths: tuple[int, ...]  # input, hidden ..., classes
    kind: str = "gcn"
    mlp_hidden: int = 128
    leaky: float = 0.01  # slope below zero; 0 is plain ReLU
    dropout: float = 0.0
    normalise: bool = False
    optimizer: str = "adamw"
    lr: float = 0.01
    weight_decay: float = 0.01
    seed: int = 2021

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"kind has to be one of {KINDS}")
        if len(self.widths) < 2:
            raise ValueError("widths need an input and an output")

    @property
    def n_layers(self) -> int:
        return len(self.widths) - 1


def grid(base: ModelSpec, k: int | None = None, **options: list) -> list[ModelSpec]:
    """One spec for each combination of options; repeated from the start, or cut, to k of them."""
    specs = [replace(base, **dict(zip(options, values, strict=True))) for values in product(*options.values())]
    return list(islice(cycle(specs), k)) if k else specs


Weights = list[list[tuple[np.ndarray, np.ndarray]]]


def init_weights(spec: ModelSpec) -> Weights:
    """Xavier-uniform weights and zero biases: for each layer its linear steps."""
    rng = np.random.default_rng(spec.seed)

    def linear(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        bound = np.sqrt(6 / (a + b))
        return rng.uniform(-bound, bound, (a, b)), np.zeros(b)

    steps = [[(a, b)] if spec.kind == "gcn" else [(a, spec.mlp_hidden), (spec.mlp_hidden, b)] for a, b in zip(spec.widths, spec.widths[1:])]
    return [[linear(a, b) for a, b in layer] for layer in steps]


def formula_weights(spec: ModelSpec) -> Weights:
    """Weights that SQL can compute too: (((31 i + 17 j + 7 l) mod 13) - 6) / 13 / sqrt(fan in), bias 0; l counts linear steps."""
    out, step = [], 0
    for layer in init_weights(spec):
        made = []
        for w, b in layer:
            i, j = np.indices(w.shape)
            made.append((((i * 31 + j * 17 + step * 7) % 13 - 6) / 13.0 / np.sqrt(w.shape[0]), b))
            step += 1
        out.append(made)
    return out


def _keep_mask(spec: ModelSpec, epoch: int, layer: int, ids: np.ndarray, width: int) -> np.ndarray:
    """Dropout mask from (seed, epoch, layer, id, position), so that a recomputed forward draws the same."""
    x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(width, dtype=np.uint64)[None, :] * np.uint64(0xBF58476D1CE4E5B9)
    x ^= np.uint64((spec.seed * 1_000_003 + epoch * 8191 + layer * 131) & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x >> np.uint64(11)) / float(1 << 53)) >= spec.dropout


@dataclass
class LayerPass:
    """One layer of one model on a batch: forward keeps what backward needs."""

    spec: ModelSpec
    weights: Weights
    layer: int
    epoch: int = 0
    training: bool = False
    moments: tuple[np.ndarray, np.ndarray] | None = None
    kept: list = field(default_factory=list)

    def forward(self, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        spec, last_layer = self.spec, self.layer == self.spec.n_layers - 1
        steps = self.weights[self.layer]
        for number, (w, b) in enumerate(steps):
            z = x @ w + b
            slope = np.ones_like(z) if last_layer and number == len(steps) - 1 else np.where(z > 0, 1.0, spec.leaky)
            self.kept.append((x, slope))
            x = z * slope
        self.out_scale = np.ones_like(x)
        if not last_layer:
            if self.training and spec.dropout:
                self.out_scale = _keep_mask(spec, self.epoch, self.layer, ids, x.shape[1]) / (1 - spec.dropout)
                x = x * self.out_scale
            if self.moments is not None:
                mean, var = self.moments
                shrink = 1 / np.sqrt(var + 1e-5)
                self.out_scale, x = self.out_scale * shrink, (x - mean) * shrink
        return x

    def backward(self, grad: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Gradient for the input, and for each linear step's weights. The moments count as constants."""
        grad, found = grad * self.out_scale, []
        for (w, _), (x, slope) in zip(reversed(self.weights[self.layer]), reversed(self.kept), strict=True):
            grad = grad * slope
            found.append((x.T @ grad, grad.sum(axis=0)))
            grad = grad @ w.T
        return grad, found[::-1]


def slices(widths: list[int]) -> list[slice]:
    ends = np.cumsum(widths).tolist()
    return [slice(e - w, e) for w, e in zip(widths, ends, strict=True)]


def inputs_of(specs: list[ModelSpec], layer: int) -> list[slice]:
    """Where each model reads in the vectors that reach a layer: all share layer 0."""
    if layer == 0:
        if len({s.widths[0] for s in specs}) > 1:
            raise ValueError("models of a batch share their input width")
        return [slice(0, specs[0].widths[0])] * len(specs)
    return slices([s.widths[layer] for s in specs])


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, 0))


def layer_forward(gammas: DataFrame, specs: list[ModelSpec], weights: list[Weights], layer: int, epoch: int = 0, training: bool = False, moments=None, name: str = "emb") -> DataFrame:
    """id and the models' outputs side by side, from (id, vec)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = inputs_of(specs, layer)
        for batch in batches:
            if not len(batch):
                continue
            x, ids = matrix(batch["vec"]), batch["id"].to_numpy()
            outs = [LayerPass(s, w, layer, epoch, training, m).forward(x[:, p], ids) for s, w, p, m in zip(specs, weights, places, moments or [None] * len(specs), strict=True)]
            yield pd.DataFrame({"id": ids, name: list(np.hstack(outs))})

    return gammas.select("id", "vec").mapInPandas(run, f"id long, {name} array<double>")


def output_moments(outputs: DataFrame, column: str = "emb") -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of each position over all vertices: one aggregate, as many rows as the width."""
    rows = outputs.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v")).orderBy("i").collect()
    return np.array([r["m"] for r in rows]), np.array([r["v"] for r in rows])


def standardised(outputs: DataFrame, moments: list[tuple[np.ndarray, np.ndarray] | None], widths: list[int], column: str = "emb") -> DataFrame:
    """outputs with each model's slice shifted and scaled by its moments (None: left alone), as LayerPass does."""
    shift = np.concatenate([np.zeros(w) if m is None else m[0] for m, w in zip(moments, widths, strict=True)])
    shrink = np.concatenate([np.ones(w) if m is None else 1 / np.sqrt(m[1] + 1e-5) for m, w in zip(moments, widths, strict=True)])
    moved = F.zip_with(column, F.lit(shift.tolist()), lambda x, m: x - m)
    return outputs.withColumn(column, F.zip_with(moved, F.lit(shrink.tolist()), lambda x, s: x * s))


def apply_vertices(rows: DataFrame, fn, schema: str) -> DataFrame:
    """A user's function from Arrow record batches to record batches, for layers that aren't built in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield fn(batch)

    return rows.mapInArrow(run, schema)
