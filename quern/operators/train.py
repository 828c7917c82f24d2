"""Full-graph training: one forward and one backward sweep of the graph an epoch, for all models at once.

Layer 0's neighbour sum depends on data alone and is made once. Every sweep is a DataFrame plan cut
by a checkpoint. A task adds up the weight gradients of all its batches and ships them once, as
arrays of BLOCK numbers; Spark sums the arrays, and the driver, where weights and optimizers live,
gets one array for each block of the model. Gradients of layer 0's input are never propagated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.graph import PropertyGraph
from quern.operators.neural import LayerPass, ModelSpec, Weights, init_weights, inputs_of, layer_forward, matrix, output_moments, slices, standardised
from quern.operators.optimizers import optimizer
from quern.operators.propagate import backward_forward, hubs, weighted_sum
from quern.session import Timers, cut
from quern.sources.writers import load_arrays, save_arrays

SPLITS = ("train", "valid", "test")
ROWS = "kind string, id long, part int, vec array<double>"
#: Numbers of one row of summed gradients.
BLOCK = 1 << 16


@dataclass
class History:
    """One row for each epoch, model and measure."""

    rows: list[tuple[int, int, str, float]] = field(default_factory=list)

    def value(self, epoch: int, model: int, name: str) -> float:
        return next(v for e, m, n, v in self.rows if (e, m, n) == (epoch, model, name))


def flatten(layer: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    return np.concatenate([x.ravel() for pair in layer for x in pair])


def unflatten(flat: np.ndarray, like: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for w, b in like:
        out.append((flat[at : at + w.size].reshape(w.shape), flat[at + w.size : at + w.size + b.size]))
        at += w.size + b.size
    return out


def loss_and_gradient(logits: np.ndarray, labels: np.ndarray, mask: np.ndarray, loss: str) -> tuple[float, np.ndarray]:
    """Summed masked loss and its gradient by the logits: ce for class numbers, bce for arrays of 0 and 1."""
    if loss == "ce":
        z = logits - logits.max(axis=1, keepdims=True)
        log_p = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        rows = np.arange(len(labels))
        grad = np.exp(log_p)
        grad[rows, labels] -= 1
        return float(-(log_p[rows, labels] * mask).sum()), grad * mask[:, None]
    p = 1 / (1 + np.exp(-np.clip(logits, -40, 40)))
    each = np.logaddexp(0, logits) - labels * logits
    return float((each.mean(axis=1) * mask).sum()), (p - labels) * mask[:, None] / labels.shape[1]


class _TaskSums:
    """What one task adds up over its batches, by kind and model."""

    def __init__(self):
        self.found: dict[tuple[str, int], np.ndarray] = {}

    def add(self, kind: str, model: int, values: np.ndarray) -> None:
        key = (kind, model)
        self.found[key] = self.found[key] + values if key in self.found else values

    def frame(self) -> pd.DataFrame:
        rows = [(kind, model, part, own[part * BLOCK : (part + 1) * BLOCK]) for (kind, model), own in self.found.items() for part in range(-(-len(own) // BLOCK))]
        return pd.DataFrame(rows, columns=["kind", "id", "part", "vec"])


def last_layer(gammas: DataFrame, targets: DataFrame, specs: list[ModelSpec], weights: list[Weights], epoch: int, total: float, loss: str) -> DataFrame:
    """Rows g (gradient for each vertex), w (weight gradients of a task by model), m (loss and hits by model)."""
    layer = specs[0].n_layers - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places, sums = inputs_of(specs, layer), _TaskSums()
        for batch in batches:
            if not len(batch):
                continue
            x, ids = matrix(batch["vec"]), batch["id"].to_numpy()
            labels = batch["label"].to_numpy().astype(int) if loss == "ce" else matrix(batch["label"])
            masks = [batch[f"{s}_mask"].to_numpy().astype(float) for s in SPLITS]
            grads = np.zeros_like(x)
            for k, (spec, own, place) in enumerate(zip(specs, weights, places, strict=True)):
                one = LayerPass(spec, own, layer, epoch, True)
                logits = one.forward(x[:, place], ids)
                value, grad = loss_and_gradient(logits, labels, masks[0], loss)
                back, found = one.backward(grad / total)
                grads[:, place] += back
                hit = (logits.argmax(axis=1) == labels) if loss == "ce" else ((logits > 0) == (labels > 0.5)).mean(axis=1)
                sums.add("w", k, flatten(found))
                sums.add("m", k, np.array([value, *[x for m in masks for x in ((hit * m).sum(), m.sum())]]))
            yield pd.DataFrame({"kind": "g", "id": ids, "part": 0, "vec": list(grads)})
        yield sums.frame()

    masks = [f"{s}_mask" for s in SPLITS]
    return gammas.join(targets.select("id", "label", *masks), "id").mapInPandas(run, ROWS)


def layer_backward(gammas: DataFrame, grads: DataFrame, specs: list[ModelSpec], weights: list[Weights], layer: int, epoch: int, moments) -> DataFrame:
    """Recomputes the forward of a layer; rows g (left out for layer 0) and w. grads has (id, vec) for the layer's outputs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places, ends, sums = inputs_of(specs, layer), slices([s.widths[layer + 1] for s in specs]), _TaskSums()
        for batch in batches:
            if not len(batch):
                continue
            x, g, ids = matrix(batch["vec"]), matrix(batch["g"]), batch["id"].to_numpy()
            back = np.zeros_like(x)
            for k, (spec, own, place, end) in enumerate(zip(specs, weights, places, ends, strict=True)):
                one = LayerPass(spec, own, layer, epoch, True, moments[k] if moments else None)
                one.forward(x[:, place], ids)
                own_back, found = one.backward(g[:, end])
                back[:, place] += own_back
                sums.add("w", k, flatten(found))
            if layer:
                yield pd.DataFrame({"kind": "g", "id": ids, "part": 0, "vec": list(back)})
        yield sums.frame()

    return gammas.join(grads.select("id", F.col("vec").alias("g")), "id").mapInPandas(run, ROWS)


def summed(rows: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """Vectors of a kind added up by model: an array for each BLOCK numbers of the model comes to the driver."""
    parts = rows.where(F.col("kind") == kind).select("id", "part", array_to_vector("vec").alias("v"))
    found: dict[int, dict[int, list[float]]] = {}
    for r in parts.groupBy("id", "part").agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("x")).collect():
        found.setdefault(r["id"], {})[r["part"]] = r["x"]
    return {k: np.concatenate([v[i] for i in range(len(v))]) for k, v in found.items()}


class Trainer:
    """Trains models of equal depth and kind of loss side by side."""

    def __init__(self, graph: PropertyGraph, targets: DataFrame, specs: list[ModelSpec], loss: str = "ce", weights: list[Weights] | None = None, storage: str | None = None):
        """targets: id, label, train_mask, valid_mask, test_mask. storage: a level at which the first layer's sums are kept besides."""
        if len({s.n_layers for s in specs}) > 1:
            raise ValueError("models of a batch have the same number of layers")
        self.graph, self.targets, self.specs, self.loss = graph, targets, specs, loss
        self.weights = weights or [init_weights(s) for s in specs]
        self.optimizers = [optimizer(s.optimizer, s.lr, s.weight_decay) for s in specs]
        self.total = float(targets.agg(F.sum("train_mask")).first()[0] or 1)
        self.timers, self.history = Timers(), History()
        # Every sweep reads the edges, so how they came about is computed once.
        self.graph, self.done = graph.with_edges(cut(graph.edges.select("src", "dst", "weight"))), 0
        self.hubs = {end: cut(hubs(self.graph.edges, end)) for end in ("src", "dst")}
        self.first = cut(weighted_sum(self.graph.edges, graph.vertices.select("id", "feat"), "feat", of_hubs=self.hubs["src"]))
        if storage:
            self.first = self.first.persist(getattr(StorageLevel, storage))

    def gradients(self, epoch: int) -> tuple[list[list[list[tuple[np.ndarray, np.ndarray]]]], dict[int, np.ndarray]]:
        """Weight gradients by model and layer, and the sums of loss and hits by model."""
        specs, depth = self.specs, self.specs[0].n_layers
        gammas, moments = [self.first], []
        for layer in range(depth - 1):
            with self.timers.timed(f"forward-{layer}"):
                own = None
                if any(s.normalise for s in specs):
                    raw = cut(layer_forward(gammas[-1], specs, self.weights, layer, epoch, True))
                    mean, var = output_moments(raw)
                    own = [(mean[p], var[p]) if s.normalise else None for s, p in zip(specs, slices([s.widths[layer + 1] for s in specs]), strict=True)]
                    outputs = standardised(raw, own, [s.widths[layer + 1] for s in specs])
                else:
                    outputs = layer_forward(gammas[-1], specs, self.weights, layer, epoch, True)
                moments.append(own)
                gammas.append(cut(weighted_sum(self.graph.edges, outputs, "emb", of_hubs=self.hubs["src"])))
        with self.timers.timed("loss"):
            rows = cut(last_layer(gammas[-1], self.targets, specs, self.weights, epoch, self.total, self.loss))
            measures, found = summed(rows, "m"), {depth - 1: summed(rows, "w")}
        for layer in range(depth - 2, -1, -1):
            with self.timers.timed(f"backward-{layer}"):
                sent = rows.where("kind = 'g'").select("id", F.col("vec").alias("grad"))
                grads = backward_forward(self.graph.edges, sent, "grad", of_hubs=self.hubs["dst"])
                rows = cut(layer_backward(gammas[layer], grads, specs, self.weights, layer, epoch, moments[layer]))
                found[layer] = summed(rows, "w")
        return [[unflatten(found[layer][k], self.weights[k][layer]) for layer in range(depth)] for k in range(len(specs))], measures

    def epoch(self, number: int) -> None:
        grads, measures = self.gradients(number)
        for k, (own, step) in enumerate(zip(self.weights, self.optimizers, strict=True)):
            flat = np.concatenate([flatten(layer) for layer in own])
            self.weights[k] = self._shaped(k, step.step(flat, np.concatenate([flatten(layer) for layer in grads[k]])))
            loss, *hits = measures[k]
            self.history.rows.append((number, k, "loss", float(loss / self.total)))
            for s, hit, n in zip(SPLITS, hits[::2], hits[1::2], strict=True):
                self.history.rows.append((number, k, f"{s}_accuracy", float(hit / n) if n else 0.0))
        self.done = number + 1

    def _shaped(self, model: int, flat: np.ndarray) -> Weights:
        at, fresh = 0, []
        for layer in self.weights[model]:
            size = sum(w.size + b.size for w, b in layer)
            fresh.append(unflatten(flat[at : at + size], layer))
            at += size
        return fresh

    def fit(self, epochs: int) -> History:
        """Train up to so many epochs in all; after load, those that are left."""
        for number in range(self.done, epochs):
            self.epoch(number)
        return self.history

    def fit_closure(self, model: int = 0, steps: int = 10) -> list[float]:
        """Train one model by an optimizer that asks for loss and gradient as it goes (L-BFGS with line search); the loss after each step."""
        step = self.optimizers[model]
        if not hasattr(step, "search"):
            raise ValueError("the model's optimizer takes no closure")

        def closure(flat: np.ndarray) -> tuple[float, np.ndarray]:
            self.weights[model] = self._shaped(model, flat)
            grads, measures = self.gradients(self.done)
            return float(measures[model][0] / self.total), np.concatenate([flatten(layer) for layer in grads[model]])

        flat, losses = np.concatenate([flatten(layer) for layer in self.weights[model]]), []
        for _ in range(steps):
            flat, loss = step.search(flat, closure)
            self.weights[model] = self._shaped(model, flat)
            losses.append(loss)
        return losses

    def save(self, path: str) -> None:
        """Write weights, optimizer states, the number of epochs done and the history, so that a run can go on."""
        state: dict[str, np.ndarray] = {"epochs": np.array([float(self.done)])}
        for k, (layers, step) in enumerate(zip(self.weights, self.optimizers, strict=True)):
            state[f"{k}/weights"] = np.concatenate([flatten(layer) for layer in layers])
            state |= {f"{k}/optimizer/{name}": value for name, value in step.state().items()}
        spark = self.graph.edges.sparkSession
        save_arrays(spark, state, f"{path}/state")
        history_frame(spark, self.history).write.mode("overwrite").parquet(f"{path}/history")

    def load(self, path: str) -> None:
        """Take over what save wrote; the specs have to be the same."""
        spark = self.graph.edges.sparkSession
        state = load_arrays(spark, f"{path}/state")
        for k, step in enumerate(self.optimizers):
            self.weights[k] = self._shaped(k, state[f"{k}/weights"])
            prefix = f"{k}/optimizer/"
            step.restore({name.removeprefix(prefix): value for name, value in state.items() if name.startswith(prefix)})
        self.done = int(state["epochs"][0])
        self.history = History([tuple(r) for r in spark.read.parquet(f"{path}/history").orderBy("epoch", "model", "name").collect()])

    def predict(self) -> DataFrame:
        """id, logits of all models side by side, without dropout."""
        return forward(self.graph, self.specs, self.weights)


def forward(graph: PropertyGraph, specs: list[ModelSpec], weights: list[Weights], plan: str = "summarizer") -> DataFrame:
    """id, logits: all layers of all models side by side."""
    rows = graph.vertices.select("id", F.col("feat").alias("emb"))
    for layer in range(specs[0].n_layers):
        gammas = weighted_sum(graph.edges, rows, "emb", plan)
        rows = layer_forward(gammas, specs, weights, layer)
    return rows.select("id", F.col("emb").alias("logits"))


def history_frame(spark, history: History) -> DataFrame:
    return spark.createDataFrame(history.rows, "epoch int, model int, name string, value double")
