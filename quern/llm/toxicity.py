"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence has a logistic score over its distinct words
and their beginnings, the bag
is scored by noisy-or, 1 - prod(1 - p), and weights are trained from the documents' labels through
that formula. The trained sentence scores then say where the offending sentences are.

Training takes a bounded sample of labelled rows: of each label the max_per_label rows (4,000 by
default) with the lowest hash of their id, weighted back to the labels' true shares. It is written
once. Features are all words and beginnings that LEAST_DOCS of its documents have and that documents
of label 1 have more often than chance by LEAST_Z standard errors; there is no limit to their number
but the sample. Everything else covers all rows and whole texts. Scores read the text only.

A sentence's words are taken BLOCK bytes at a time, and of a longer one only the words that tell are
remembered; counts are handed on as they come. So memory follows neither a task's share of the
sample nor the longest text, but for 8 bytes for each distinct feature of a text that is learned from.

Edge cases: null, empty and wordless texts score 0; a null label isn't learned from; without two
classes all scores are 0; a null doc_id counts as the empty string for the fold and isn't learned
from; rows that repeat get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.arrow import text_chunks, texts_of
from quern.llm.common import Workspace, table

MAX_PER_LABEL = 4_000
LEAST_DOCS, LEAST_Z = 3, 4.0
PREFIXES = (4, 5, 6)
#: Bytes of a sentence whose words are held at a time, features counted before they are handed on, and bytes of a word that a cache keeps.
BLOCK, HELD, CACHED = 1 << 20, 1_000_000, 64
THRESHOLD = 0.7


def _byte_table() -> bytes:
    """Same length as the text: A-Z to lower case, sentence ends to line feeds, other ASCII but letters and digits to spaces."""
    out = bytearray(range(256))
    for b in range(128):
        c = chr(b)
        out[b] = ord(c.lower()) if c.isalnum() else 10 if c in ".!?\n" else 32
    return bytes(out)


_TABLE = _byte_table()


def sentences(text: bytes) -> list[bytes]:
    """Pieces between sentence ends, blank ones included; piece i begins one byte after piece i - 1 ends."""
    return text.translate(_TABLE).split(b"\n")


def word_sets(piece: bytes, block: int | None = None) -> Iterator[set[bytes]]:
    """The distinct words of a cleaned piece, about block bytes at a time; a word can be in several sets."""
    at, block = 0, block or BLOCK
    while at < len(piece):
        end = len(piece)
        if end - at > block:
            blank = piece.find(b" ", at + block)
            end = blank if blank >= 0 else end
        if words := set(piece[at:end].split()):
            yield words
        at = end


def distinct_words(piece: bytes, tells: Callable[[bytes], object]) -> set[bytes] | None:
    """The distinct words of a cleaned piece, of one longer than BLOCK only those that tell; None without a word."""
    sets = word_sets(piece)
    found = next(sets, None)
    if found is not None and len(piece) > BLOCK:
        found = {w for w in found if tells(w)}
        for words in sets:
            found.update(w for w in words if tells(w))
    return found


def word_features(word: bytes) -> list[int]:
    """Hashes (XXH3, 64 bits) of a word and of its beginnings, which inflected forms share."""
    digest = xxhash.xxh3_64_intdigest
    return [digest(word), *[digest(b"^" + word[:k]) for k in PREFIXES if len(word) > k]]


@dataclass(frozen=True)
class BagModel:
    """Weights by feature hash."""

    weights: dict[int, float]
    bias: float

    def scorer(self):
        weights = self.weights

        class Cache(dict):
            """Weight of a word; emptied when it holds 400,000. Long words are looked up anew."""

            def __missing__(self, word: bytes) -> float:
                if len(self) >= 400_000:
                    self.clear()
                found = sum(weights.get(f, 0.0) for f in word_features(word))
                if len(word) <= CACHED:
                    self[word] = found
                return found

        weight, bias = Cache().__getitem__, self.bias

        def score(text: bytes) -> tuple[float, int | None, int | None, float]:
            """Noisy-or score; start, end and score of the worst sentence, in bytes of UTF-8."""
            clean, at, worst = 0.0, 0, (-1.0, None, None)
            for piece in sentences(text):
                words = distinct_words(piece, weight)
                if words is not None:
                    z = bias + sum(map(weight, words))
                    clean -= max(z, 0.0) + math.log1p(math.exp(-abs(z)))
                    if z > worst[0] or worst[1] is None:
                        worst = (z, at, at + len(piece))
                at += len(piece) + 1
            if worst[1] is None:
                return 0.0, None, None, 0.0
            return -math.expm1(clean), worst[1], worst[2], 0.5 * (1 + math.tanh(worst[0] / 2))

        return score


@dataclass(frozen=True)
class Bags:
    """Documents as bags of sentences.

    doc_of: document of each sentence. sents, features: sentence and number of each feature that a
    distinct word of it has. y, importance: label and weight of each document.
    """

    doc_of: np.ndarray
    sents: np.ndarray
    features: np.ndarray
    y: np.ndarray
    importance: np.ndarray

    def loss_and_gradient(self, weights: np.ndarray, bias: float, centre: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
        """Mean negative log likelihood under noisy-or plus half ridge times the squared distance to centre; its gradient, the bias last."""
        n_docs, n_sents, total = len(self.y), len(self.doc_of), self.importance.sum()
        z = bias + np.bincount(self.sents, weights=weights[self.features], minlength=n_sents)
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        clean = np.bincount(self.doc_of, weights=-np.logaddexp(0, z), minlength=n_docs)
        toxic = np.maximum(-np.expm1(clean), 1e-9)
        push = np.where(self.y == 1, -np.exp(clean) / toxic, 1.0) * self.importance / total
        g, moved = push[self.doc_of] * p, weights - centre
        loss = float(-(np.where(self.y == 1, np.log(toxic), clean) * self.importance).sum() / total + ridge / 2 * moved @ moved)
        return loss, np.append(np.bincount(self.features, weights=g[self.sents], minlength=len(weights)) + ridge * moved, g.sum())


def train_bags(bags: Bags, centre: np.ndarray, steps: int = 400, rate: float = 0.1, prior: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias, fitted by Adam on the noisy-or likelihood.

    Weights start at centre, the features' log-odds, and are pulled back to it with a strength of
    prior over the number of documents, so the pull fades as evidence grows. Noisy-or alone leaves a
    word weak that always comes with others, and then a document with just that word is missed.
    """
    n_docs, n_sents = len(bags.y), len(bags.doc_of)
    share = float((bags.importance * bags.y).sum() / bags.importance.sum())
    weights, bias = centre.copy(), float(np.log(max(share, 1e-4) * n_docs / n_sents))
    m, v = np.zeros(len(centre) + 1), np.zeros(len(centre) + 1)
    for step in range(1, steps + 1):
        _, grad = bags.loss_and_gradient(weights, bias, centre, prior / n_docs)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - float(move[-1])
    return weights, bias


def fold(id_column: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % 3


def learn(docs: DataFrame, labels: DataFrame, max_per_label: int = MAX_PER_LABEL, workspace: Workspace | None = None) -> BagModel:
    """Train on labelled rows outside the held-out fold."""
    workspace = workspace or Workspace(docs.sparkSession, "toxicity")
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold() != 1)).select("doc_id", "toxic")
    shares = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    parts = [known.where(F.col("toxic") == k).orderBy(*order).limit(max_per_label) for k in (0, 1)]
    # At most twice max_per_label pairs of numbers, so the broadcast is bounded.
    sample = parts[0].unionByName(parts[1]).select(F.col("doc_id").alias("__id"), "toxic")
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("__id")).select(F.xxhash64("doc_id").alias("order"), "toxic", "text")
    chosen = workspace.materialise(chosen, "sample")

    kind = labels.schema["toxic"].dataType.simpleString()
    known_features, centre = _telling_features(chosen)
    if not known_features or len(shares) < 2:
        return BagModel({}, -math.inf)
    number = {f: i for i, f in enumerate(known_features)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tells = lambda w: any(f in number for f in word_features(w))
        for chunk in text_chunks(batches):
            bags, sizes = [], []
            for text in texts_of(chunk):
                own = (words for piece in sentences(text) if (words := distinct_words(piece, tells)) is not None)
                own = [sorted(number[f] for w in s for f in word_features(w) if f in number) for s in own]
                sizes.append(np.array([len(s) for s in own], "<u4").tobytes())
                bags.append(np.array([x for s in own for x in s], "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([chunk.column("order"), chunk.column("toxic"), pa.array(bags, pa.binary()), pa.array(sizes, pa.binary())], ["order", "toxic", "features", "sizes"])

    rows = chosen.mapInArrow(run, f"order long, toxic {kind}, features binary, sizes binary").toPandas()
    workspace.drop("sample")
    rows = rows[rows["sizes"].map(len) > 0].sort_values(["order", "toxic", "sizes", "features"], kind="stable")
    sizes = [np.frombuffer(x, "<u4").astype(np.int64) for x in rows["sizes"]]
    flat = np.concatenate(sizes)
    y = rows["toxic"].to_numpy(int)
    drawn = np.bincount(y, minlength=2)
    importance = np.array([shares.get(k, 0) / max(drawn[k], 1) for k in (0, 1)])[y]
    features = np.frombuffer(b"".join(rows["features"]), "<u4").astype(np.int64)
    doc_of = np.repeat(np.arange(len(rows)), [len(s) for s in sizes])
    weights, bias = train_bags(Bags(doc_of, np.repeat(np.arange(len(flat)), flat), features, y, importance), centre)
    return BagModel({f: float(w) for f, w in zip(known_features, weights, strict=True) if abs(w) > 1e-6}, bias)


def text_features(text: bytes) -> np.ndarray:
    """Sorted hashes of the features of a text, without repeats."""
    found = np.zeros(0, np.uint64)
    for words in word_sets(text.translate(_TABLE).replace(b"\n", b" ")):
        new = np.fromiter((f for w in words for f in word_features(w)), np.uint64)
        found = np.union1d(found, new) if len(found) else np.unique(new)
    return found


def count_features(labels: list[int], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
    """feature, n0, n1: documents by label that have a feature, in parts of about HELD features; feature 0 counts documents."""
    for label in (0, 1):
        held, size = [], 0

        def part() -> pa.RecordBatch:
            features, n = np.unique(np.concatenate(held), return_counts=True)
            columns = [pa.array(features.view(np.int64)), *[pa.array(n * (k == label), pa.int64()) for k in (0, 1)]]  # noqa: B023
            held.clear()  # noqa: B023
            return pa.RecordBatch.from_arrays(columns, ["feature", "n0", "n1"])

        for own, text in zip(labels, texts, strict=True):
            if own == label:
                found = text_features(text)
                held += [np.zeros(1, np.uint64), found]
                size += len(found)
                if size >= HELD:
                    yield part()
                    size = 0
        if held:
            yield part()


def _telling_features(sample: DataFrame) -> tuple[list[int], np.ndarray]:
    """Hashes of the features that are over-represented in documents of label 1, by z score, and their smoothed log-odds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            yield from count_features(chunk.column("toxic").to_pylist(), texts_of(chunk))

    counted = sample.select("toxic", "text").mapInArrow(run, "feature long, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counted = counted.where(f"n0 + n1 >= {LEAST_DOCS}").persist()
    sizes = counted.where("feature = 0").first()
    if sizes is None or not sizes["n0"] or not sizes["n1"]:
        return [], np.zeros(0)
    share = sizes["n1"] / (sizes["n0"] + sizes["n1"])
    n = F.col("n0") + F.col("n1")
    z = (F.col("n1") - n * share) / F.sqrt(n * (share * (1 - share)))
    found = counted.where("feature != 0").select("feature", "n0", "n1", z.alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature").collect()
    counted.unpersist()
    odds = [math.log((r["n1"] + 0.5) / (sizes["n1"] + 1)) - math.log((r["n0"] + 0.5) / (sizes["n0"] + 1)) for r in found]
    return [r["feature"] % (1 << 64) for r in found], np.array(odds)


def score_documents(docs: DataFrame, model: BagModel) -> DataFrame:
    """doc_id, score, worst_start, worst_end, worst_score (bytes of UTF-8 of the worst sentence)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for chunk in text_chunks(batches):
            columns = list(zip(*map(score, texts_of(chunk)), strict=True))
            kinds = (pa.float64(), pa.int64(), pa.int64(), pa.float64())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), *arrays], ["doc_id", "score", "worst_start", "worst_end", "worst_score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, worst_start long, worst_end long, worst_score double")


def offending_sentences(docs: DataFrame, model: BagModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, start, end, score, sentence for every sentence that scores threshold or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for chunk in text_chunks(batches):
            found = []
            for doc_id, text in zip(chunk.column("doc_id").to_pylist(), texts_of(chunk), strict=True):
                at = 0
                for piece in sentences(text):
                    p = score(piece)[0]
                    if p >= threshold:
                        found.append((doc_id, at, at + len(piece), p, text[at : at + len(piece)].decode(errors="replace")))
                    at += len(piece) + 1
            if found:
                kinds = (chunk.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.float64(), pa.string())
                arrays = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "end", "score", "sentence"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, end long, score double, sentence string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, learn(docs, table(spark, sf_dir, "labels")))
    held_out = (fold() == 1).alias("held_out")
    predicted = F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    return scored.select("doc_id", held_out, "score", predicted, "worst_start", "worst_end", "worst_score")
