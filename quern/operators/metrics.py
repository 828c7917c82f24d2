"""Losses and metrics as aggregates over predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.vectors import argmax, log_softmax, topk


def masked_cross_entropy(rows: DataFrame, logits: str = "logits", label: str = "label", mask: str = "mask") -> DataFrame:
    """loss: mean of -log softmax at the label over rows with the mask set."""
    ce = -F.get(log_softmax(F.col(logits)), F.col(label).cast("int"))
    return rows.agg((F.sum(F.when(F.col(mask) == 1, ce)) / F.sum(F.col(mask))).alias("loss"))


def _share(hit: Column) -> Column:
    n = F.count("*")
    return F.when(n > 0, F.sum(hit.cast("int")) / n).otherwise(0.0)


def accuracy(rows: DataFrame, by: list[str] | None = None, k: int = 1, logits: str = "logits", label: str = "label") -> DataFrame:
    """n_correct, n, accuracy of the k best classes; 0 if there is no row."""
    hit = argmax(F.col(logits)) == F.col(label) if k == 1 else F.array_contains(topk(F.col(logits), k), F.col(label))
    out = [F.coalesce(F.sum(hit.cast("int")), F.lit(0)).alias("n_correct"), F.count("*").alias("n"), _share(hit).alias("accuracy")]
    return rows.groupBy(*(by or [])).agg(*out)


def binary_accuracy(rows: DataFrame, score: str = "score", label: str = "label", threshold: float = 0.5) -> DataFrame:
    hit = (F.col(score) > threshold).cast("int") == F.col(label)
    return rows.agg(F.coalesce(F.sum(hit.cast("int")), F.lit(0)).alias("n_correct"), F.count("*").alias("n"), _share(hit).alias("accuracy"))


def confusion(rows: DataFrame, pred: str = "pred", truth: str = "truth", classes: DataFrame | None = None) -> DataFrame:
    """cls, tp, fp, fn, tn for each class that is predicted or true somewhere."""
    pairs = rows.select(F.explode(F.array_distinct(F.array(pred, truth))).alias("cls"), F.col(pred).alias("p"), F.col(truth).alias("t"))
    hit = lambda a, b: F.sum(F.when(a & b, 1).otherwise(0))
    p, t = F.col("p") == F.col("cls"), F.col("t") == F.col("cls")
    counts = pairs.groupBy("cls").agg(hit(p, t).alias("tp"), hit(p, ~t).alias("fp"), hit(~p, t).alias("fn"))
    whole = counts.withColumn("n", rows.agg(F.count("*")).scalar())
    return whole.select("cls", "tp", "fp", "fn", (F.col("n") - F.col("tp") - F.col("fp") - F.col("fn")).alias("tn"))


def multilabel_confusion(rows: DataFrame, pred: str = "pred", truth: str = "truth") -> DataFrame:
    """cls, tp, fp, fn, tn for arrays of 0 and 1."""
    at = rows.select(F.posexplode(F.arrays_zip(F.col(pred).alias("p"), F.col(truth).alias("t"))).alias("cls", "x")).select("cls", "x.p", "x.t")
    hit = lambda p, t: F.sum(F.when((F.col("p") == p) & (F.col("t") == t), 1).otherwise(0))
    return at.groupBy("cls").agg(hit(1, 1).alias("tp"), hit(1, 0).alias("fp"), hit(0, 1).alias("fn"), hit(0, 0).alias("tn"))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    whole = tp + 0.5 * (fp + fn)
    return F.when(whole > 0, tp / whole).otherwise(0.0)


def f1_scores(cm: DataFrame) -> DataFrame:
    """f1_micro and f1_macro of a confusion table."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return cm.agg(_f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("f1_micro"), F.avg(_f1(tp, fp, fn)).alias("f1_macro"))


def split_accuracy(rows: DataFrame, by: list[str] | None = None, logits: str = "logits", label: str = "label") -> DataFrame:
    """Accuracy for each split whose mask (train_mask, valid_mask, test_mask) is set, and each model if by names it."""
    masks = F.array(*[F.struct(F.lit(s).alias("split"), F.col(f"{s}_mask").alias("on")) for s in ("train", "valid", "test")])
    spread = rows.select("*", F.explode(masks).alias("m")).where("m.on = 1").withColumn("split", F.col("m.split"))
    return accuracy(spread, [*(by or []), "split"], 1, logits, label)


def n_classes(labels: DataFrame) -> DataFrame:
    return labels.agg(F.countDistinct("label").alias("n_classes"))


def train_count(masks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n_train, of all rows or for each value of by, such as a column with the partition."""
    return masks.groupBy(*(by or [])).agg(F.sum("train_mask").alias("n_train"))
