"""Bounded samples of labelled texts, and the logistic fit that turns scores into probabilities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(doc_id: str, folds: int) -> Column:
    """CRC-32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, rows: int, chars: int) -> list[tuple[int, str, int]]:
    """(doc_id, text, label) of up to rows documents of each class outside fold held, in hash order.

    Of a class, texts are given whole until they have chars characters; what follows stays out, and
    longer single texts do, so that under twice as many reach the driver. Label rows that are null
    or disagree about a document are left out, and so are null texts; of several texts with one id
    the one with the smallest hash is taken.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label")).filter("_label in (0, 1)")
    known = known.filter(fold("_id", folds) != held)
    known = known.groupBy("_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_high")).filter("_label = _high")
    picked = None
    for value in (0, 1):  # rows is the bound of what is broadcast
        part = known.filter(F.col("_label") == value).orderBy(F.xxhash64("_id"), "_id").limit(rows).select("_id", "_label")
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).filter(F.length("text") <= chars)
    texts = texts.groupBy("_id", "_label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    # Two groups of up to rows rows.
    before = Window.partitionBy("_label").orderBy(F.xxhash64("_id"), "_id").rowsBetween(Window.unboundedPreceding, -1)
    texts = texts.select("_id", "t.text", "_label", F.coalesce(F.sum(F.length("t.text")).over(before), F.lit(0)).alias("_before"))
    got = texts.filter(F.col("_before") < chars).select("_id", "text", "_label").collect()
    return sorted((tuple(r) for r in got), key=lambda r: (hash_order(r[0]), r[0]))


def hash_order(doc_id: int) -> int:
    """A fixed shuffle of ids."""
    return (doc_id * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64 >> 7


def share_of(labels: DataFrame, label: str, folds: int, held: int) -> float:
    """The share of label 1 among the labels outside fold held; 0 if there are none."""
    rows = labels.filter(fold("doc_id", folds) != held).filter(F.col(label).isin(0, 1))
    return rows.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50, share: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the bias last) of a ridge logistic regression, by Newton steps; share: of class 1, if not the sample's."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + ridge * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), grad)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    if share is not None and 0 < share < 1:  # the sample's classes weigh otherwise than the labels'
        w[-1] += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    return mean, scale, w


def logistic(model: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    mean, scale, w = model
    return 1 / (1 + np.exp(-np.clip(((x - mean) / scale) @ w[:-1] + w[-1], -30, 30)))
