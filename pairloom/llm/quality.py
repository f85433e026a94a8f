"""Quality by a linear support vector machine over naive Bayes features (NB-SVM; Wang and Manning, 2012).

Features say whether an n-gram occurs: words, pairs of words, and runs of one to three word shapes
(case, digits, marks at the ends, length, whether the word repeats the one before). Each is scaled
by the log of its share in good over its share in bad texts, and a hinge-loss classifier on them is
fitted by dual coordinate descent (Hsieh et al., 2008). Margins are calibrated on texts that were
set aside.

Null, empty and white texts have one feature of their own; very long texts are read whole; equal
texts have equal scores, so ties at the threshold stay or go together; repeated rows each get their
own result; an empty table gives an empty result; columns but doc_id and text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import driver_gives_back, giving_back, table
from pairloom.llm.labelled import fit_logistic, fold, hash_order, logistic, sample, share_of
from pairloom.llm.toxicity import score_texts

SAMPLE_ROWS, SAMPLE_CHARS = 3000, 12_000_000
FOLDS, HELD_OUT = 5, 0
PREDICT_FROM = 0.3
_BITS = 18
#: Words whose features a worker remembers; then it forgets them all.
_REMEMBERED = 400_000


def _shape(word: str) -> int:
    """A number below 4096 for what a word looks like."""
    core = word.strip("".join({c for c in word if not c.isalnum()})) if not word.isalnum() else word
    letters = [c for c in core if c.isalpha()]
    case = 0 if not letters else 1 if core.islower() else 2 if core.istitle() else 3 if core.isupper() and len(letters) > 1 else 4
    mark = zlib.crc32(word[-3:].encode("utf-8", "surrogatepass")) % 61 + 1 if word and not word[-1].isalnum() else 0
    odd = sum(not c.isalnum() for c in word)
    return ((case * 62 + mark) * 4 + min(3, odd)) * 3 + (0 if len(core) < 2 else 1 if len(core) < 25 else 2)


class _Reader:
    """Distinct features of a text, hashed to 2 ** _BITS."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        if not words:
            return np.zeros(1, np.int64)  # the feature of wordless texts
        known = self.known
        if len(known) > _REMEMBERED:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) << 12 | _shape(w)
        both = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        shape, word = both & 0xFFF, both >> 12
        again = np.concatenate([[0], word[1:] == word[:-1]]).astype(np.int64)
        one = shape * 2 + again
        two = one[:-1] * 8209 + one[1:]
        three = two[:-1] * 8209 + one[2:]
        kinds = (word, one, two, three, word[:-1] * np.int64(0x2545F491) + word[1:])
        mixed = [((np.unique(k) * np.int64(0x9E3779B1) + n * 0x51ED27) * np.int64(0x85EBCA6B)) >> 20 for n, k in enumerate(kinds)]
        return np.unique(np.concatenate(mixed) & (2**_BITS - 1))


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 15, seed: int = 0) -> np.ndarray:
    """Weights of a linear hinge-loss classifier on rows of active features with the values in scale.

    y is -1 or 1; a text's features are scaled to unit length. Each step solves the dual for one text.
    """
    unit = np.array([1 / (np.linalg.norm(scale[r]) + 1e-9) for r in rows])
    w, alpha = np.zeros(len(scale)), np.zeros(len(rows))
    share = np.array([(y == v).mean() for v in (-1, 1)])
    most = cost * np.where(y > 0, 0.5 / share[1], 0.5 / share[0])  # the classes weigh alike
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r = rows[i]
            x = scale[r] * unit[i]
            step = np.clip(alpha[i] + 1 - y[i] * (w[r] @ x), 0, most[i]) - alpha[i]
            if step:
                alpha[i] += step
                w[r] += step * y[i] * x
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


class QualityModel:
    """Fitted on (id, text, label); without texts of both classes it scores the share of label 1."""

    def __init__(self, labelled: list[tuple[int, str, int]], share: float | None = None):
        self._read, self.calibration = None, None
        self.base = sum(y for _, _, y in labelled) / max(1, len(labelled)) if share is None else share
        read = _Reader()  # not kept: the driver need not remember words
        rows = [(hash_order(d) % 4, read(t), y) for d, t, y in labelled]
        learn, rest = [r for r in rows if r[0]], [r for r in rows if not r[0]]
        if len({y for _, _, y in learn}) < 2 or len({y for _, _, y in rest}) < 2:
            return
        share_in = [np.bincount(np.concatenate([f for _, f, y in learn if y == v]), minlength=2**_BITS) + 1.0 for v in (0, 1)]
        ratio = np.log(share_in[1] / share_in[1].sum()) - np.log(share_in[0] / share_in[0].sum())
        feats, y = [f for _, f, _ in learn], np.array([y for _, _, y in learn])
        w = dual_coordinate_descent(feats, ratio, np.where(y, 1.0, -1.0))
        # Scaled once and for all: a margin is then a sum over a text's features.
        self.square, self.weights = (ratio**2).astype(np.float32), (w * ratio).astype(np.float32)
        x = np.array([[self._margin(f)] for _, f, _ in rest])
        self.calibration = fit_logistic(x, np.array([y for _, _, y in rest], float), share=share)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_read": None}

    def _features(self, text: str | None) -> np.ndarray:
        if self._read is None:
            self._read = _Reader()
        return self._read(text)

    def _margin(self, f: np.ndarray) -> float:
        return float(self.weights[f].sum(dtype=np.float64) / (np.sqrt(self.square[f].sum(dtype=np.float64)) + 1e-9))

    def score(self, text: str | None) -> float:
        if self.calibration is None:
            return self.base
        return float(logistic(self.calibration, np.array([[self._margin(self._features(text))]]))[0])


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = HELD_OUT) -> QualityModel:
    """Learns from labels.quality of a bounded sample outside the held-out fold."""
    rows = sample(docs, labels, "quality", folds, held, SAMPLE_ROWS, SAMPLE_CHARS)
    model = QualityModel(rows, share_of(labels, "quality", folds, held))
    del rows
    driver_gives_back(docs.sparkSession)
    return model


def score_quality(docs: DataFrame, model: QualityModel, folds: int = FOLDS, held: int = HELD_OUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs. Rows without an id count as not held out."""
    return score_texts(docs, model).select(
        "doc_id",
        F.coalesce(fold("doc_id", folds) == held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, model: QualityModel, least: float = PREDICT_FROM) -> DataFrame:
    """The rows of docs that score least or more, columns as they were, whatever their names; nothing is shuffled.

    Rows with null texts or ids are judged like any other; repeated rows all stay or all go.
    """
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([model.score(t.as_py()) >= least for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(giving_back(run), docs.schema)


def op7_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the probability of being of good quality."""
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
