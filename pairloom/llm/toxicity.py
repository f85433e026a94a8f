"""Toxicity by compression distance.

A zstandard dictionary is trained on ordinary texts; the toxic one holds, after the same bytes, the
windows of toxic texts whose wording sets these apart. Each window of a text is compressed with
both, and the difference of the two lengths is its distance. The largest distances of a text, and
how many there are, are calibrated to a probability on labelled texts that neither dictionary saw.

Null, empty and white texts have no window and get the score that the calibration gives to none;
very long texts are read window by window, whole; equal texts have equal scores; repeated rows each
get their own; an empty table gives an empty result; columns but doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import table
from pairloom.llm.labelled import fit_logistic, fold, hash_order, logistic, sample, share_of

#: Labelled texts of each class that are learnt from, at most, and their characters.
SAMPLE_ROWS, SAMPLE_CHARS = 3000, 12_000_000
FOLDS, HELD_OUT = 4, 2
PREDICT_FROM = 0.3
WINDOW_WORDS = 8
#: Bytes of the common part of the dictionaries, and of the toxic windows.
ORDINARY_BYTES, TOXIC_BYTES = 32_000, 2_400
#: Words of a toxic window in the dictionary, and bytes of the strings by which it is chosen.
_PIECE_WORDS, _MER = 2, 5
_LEVEL, _MIN_MATCH = 3, 4


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _windows(words: list[bytes], size: int = WINDOW_WORDS) -> Iterator[bytes]:
    for i in range(0, len(words), size):
        yield b" " + b" ".join(words[i : i + size]) + b" "


def _trained(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size]


class _Seen:
    """A growing set of numbers, as sorted arrays each over twice as long as the next: eight bytes a number."""

    def __init__(self):
        self._levels: list[np.ndarray] = []

    def has(self, x: np.ndarray) -> np.ndarray:
        found = np.zeros(len(x), bool)
        for level in self._levels:
            found |= level[np.minimum(np.searchsorted(level, x), len(level) - 1)] == x
        return found

    def add(self, x: np.ndarray) -> None:
        """x is sorted, without repeats, and new."""
        while self._levels and len(self._levels[-1]) <= 2 * len(x):
            x = np.sort(np.concatenate([self._levels.pop(), x]))
        if len(x):
            self._levels.append(x)


def _different(texts: list[bytes]) -> list[bytes]:
    """texts without those of whose word triples over a fifth were in earlier ones; triples are told apart by their XXH64."""
    seen = _Seen()
    out = []
    for text in texts:
        words = text.split()
        triples = np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(t)) for t in zip(words, words[1:], words[2:], strict=False)), np.uint64))
        new = triples[~seen.has(triples)]
        if not len(triples) or len(triples) - len(new) <= 0.2 * len(triples):
            seen.add(new)
            out.append(text)
    return out


def _mers(data: bytes) -> np.ndarray:
    """The strings of _MER bytes of data, as numbers, by place."""
    x = np.frombuffer(data, np.uint8).astype(np.int64)
    n = max(0, len(x) - _MER + 1)
    out = np.zeros(n, np.int64)
    for i in range(_MER):
        out = out << 8 | x[i : i + n]
    return out


def _text_mers(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The distinct strings of each text, sorted."""
    return (np.unique(_mers(b" " + t + b" ")) for t in texts)


def _counts(texts: list[bytes], most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(strings, number of texts that have each), summed up whenever most strings have come together."""
    known, n = np.empty(0, np.int64), np.empty(0, np.int64)
    held: list[np.ndarray] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        more, m = np.unique(np.concatenate(held), return_counts=True)
        at = np.searchsorted(known, more)
        old = known[np.minimum(at, len(known) - 1)] == more if len(known) else np.zeros(len(more), bool)
        n[at[old]] += m[old]
        return np.insert(known, at[~old], more[~old]), np.insert(n, at[~old], m[~old])

    for mers in _text_mers(texts):
        held.append(mers)
        size += len(mers)
        if size >= max(most, len(known) // 2):
            known, n = merged()
            held, size = [], 0
    return merged() if held else (known, n)


def _apart(texts: list[bytes], others: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(strings, weights): what is in several of texts and, as a share, in under a quarter as many of others."""
    mine, n = _counts(texts)
    several = n >= max(3, len(texts) // 100)
    mine, n = mine[several], n[several]
    if not len(mine):
        return mine, np.empty(0)
    m = np.zeros(len(mine), np.int64)
    for mers in _text_mers(others):  # only those in question are counted
        at = np.minimum(np.searchsorted(mine, mers), len(mine) - 1)
        m[at[mine[at] == mers]] += 1
    ratio = np.log((n + 0.5) / (len(texts) + 1)) - np.log((m + 0.5) / (len(others) + 1))
    good = ratio > np.log(4)
    return mine[good], (ratio * np.sqrt(n))[good]


def _places(pieces: list[bytes], mers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(string, piece) by number: where mers are inside pieces."""
    length = np.array([len(p) for p in pieces])
    found = _mers(b"".join(pieces))
    end = np.cumsum(length)
    own = np.repeat(np.arange(len(pieces)), length)[: len(found)]
    at = np.minimum(np.searchsorted(mers, found), len(mers) - 1)
    inside = (mers[at] == found) & (np.arange(len(found)) + _MER <= end[own])
    return at[inside], own[inside]


def _setting_apart(texts: list[bytes], others: list[bytes], size: int) -> bytes:
    """Windows of texts that hold most of what is not in others, for their length, the best last; each string counts once."""
    mers, weight = _apart(texts, others)
    if not len(mers):
        return b""
    kept: set[bytes] = set()
    for text in texts:  # windows without such a string are never chosen
        w = text.split()
        own = list({b" " + b" ".join(w[i : i + _PIECE_WORDS]) + b" " for i in range(max(1, len(w) - _PIECE_WORDS + 1))})
        kept.update(own[k] for k in np.unique(_places(own, mers)[1]))
    pieces = sorted(kept)
    if not pieces:
        return b""
    length = np.array([len(p) for p in pieces])
    at, own = _places(pieces, mers)
    out: list[bytes] = []
    while len(at) and sum(map(len, out)) < size:
        score = np.bincount(own, weight[at], minlength=len(pieces)) / (length + 4)
        best = int(score.argmax())
        out.append(pieces[best])
        weight[at[own == best]] = 0
        left = weight[at] > 0
        at, own = at[left], own[left]
    return b"".join(reversed(out))[-size:]


class ToxicityModel:
    """Fitted on (id, text, label); without texts of both classes it scores the share of label 1.

    share is that of label 1 among all labelled texts, for which the probabilities are to hold.
    """

    def __init__(self, labelled: list[tuple[int, str, int]], share: float | None = None):
        self._both = self.calibration = None
        # Texts are kept in one piece: a list of their words takes several times their size on the driver.
        rows = [(hash_order(d) % 3, b" ".join(_words(t)), y) for d, t, y in labelled]
        # A third of the texts is kept for the calibration.
        toxic = _different([w for k, w, y in rows if y and k])
        ordinary = _different([w for k, w, y in rows if not y and k])
        self.base = sum(y for _, _, y in labelled) / max(1, len(labelled)) if share is None else share
        rest = [(w, y) for k, w, y in rows if not k]
        if not toxic or not ordinary or len({y for _, y in rest}) < 2:
            return
        self.ordinary = _trained(ORDINARY_BYTES, [x for t in ordinary for x in _windows(t.split())])
        self.toxic = _setting_apart(toxic, ordinary, TOXIC_BYTES)
        x = np.array([self._features(w.split()) for w, _ in rest])
        self.calibration = fit_logistic(x, np.array([y for _, y in rest], float), share=share)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_both": None}

    def _compressors(self):
        if self._both is None:
            self._both = []
            for content in (self.ordinary, self.ordinary + self.toxic):
                params = zstandard.ZstdCompressionParameters.from_level(
                    _LEVEL, source_size=128, dict_size=len(content), min_match=_MIN_MATCH, write_content_size=0, write_dict_id=0
                )
                held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                self._both.append(zstandard.ZstdCompressor(dict_data=held, compression_params=params).compress)
        return self._both

    def _features(self, words: list[bytes]) -> list[float]:
        plain, both = self._compressors()
        saved = np.array([len(plain(x)) - len(both(x)) for x in _windows(words)] + [0, 0, 0])
        top = np.sort(saved)[::-1]
        return [top[0], top[:2].sum(), np.log1p(np.maximum(saved, 0).sum()), np.log1p((saved >= 3).sum()), np.log(len(saved))]

    def score(self, text: str | None) -> float:
        if self.calibration is None:
            return self.base
        return float(logistic(self.calibration, np.array([self._features(_words(text))]))[0])


def fit_toxicity(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = HELD_OUT) -> ToxicityModel:
    """Learns from labels.toxic of a bounded sample outside the held-out fold."""
    rows = sample(docs, labels, "toxic", folds, held, SAMPLE_ROWS, SAMPLE_CHARS)
    return ToxicityModel(rows, share_of(labels, "toxic", folds, held))


def score_texts(docs: DataFrame, model) -> DataFrame:
    """(doc_id, score) of every row; null and empty texts are scored as texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [model.score(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def score_toxicity(docs: DataFrame, model: ToxicityModel, folds: int = FOLDS, held: int = HELD_OUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs. Rows without an id count as not held out."""
    out = score_texts(docs, model)
    return out.select(
        "doc_id",
        F.coalesce(fold("doc_id", folds) == held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"),
    )


def op6_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the probability of being toxic."""
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
