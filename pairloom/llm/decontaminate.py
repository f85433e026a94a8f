"""Benchmark decontamination: every training passage is a BM25 query against an index of the test items.

The inverted index holds, by term, item segments with their BM25 contribution divided by the score
of the segment against itself, so that a passage that contains a whole segment scores 1. All
segments above a threshold are retrieved with block-max WAND (Ding and Suel, 2011); before that, a
bound over coarse ranges of items dismisses most passages in array operations. What is retrieved
counts only if, side by side, the item and the words around the passage agree in most words of the
item and in enough of both its question and its answer.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import giving_back, load_bytes, shared_dir, store_bytes, table

#: Words of a segment; a passage is two such stretches, so every segment lies whole in some passage.
SEGMENT = 64
#: Share of a segment's own score from which a passage is looked at.
MIN_SCORE = 0.6
#: Share of an item's words that have to agree, and of its question's and answer's each; words count in runs of RUN or more.
MIN_OVERLAP, MIN_PART, RUN = 0.8, 0.6, 2
#: Words that an answer has at least, where the item is long enough.
MIN_ANSWER = 8
#: Score that at least has to come from the rarer terms, for a passage to reach MIN_SCORE.
_RARE_SCORE = 0.17
#: Characters of test items in one index. Larger benchmarks are indexed in several, of which a worker holds two at a time.
INDEX_CHARS = 4_000_000
#: Characters of documents that are worked on at once.
_CHUNK_CHARS = 400_000
_BLOCK, _RANGES = 32, 256
_WORDS = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def answer_at(text: str) -> int:
    """The number of the word with which the answer begins.

    The answer is the last sentence, or more of the item's end if that has under MIN_ANSWER words,
    but no more than half of it.
    """
    parts = [w for s in re.split(r"[.!?\n]+", text or "") if (w := words_of(s))]
    size = sum(map(len, parts))
    last = len(parts[-1]) if parts else 0
    if last == size:  # a single sentence
        last = max(1, size // 4)
    return max(size - max(last, MIN_ANSWER), size - last if last > size // 2 else size // 2)


class ItemIndex:
    """BM25 inverted index of test items (id, text); items without words are left out."""

    def __init__(self, items: list[tuple[int, str]], segment: int = SEGMENT, k1: float = 1.2, b: float = 0.75):
        self.segment = segment
        self.items = [(i, t) for i, t in items if words_of(t)]
        self.words = [words_of(t) for _, t in self.items]
        self.answers = [answer_at(t) for _, t in self.items]
        self.lengths = [len(w) for w in self.words]
        pieces = [(n, words_of(t)[a : a + segment]) for n, (_, t) in enumerate(self.items) for a in range(0, self.lengths[n], segment)]
        self.owner = [n for n, _ in pieces]
        self.terms = {w: k for k, w in enumerate(sorted({w for _, p in pieces for w in p}))}
        df = Counter(w for _, p in pieces for w in set(p))
        mean = sum(len(p) for _, p in pieces) / max(1, len(pieces))
        rows: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for s, (_, p) in enumerate(pieces):
            tf = Counter(p)
            parts = {
                w: math.log(1 + (len(pieces) - df[w] + 0.5) / (df[w] + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * len(p) / mean))
                for w, f in tf.items()
            }
            whole = sum(parts.values())
            for w, x in parts.items():
                rows[self.terms[w]].append((s, x / whole))
        self.postings = [[s for s, _ in r] for r in rows]
        self.impact = [[x for _, x in r] for r in rows]
        self.most = [max(x for _, x in r) for r in rows]
        self.block_most = []
        self.width = max(1, -(-len(pieces) // _RANGES))
        self.range_most = np.zeros((len(rows), max(1, -(-len(pieces) // self.width))), np.float32)
        for t, r in enumerate(rows):
            most: dict[int, float] = {}
            for s, x in r:
                most[s // _BLOCK] = max(x, most.get(s // _BLOCK, 0.0))
                self.range_most[t, s // self.width] = max(x, self.range_most[t, s // self.width])
            self.block_most.append(most)
        # The commonest terms whose scores leave _RARE_SCORE to the others, whatever the segment.
        self.common_most = np.zeros(self.range_most.shape[1], np.float32)
        self.rare = dict(self.terms)
        for w in sorted(self.terms, key=lambda w: (-df[w], w)):
            if (more := self.common_most + self.range_most[self.terms[w]]).max() > MIN_SCORE - _RARE_SCORE:
                break
            self.common_most = more
            del self.rare[w]
        self.rare_most = np.array(self.most)

    def retrieve(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """(segment, score) of all segments that score least or more, by block-max WAND."""
        cursors = [[self.postings[t][0], 0, t] for t in terms]
        out = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, None
            for k, (at, _, t) in enumerate(cursors):
                bound += self.most[t]
                if bound >= least:
                    pivot = at
                    last = k
                    break
            if pivot is None:
                break
            while last + 1 < len(cursors) and cursors[last + 1][0] == pivot:
                last += 1
            block = pivot // _BLOCK
            if sum(self.block_most[t].get(block, 0.0) for _, _, t in cursors[: last + 1]) < least:
                # No segment of this block can do before another list joins in.
                to = (block + 1) * _BLOCK
                if last + 1 < len(cursors):
                    to = min(to, cursors[last + 1][0])
                move = cursors[: last + 1]
            elif cursors[0][0] == pivot:
                score = sum(self.impact[t][p] for _, p, t in cursors[: last + 1])
                if score >= least:
                    out.append((pivot, score))
                to, move = pivot + 1, cursors[: last + 1]
            else:
                to, move = pivot, [c for c in cursors[:last] if c[0] < pivot]
            for c in move:
                at = self.postings[c[2]]
                while c[1] < len(at) and at[c[1]] < to:
                    c[1] += 1
                c[0] = at[c[1]] if c[1] < len(at) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return out

    def leaks(self, texts: list[str | None], least: float = MIN_SCORE, overlap: float = MIN_OVERLAP, part: float = MIN_PART) -> list[tuple[int, int, float, float, float]]:
        """(text number, item number, score, question overlap, answer overlap), once for each text and item."""
        slack = 1e-4  # the bounds are kept in single precision
        if least <= self.common_most.max() + slack:
            raise ValueError("least is within reach of common terms alone")
        words = [words_of(t) for t in texts]
        get = self.rare.get
        known = [np.fromiter(map(get, w, repeat(-1)), np.int64, len(w)) for w in words]
        halves = [-(-len(w) // self.segment) for w in words]
        base = np.concatenate([[0], np.cumsum(halves)])
        if not base[-1] or not self.items:
            return []
        ids = np.concatenate(known)
        own = np.repeat(np.arange(len(words)), halves)
        at = np.flatnonzero(ids >= 0)
        starts = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        text = np.searchsorted(starts, at, "right") - 1
        half, ids = (at - starts[text]) // self.segment + base[text], ids[at]
        # Passage x is halves x and x + 1 of one text: a word of half x is in passage x - 1 too.
        also = np.flatnonzero((half > 0) & (own[half - 1] == own[half]))
        keys = np.unique(np.concatenate([half, half[also] - 1]) * len(self.terms) + np.concatenate([ids, ids[also]]))
        passage, t = np.divmod(keys, len(self.terms))
        # First by the most that the terms add to any segment, then range by range.
        enough = np.bincount(passage, weights=self.rare_most[t], minlength=base[-1]) >= least - slack - self.common_most.max()
        kept = enough[passage]
        passage, t = passage[kept], t[kept]
        first = np.searchsorted(passage, np.arange(base[-1] + 1))
        full = np.flatnonzero(first[1:] > first[:-1])
        bound = np.add.reduceat(self.range_most[t], first[full], axis=0) if len(full) else np.zeros((0, 1), np.float32)
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for x in full[(bound + self.common_most >= least - slack).any(axis=1)].tolist():
            n = int(own[x])
            at = (x - int(base[n])) * self.segment
            there = {k for w in words[n][at : at + 2 * self.segment] if (k := self.terms.get(w)) is not None}
            for s, score in self.retrieve(sorted(there), least):
                item = self.owner[s]
                if best.get((n, item), (0, 0, 0))[0] >= score:
                    continue
                # Around the passage, so that a long item's other segments are there too.
                near = words[n][max(0, at - self.lengths[item]) : at + 2 * self.segment + self.lengths[item]]
                both, q, a = _agreement(self.words[item], self.answers[item], near)
                if both >= overlap and q >= part and a >= part:
                    best[n, item] = (score, q, a)
        return [(n, item, *v) for (n, item), v in sorted(best.items())]


def _agreement(item: list[str], answer: int, words: list[str]) -> tuple[float, float, float]:
    """Shares of an item's words, of its question's and of its answer's that agree with words in order."""
    agree = [False] * len(item)
    for m in SequenceMatcher(None, words, item, autojunk=False).get_matching_blocks():
        if m.size >= min(RUN, len(item)):
            agree[m.b : m.b + m.size] = [True] * m.size
    parts = (agree, agree[:answer] or agree, agree[answer:] or agree)
    return tuple(sum(p) / len(p) for p in parts)


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    a = size = 0
    for n, t in enumerate(texts):
        size += len(t or "")
        if size >= _CHUNK_CHARS:
            yield a, n + 1
            a, size = n + 1, 0
    if a < len(texts):
        yield a, len(texts)


def write_indexes(benchmark: DataFrame, chars: int = INDEX_CHARS) -> list[str]:
    """Files of indexes of about chars characters each in the shared folder, which together hold every item.

    They are built and read by the executors; the driver only has their names.
    """
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts, folder = -(-total // chars), f"{shared_dir(spark)}/items-{uuid.uuid4().hex}"
    if not parts:
        return []

    def build(items: pa.Table) -> pa.Table:
        name = f"{items.column('part')[0].as_py():06d}.index"
        mine = sorted(zip(items.column("item_id").to_pylist(), items.column("text").to_pylist(), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        store_bytes(folder, name, pickle.dumps(ItemIndex(mine)))
        return pa.table({"file": [f"{folder}/{name}"]})

    dealt = rows.withColumn("part", F.pmod(F.xxhash64("text", "item_id", F.monotonically_increasing_id()), F.lit(parts)))
    return sorted(r.file for r in dealt.groupBy("part").applyInArrow(build, "file string").collect())


@lru_cache(maxsize=2)
def _index(file: str) -> ItemIndex:
    return pickle.loads(load_bytes(file))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) for each row of docs and item it contains.

    Null and empty texts contain nothing, items without words are contained nowhere, repeated rows
    and repeated items each get their own result. Very long texts are read whole, passage by passage.
    Of several passages with one item the best counts, of equally good ones the first. An empty
    table of either kind gives an empty result; other columns are not read, whatever their names.
    """
    files = write_indexes(benchmark)
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    if not files:
        return docs.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for file in files:
                index = _index(file)
                found = [(ids[a + n], index.items[i][0], *v) for a, z in _chunks(texts) for n, i, *v in index.leaks(texts[a:z])]
                yield pa.RecordBatch.from_pylist([dict(zip(_PAIRS.names, f, strict=True)) for f in found], schema=_PAIRS)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


_PAIRS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that contain no test item, columns as they were, whatever their names; nothing is shuffled.

    Null and empty texts stay; repeated rows all stay or all go; an empty benchmark keeps all rows.
    """
    files, at = write_indexes(benchmark), docs.columns.index("text")
    if not files:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            bad = {a + n for file in files for a, z in _chunks(texts) for n, *_ in _index(file).leaks(texts[a:z])}
            yield b.filter(pa.array([n not in bad for n in range(len(texts))])) if bad else b

    return docs.mapInArrow(giving_back(run), docs.schema)


def op2_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and test item that it contains."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
