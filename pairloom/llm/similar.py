"""The near-duplicate stage: SimHash tables, carried on to a Jaccard similarity of 0.8 of five-word shingles.

The covering masks of simhash.py propose every pair whose fingerprints differ in up to two bits.
Texts that share 0.8 of their shingles differ in ten bits on average, which no affordable number of
masks covers; so MinHash bands propose those as well: at a similarity of 0.8 a pair shares none of
40 bands of 6 five times in a million. Every proposed pair is confirmed by the exact similarity of
the two sets. Within a bucket all members are first
compared with one representative, another one for each table and round. Afterwards all pairs that no
link has joined yet are compared: in buckets of up to SMALL members as pairs, each pair once for all
its buckets; in larger ones inside tasks, on two blocks of the bucket at a time, where postings of
shingles count what a set shares with all others at once. No pair of a bucket is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import checked_broadcast, driver_gives_back, giving_back, materialise
from pairloom.llm.components import connected_components
from pairloom.llm.simhash import NO_ID, covering_masks, keep_first, simhash_of

SHINGLE, LEAST = 5, 0.8
BANDS, BAND_ROWS = 40, 6
#: Rounds in which members of a bucket are compared with one representative.
ROUNDS = 4
#: Members up to which those of a bucket that are not all linked by then are written as pairs; larger ones go through blocks.
SMALL = 64
#: Shingles of a block, about; two blocks of a bucket meet in a task.
BLOCK = 1 << 19
_MUL, _ADD = np.random.default_rng(42).integers(0, 2**64, (2, BANDS * BAND_ROWS, 1), dtype=np.uint64)
_MUL |= np.uint64(1)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The XXH64 of word shingles in order, repeats included; A-Z lower-cased.

    Texts shorter than a shingle are one shingle; without words there is none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(b" ".join(words[i : i + shingle]), 42) for i in range(max(1, len(words) - shingle + 1))], np.uint64)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct ones, sorted."""
    return np.unique(shingle_hashes(text, shingle))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; two empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def band_keys(s: np.ndarray) -> np.ndarray:
    """A key for each band; none for an empty set."""
    if not len(s):
        return np.empty(0, np.int64)
    low = np.full(len(_MUL), 2**64 - 1, np.uint64)
    for at in range(0, len(s), 1024):  # bounded memory for very long texts
        low = np.minimum(low, (s[at : at + 1024] * _MUL + _ADD).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in low.reshape(BANDS, BAND_ROWS)], np.uint64).view(np.int64)


def _prints(docs: DataFrame) -> DataFrame:
    """(doc_id, key, node, bands, text): key names the text, node the set of shingles."""
    masks = np.array(covering_masks(), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
            nodes, bands = [], []
            for t in b.column(2):
                h = shingle_hashes(t.as_py())
                s = np.unique(h)
                nodes.append(xxhash.xxh64_intdigest(s.tobytes(), 42))
                near = (masks & np.uint64(simhash_of(h))).view(np.int64)
                bands.append(np.concatenate([band_keys(s), near]) if len(s) else near[:0])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64())), b.column(2)],
                ["doc_id", "key", "node", "bands", "text"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit("\x00"))).alias("key"), "text")
    return rows.mapInArrow(giving_back(run), "doc_id long, key long, node long, bands array<long>, text string")


def _confirmed(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The rows (u, v) of pairs whose sets are alike."""
    u = texts.select(F.col("node").alias("u"), F.col("text").alias("tu"))
    v = texts.select(F.col("node").alias("v"), F.col("text").alias("tv"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = lru_cache(maxsize=256)(shingle_set)
        for b in batches:
            good = [jaccard(held(x.as_py()), held(y.as_py())) >= least for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield b.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return pairs.join(u, "u").join(v, "v").select("u", "v", "tu", "tv").mapInArrow(giving_back(run), "u long, v long")


def links(roots: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Pairs of places that join what is alike among sets of distinct numbers; equal roots are joined already.

    With the roots they have the components of all pairs of a similarity of least or more.
    """
    label = np.unique(roots, return_inverse=True)[1]
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    posted = owner[np.argsort(token, kind="stable")]
    end = np.cumsum(np.bincount(token))
    begin = np.concatenate([[0], end[:-1]])
    at = np.concatenate([[0], np.cumsum(size)])
    # The members of the most frequent root need not look for others: the others find them.
    seeking = np.flatnonzero(label != np.bincount(label).argmax())
    out = []
    for x in seeking.tolist():
        mine = token[at[x] : at[x + 1]]
        both = np.bincount(np.concatenate([posted[b:e] for b, e in zip(begin[mine].tolist(), end[mine].tolist(), strict=True)]), minlength=len(sets))
        for y in np.flatnonzero((both / (size + size[x] - both) >= least) & (label != label[x])).tolist():
            if label[y] != label[x]:
                out.append((x, y))
                label[label == label[y]] = label[x]
    return out


def _large_edges(large: DataFrame, texts: DataFrame, least: float, block: int) -> DataFrame:
    """(u, v) with the components of all links between members (t, key, node, root) of a bucket.

    A bucket is split by hash into blocks of about block shingles, any two of which meet in a task.
    """

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
            sets = [shingle_set(t.as_py()).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "size", "shingles"])

    def run(group: pa.Table) -> pa.Table:
        nodes, roots = (group.column(c).to_numpy() for c in ("node", "root"))
        found = links(roots, [s.values.to_numpy() for s in group.column("shingles")], least)
        u, v = (nodes[[p[k] for p in found]] for k in (0, 1))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    sets = texts.join(large.select("node").distinct(), "node", "left_semi").select("node", "text").mapInArrow(giving_back(to_sets), "node long, size long, shingles array<long>")
    sets = materialise(sets, "similar-sets")
    blocks = large.join(sets.select("node", "size"), "node").groupBy("t", "key").agg(F.ceil(F.sum("size") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node", F.lit(-1)), F.col("blocks")).cast("int")
    spread = large.join(blocks, ["t", "key"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("blocks = 1 or own <> other")
    spread = spread.select("t", "key", "node", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    # Nothing to do where all members in two blocks are joined.
    split = spread.groupBy("t", "key", "i", "j").agg(F.min("root").alias("_least"), F.max("root").alias("_most")).filter("_least < _most").drop("_least", "_most")
    return spread.join(split, ["t", "key", "i", "j"]).join(sets.select("node", "shingles"), "node").groupBy("t", "key", "i", "j").applyInArrow(run, "u long, v long")


def similar_edges(distinct: DataFrame, least: float = LEAST, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """(u, v) over distinct sets (node, bands, text) with the components of all pairs in a bucket of a similarity of least or more."""
    bands = distinct.select("node", F.posexplode("bands").alias("t", "key"))
    shared = materialise(bands.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "similar-shared")
    members = materialise(bands.join(shared, ["t", "key"]), "similar-members")
    known = checked_broadcast(materialise(members.select("node").distinct(), "similar-nodes"))  # else all texts are shuffled
    texts = materialise(distinct.select("node", "text").join(known, "node", "left_semi"), "similar-texts")
    none = distinct.sparkSession.createDataFrame([], "u long, v long")
    edges, tested, roots = none, none, None
    for k in range(rounds + 1):
        driver_gives_back(distinct.sparkSession)
        at = members.withColumn("root", F.col("node"))
        if roots is not None:
            at = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        split = at.groupBy("t", "key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.min(F.struct(F.xxhash64("node", "t", F.lit(k)).alias("h"), "node", "root")).alias("rep"), F.count(F.lit(1)).alias("n")).filter("least < most")
        if k < rounds:
            pairs = at.join(split, ["t", "key"]).filter("root <> rep.root").select("node", F.col("rep.node").alias("other"))
        else:
            left = materialise(at.join(split.select("t", "key", "n"), ["t", "key"]), "similar-left")
            few = left.filter(F.col("n") <= SMALL)
            other = few.select("t", "key", F.col("node").alias("other"), F.col("root").alias("_root"))
            pairs = few.join(other, ["t", "key"]).filter("root < _root").select("node", "other")
            large = left.filter(F.col("n") > SMALL).drop("n")
            if large.limit(1).count():
                edges = edges.unionByName(materialise(_large_edges(large, texts, least, block), "similar-large"))
        pairs = pairs.select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).distinct()
        pairs = materialise(pairs.join(tested, ["u", "v"], "left_anti"), "similar-pairs")
        found = materialise(_confirmed(pairs, texts, least), "similar-found")
        edges, tested = edges.unionByName(found), tested.unionByName(pairs)
        if k < rounds and found.limit(1).count():
            roots = materialise(connected_components(edges), "similar-roots")
    return edges


def similar_groups(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, key, component_id, root) for each row of docs: the smallest doc_id reachable over pairs of a similarity of least or more.

    key names the text, root the group. Texts without words are alike. Rows without an id get the
    component's smallest id, null if it has none. Very long texts are read whole; repeated rows each
    get their own result; an empty table gives an empty result; other columns are not read.
    """
    prints = materialise(_prints(docs), "similar")
    distinct = prints.groupBy("node").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("first"), F.first("bands").alias("bands"), F.first("text").alias("text"))
    distinct = materialise(distinct, "similar-distinct")
    linked = connected_components(similar_edges(distinct, least))
    linked = materialise(linked.join(distinct.select("node", "first"), "node"), "similar-linked")
    ids = linked.groupBy("root").agg(F.min("first").alias("component"))
    known = distinct.select("node", "first").join(linked.select("node", "root").join(ids, "root").select("node", "component", "root"), "node", "left")
    known = known.select(F.col("node").alias("_node"), F.coalesce("component", "first").alias("component"), F.coalesce("root", "node").alias("root"))
    out = prints.select("doc_id", "key", "node").join(known, F.col("node") == F.col("_node"), "left")
    return out.select("doc_id", "key", F.when(F.col("component") < NO_ID, F.col("component")).alias("component_id"), "root")


def drop_similar(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One row of docs for each group, columns as they were: that of the smallest doc_id, of several the text of the smallest hash.

    Null ids come last. A row whose id another group's rows have too stays if it is its own group's.
    """
    return keep_first(docs, materialise(similar_groups(docs, least), "similar-groups"))
