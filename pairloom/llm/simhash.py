"""SimHash near-duplicates through covering locality-sensitive hashing.

Structured bit masks (Pagh, 2016): every bit position i gets a vector m(i) of radius + 1 bits, and
mask v, for each nonzero v, keeps the positions whose m(i) has odd inner product with v. Up to
radius differing positions are up to radius linear conditions on v, so some nonzero v meets them
all: under that mask the two fingerprints are equal. No pair within the radius is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import checked_broadcast, materialise, table
from pairloom.llm.components import connected_components

RADIUS = 2
#: Fingerprints of a bucket that are compared in one block; larger buckets go through shared neighbours.
BLOCK = 4096
NO_ID = 2**63 - 1


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """2 ** (radius + 1) - 1 masks of which one spares any radius positions."""
    top = 2 ** (radius + 1)
    # The nonzero vectors in turn: each mask then keeps 4 / 7 of the bits at radius 2.
    vector = [i % (top - 1) + 1 for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() % 2) for v in range(1, top)]


def simhash64(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the XXH64 of word shingles, repeats included, A-Z lower-cased.

    Texts shorter than a shingle are one shingle; without words the fingerprint is 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        starts, ends = [0], [len(joined)]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        starts, ends = (end - size)[: 1 - shingle].tolist(), end[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return simhash_of(np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)], np.uint64))


def simhash_of(hashes: np.ndarray) -> int:
    """Each bit that over half of the hashes have; 0 for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):  # bounded memory for very long texts
        some = hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, key, fp): key is the XXH64 of the text, fp the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash64(t.as_py(), shingle) for t in b.column(2)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["doc_id", "key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit("\x00"))).alias("key"), "text")
    return rows.mapInArrow(run, "doc_id long, key long, fp long")


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(member, root) edges that join what is linked among distinct fingerprints; at most one a member."""
    left = np.sort(fps.view(np.uint64))
    out = []
    while len(left):
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            near = np.bitwise_count(left ^ front[0]) <= radius
            front = np.concatenate([front[1:], left[near]])
            out += [(int(x.view(np.int64)), int(root.view(np.int64))) for x in left[near]]
            left = left[~near]
    return out


def near_edges(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(u, v) over distinct fingerprints (fp: long) with the same components as all pairs within radius.

    Buckets of up to block fingerprints are compared inside one task and give a spanning forest.
    Larger ones never meet in a task: their members are linked through the fingerprints one bit
    away, which two fingerprints share exactly if they differ in at most two bits.
    """
    if radius > 2:
        raise ValueError("large buckets are linked exactly for a radius of 2 at most")
    masks = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m - 2**64 if m >= 2**63 else m)).alias("key")) for t, m in enumerate(covering_masks(radius))])
    buckets = distinct.select("fp", F.explode(masks).alias("b")).select("fp", "b.t", "b.key")
    shared = materialise(buckets.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "lsh-buckets")
    small = shared.filter(F.col("n") <= block).select(F.col("t").alias("_t"), F.col("key").alias("_key"))
    members = buckets.join(small, (F.col("t") == F.col("_t")) & (F.col("key") == F.col("_key"))).groupBy("t", "key")
    lists = members.agg(F.collect_list("fp").alias("fps")).select("fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            edges = [e for fps in b.column(0) for e in _forest(fps.values.to_numpy(), radius)]
            u, v = zip(*edges, strict=True) if edges else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    edges = lists.mapInArrow(run, "u long, v long")
    large = shared.filter(F.col("n") > block).select(F.col("t").alias("_t"), F.col("key").alias("_key"))
    if large.limit(1).count():
        hot = buckets.join(large, (F.col("t") == F.col("_t")) & (F.col("key") == F.col("_key"))).select("fp").distinct()
        flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - 2**64 if i == 63 else 1 << i)) for i in range(64)])
        via = hot.select("fp", F.explode(flips).alias("via"))
        first = via.groupBy("via").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1").withColumnRenamed("via", "_via")
        edges = edges.unionByName(via.join(first, F.col("via") == F.col("_via")).filter("fp <> v").select(F.col("fp").alias("u"), "v"))
    return edges


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = 3, with_key: bool = False) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs: the smallest doc_id reachable over links; with_key also (key, root).

    Documents with equal fingerprints are linked, so copies collapse before any bucket is built.
    Null, empty and wordless texts have fingerprint 0, which is linked like any other. Rows
    without an id get the component's smallest id, null if it has none. Very long texts are read
    whole. An empty table gives an empty result; other columns are not read.
    """
    prints = materialise(fingerprints(docs, shingle), "simhash")
    distinct = materialise(prints.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("first")), "simhash-distinct")
    linked = connected_components(near_edges(distinct.select("fp"), radius))
    linked = materialise(linked.join(distinct, F.col("node") == F.col("fp")).select("node", "root", "first"), "simhash-linked")
    ids = linked.groupBy("root").agg(F.min("first").alias("component")).withColumnRenamed("root", "_root")
    linked = linked.join(ids, F.col("root") == F.col("_root")).select("node", "component", "root")
    known = distinct.join(linked, F.col("fp") == F.col("node"), "left").select(
        F.col("fp").alias("_fp"), F.coalesce("component", "first").alias("component"), F.coalesce("root", "fp").alias("root")
    )
    out = prints.join(known, F.col("fp") == F.col("_fp"), "left")
    return out.select("doc_id", "fp", F.when(F.col("component") < NO_ID, F.col("component")).alias("component_id"), *(["key", "root"] if with_key else []))


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of docs for each root in found (doc_id, key, root), where key is the XXH64 of the text.

    That of the smallest id stays, null ids last, of several rows with it the one of the smallest key.
    """
    named = found.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "key", "root")
    first = named.groupBy("root").agg(F.min(F.struct("id", "key")).alias("first")).select("first.id", "first.key")
    # Those who go: few, as most documents have no near copy.
    gone = named.select("id", "key").distinct().join(first, ["id", "key"], "left_anti").select(F.col("id").alias("_id"), F.col("key").alias("_key"))
    key = F.xxhash64(F.coalesce("text", F.lit("\x00")))
    is_gone = (F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) == F.col("_id")) & (key == F.col("_key"))
    kept = docs.join(checked_broadcast(materialise(gone, "simhash-gone")), is_gone, "left_anti")
    twice = named.groupBy("id", "key").count().filter("count > 1").join(first, ["id", "key"])
    if not twice.limit(1).count():
        return kept
    # Of equal rows among those who stay, the first is kept; partial aggregation meets them before any shuffle.
    once = kept.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("_key", key)
    twice = materialise(twice.select("id", "key"), "simhash-twice").select(F.col("id").alias("_id"), F.col("key").alias("_key"))
    alone = once.join(twice, ["_id", "_key"], "left_anti").select(*docs.columns)
    return alone.unionByName(once.join(twice, ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"]).select(*docs.columns))


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of docs for each group of linked fingerprints, columns as they were; see keep_first() for which."""
    found = near_duplicates(docs, radius, with_key=True)
    return keep_first(docs, materialise(found, "simhash-groups"))


def op3_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its fingerprint as 16 hexadecimal digits and its component."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
