"""Document fingerprints by SpotSigs (Theobald, Siddharth and Paepcke, 2008).

A signature is a common word, the anchor, with the content words that follow it. The set of a
text's signatures is its fingerprint, and two fingerprints are as alike as their Jaccard
similarity. Near-duplicates are found among sets of compatible length that share a rare signature.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.llm.common import checked_broadcast, materialise, table

#: Common words of English, French, German and Spanish, after which a chain of content words begins.
ANCHORS = frozenset(
    "the of and to is in that it for a an on with as was be by this are from at or not "
    "de la le les et un une des du en que qui dans est par pour sur pas au il elle avec "
    "der die das und von zu den mit auf für ist im dem ein eine nicht auch sich des es "
    "el los las y se con por una su al lo como del".split()
)
#: Content words of a chain.
CHAIN = 2
_WORDS = re.compile(r"\w+")


def signatures(text: str | None, anchors: frozenset[str] = ANCHORS, chain: int = CHAIN) -> frozenset[int]:
    """32-bit hashes of anchor and following content words, which may be fewer at the end of a text.

    A text without such a chain gets those of its words in turn, as if each followed an anchor; one
    without any word has no signature.
    """
    words = _WORDS.findall((text or "").lower())
    content = [w for w in words if w not in anchors]
    crc, out, at = zlib.crc32, set(), 0
    if content and len(content) < len(words):
        for w in words:
            if w in anchors:
                if at < len(content):
                    out.add(crc(" ".join((w, *content[at : at + chain])).encode("utf-8", "surrogatepass")))
            else:
                at += 1
    if not out:
        out = {crc(" ".join(words[i : i + chain]).encode("utf-8", "surrogatepass")) for i in range(len(words))}
    return frozenset(out)


def likeness(a: frozenset[int], b: frozenset[int], least: float = 0.0) -> float:
    """Jaccard similarity; 1 for two empty sets. Where the lengths alone keep it below least, 0."""
    low, high = sorted((len(a), len(b)))
    if not high:
        return 1.0
    if low < least * high:
        return 0.0
    both = len(a & b)
    return both / (low + high - both)


def fingerprint(sigs: frozenset[int]) -> str:
    """The set in ascending order, eight hexadecimal digits each."""
    return b"".join(s.to_bytes(4, "big") for s in sorted(sigs)).hex()


def edited(text: str, following: str) -> str:
    """text with its last third replaced by as many first characters of following, or all."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(doc_id: int | None, text: str, sigs: frozenset[int], following: str, next_sigs: frozenset[int]) -> tuple:
    new = edited(text, following)
    new_sigs = signatures(new)
    sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    return (doc_id, len(text), sha, fingerprint(sigs), fingerprint(new_sigs), likeness(sigs, new_sigs), likeness(sigs, next_sigs))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_ROW = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64())]
    + [(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    + [("near_edited", pa.float64()), ("near_next", pa.float64())]
)
#: Ranges of ids for each shuffle partition; several, so that hashed ranges fill partitions evenly.
RANGES = 4


def _ranges(rows: DataFrame, n: int) -> DataFrame:
    """rows with a number part of up to n ranges of doc_id, which ascends as ids descend; null ids have one of their own."""
    value = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("nan")))
    cuts = rows.select(F.col("doc_id").cast("double").alias("v")).approxQuantile("v", [k / n for k in range(1, n)], 0.5 / n)
    splits = [-float("inf"), *(sorted(set(cuts)) or [0.0]), float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="_value", outputCol="_range", handleInvalid="keep").transform(rows.withColumn("_value", value))
    last = len(splits) - 2
    part = F.when(F.col("doc_id").isNull(), last + 1).otherwise(last - F.col("_range").cast("int"))
    return ranged.withColumn("part", part).drop("_value", "_range")


def fingerprint_chain(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint beside those of its edited text and of the next row in descending doc_id order.

    After the last row comes the first; null ids are last, and rows with one id are ordered by
    their texts' hash. Null texts are empty, very long ones are read whole, an empty table gives an
    empty result, and columns but doc_id and text are not read, whatever their names. The rows are dealt in ranges of ids and sorted; each
    range also gets the first row of the next, so nothing but these few rows is written on the way.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = _ranges(rows, RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")))
    tops = checked_broadcast(materialise(rows.groupBy("part").agg(F.max("doc_id").alias("_top")), "spot-tops").withColumnRenamed("part", "_part"))
    at_top = rows.join(tops, (F.col("part") == F.col("_part")) & F.col("doc_id").eqNullSafe(F.col("_top")))
    heads = at_top.groupBy("part").agg(F.max("doc_id").alias("doc_id"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first"))
    heads = materialise(heads.select("part", F.struct("doc_id", "first.text").alias("head")), "spot-heads")
    # One row for each range.
    ranges = Window.partitionBy(F.lit(0)).orderBy("part")
    first = F.first("head").over(ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = heads.select("part", F.coalesce(F.lead("head").over(ranges), first).alias("next"))
    ends = ends.select("next.doc_id", "next.text", "part", F.lit(True).alias("end"))
    dealt = rows.withColumn("end", F.lit(False)).unionByName(ends).repartition("part")
    dealt = dealt.sortWithinPartitions("part", "end", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for b in batches:
            out = []
            for d, t, end in zip(*[b.column(k).to_pylist() for k in ("doc_id", "text", "end")], strict=True):
                s = signatures(t)
                if before is not None:
                    out.append(_compare(*before, t, s))
                before = None if end else (d, t, s)
            if out:
                yield _batch(out, _ROW)

    return dealt.select("doc_id", "text", "end").mapInArrow(run, _SCHEMA)


def spot_matches(docs: DataFrame, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(membership, pairs): rows' classes of equal fingerprints, and classes at least so alike.

    membership is (doc_id, class_id), class_id the smallest doc_id with that fingerprint; pairs is
    (a, b, likeness) over classes, a < b. Sets are partitioned by length, such that a set matches
    within its own and the next partition only, and two sets are compared if they share one of the
    rarest signatures of each, which alike sets always do. Texts without signatures form one class.
    A class whose rows have no id has none either, and keeps its pairs, with its side null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [sorted(signatures(t.as_py())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "sigs"])

    sets = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, sigs array<long>")
    sets = materialise(sets, "spot-sets")
    # A class is named by the hash of its set within; ids may be null or shared.
    sets = sets.withColumn("k", F.xxhash64("sigs"))
    classes = materialise(sets.groupBy("sigs", "k").agg(F.min("doc_id").alias("class_id")), "spot-classes")
    names = classes.select(F.col("k").alias("_k"), "class_id")
    membership = sets.join(names, F.col("k") == F.col("_k")).select("doc_id", "class_id")
    n = F.size("sigs")
    ranked = classes.filter(n > 0).select("k", n.alias("n"), F.explode("sigs").alias("sig"))
    df = ranked.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    ranked = ranked.join(df, "sig").groupBy("k", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("by_df"))
    part = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / least))).cast("int")
    prefix = F.slice("by_df", 1, (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int"))
    keyed = ranked.select("k", "n", part.alias("part"), F.explode(prefix.getField("sig")).alias("sig"))
    left = keyed.select(F.col("k").alias("a"), F.col("n").alias("na"), "part", "sig")
    right = keyed.select(F.col("k").alias("b"), F.col("n").alias("nb"), F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"), "sig")
    near = left.join(right, ["part", "sig"]).filter("a <> b").filter(F.least("na", "nb") >= F.greatest("na", "nb") * least - 1e-9)
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    x, y = (classes.select(F.col("k").alias(c), F.col("sigs").alias(f"s{c}"), F.struct(F.col("class_id").isNull().alias("last"), F.col("class_id").alias("id")).alias(f"i{c}")) for c in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    alike = both / (F.size("sa") + F.size("sb") - both)
    pairs = near.join(x, "a").join(y, "b").select(F.least("ia", "ib")["id"].alias("a"), F.greatest("ia", "ib")["id"].alias("b"), alike.alias("likeness"))
    return membership, pairs.filter(F.col("likeness") >= least - 1e-12)


def op8_spotsigs_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and how alike they and the next one's are."""
    return fingerprint_chain(table(spark, sf_dir, "documents"))
