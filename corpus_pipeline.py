"""A training corpus from documents, in five stages.

Low-quality texts go, then near-duplicates but one of each group, then documents with benchmark
items; what is left is mixed to the sources' target weights and written as token files. Every stage
is written as Parquet and read again as the next one's docs. Rows of a null text count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairloom.llm.common import materialise, table
from pairloom.llm.decontaminate import drop_contaminated
from pairloom.llm.mixing import mix_sources
from pairloom.llm.quality import fit_quality, keep_good
from pairloom.llm.similar import drop_similar
from pairloom.llm.tokenfiles import round_trip


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, fitted on the labelled ones among them, does not reject."""
    return keep_good(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that shares 0.8 or more of its five-word shingles."""
    return drop_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that contain no benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix_sources(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the mix, from the token files."""
    return round_trip(docs, "corpus-tokens")


STAGES = [("quality", quality), ("near-dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]
#: SQL can express neither the classifier nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from the documents in sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{name}")
    return docs
