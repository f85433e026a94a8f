"""The pipeline against its stages' own brute-force meanings."""

import random

import numpy as np

from pairloom.llm.common import materialise, table

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    import corpus_pipeline as p

    docs, seen = table(spark, SF, "documents"), []
    for k, (name, stage) in enumerate(p.STAGES):
        before = docs
        docs = materialise(stage(spark, docs, SF), f"test-{k}")
        seen.append((name, before.count(), docs.count()))
        if k < len(p.STAGES) - 1:
            assert docs.columns == before.columns
    assert seen[0][2] < seen[0][1] and seen[1][2] < seen[1][1] and seen[2][2] < seen[2][1] and seen[4][1] == seen[4][2]
    got = docs.orderBy("start").collect()
    assert got[0].start == 0 and all(a.start + a.n_tokens == b.start and a.doc_id <= b.doc_id for a, b in zip(got, got[1:], strict=False))


def _five(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_dedup_equals_brute_force(spark):
    import corpus_pipeline as p

    r = random.Random(3)
    docs = table(spark, SF, "documents")
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    more = []
    for i in range(40):
        words = list(base)
        for _ in range(1 + i % 8):
            words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
        more.append((10**6 + i, " ".join(words), "en", "a", 1))
    both = docs.unionByName(spark.createDataFrame(more, docs.schema))
    sets = {x.doc_id: _five(x.text) for x in both.select("doc_id", "text").collect()}
    root = {i: i for i in sets}
    alike = [(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))]
    for _ in root:
        for a, b in alike:
            root[a] = root[b] = min(root[a], root[b])
    assert {x.doc_id for x in p.near_dedup(spark, both, SF).collect()} == {i for i in sets if root[i] == i}
    assert any(a >= 10**6 and root[a] == root[b] for a, b in alike)


def test_large_buckets_lose_no_link(spark):
    from pairloom.llm.components import connected_components
    from pairloom.llm.similar import jaccard, links, shingle_set, similar_edges

    r = random.Random(8)
    texts = []
    for _ in range(60):  # sixty texts and an edited copy of each, all in one bucket: a representative meets one of them
        words = [f"w{r.randrange(10**6)}" for _ in range(60)]
        texts += [" ".join(words), " ".join(words[:58] + ["x", "y"])]
    hub = [f"v{r.randrange(10**6)}" for _ in range(60)]
    texts += [" ".join(hub[:k] + [f"x{r.randrange(10**6)}"] + hub[k + 1 :]) for k in range(5, 45)]
    sets = [shingle_set(t) for t in texts]
    alike = [(a, b) for a in range(len(sets)) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8]
    root = list(range(len(sets)))
    for _ in root:
        for a, b in alike:
            root[a] = root[b] = min(root[a], root[b])
    distinct = spark.createDataFrame([(i, [7, i], t) for i, t in enumerate(texts)], "node long, bands array<long>, text string")
    for block in (1 << 19, 4000):  # one block, three
        got = {x.node: x.root for x in connected_components(similar_edges(distinct, block=block)).collect()}
        assert [got.get(i, i) for i in range(len(root))] == root
    assert len(set(root)) <= 100 and links(np.arange(3), [sets[0], sets[2], sets[1]], 0.8) == [(2, 0)]


def test_workers_give_memory_back():
    import subprocess
    import sys

    code = """
import re
import numpy as np, pyarrow as pa
from pairloom.llm import quality, tokenfiles

class Docs:
    columns, schema = ["text"], None
    def mapInArrow(self, run, schema):
        return run

class Model:
    def score(self, text):
        some = [np.ones(100_000, np.uint8) for _ in range(600)]
        Model.last = np.ones(100_000, np.uint8)  # beyond them, so that what is freed is not at the heap's end
        return 1.0

def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

tokenfiles.keep_freed_memory()  # as in a worker that has had the tokens stage
run, before = quality.keep_good(Docs(), Model()), held()
assert [b.num_rows for b in run(iter([pa.record_batch([["a", "b"]], ["text"])]))] == [2]
print(held() - before)
"""
    took = float(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=__import__("pathlib").Path(__file__).parents[2]).stdout)
    assert took < 40  # of 57 MB and what else a process takes; 79 when they were kept


def test_driver_gives_memory_back(spark):
    import re

    from pairloom.llm.components import connected_components
    from pairloom.llm.quality import QualityModel

    jvm = spark.sparkContext._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    unsafe = jvm.java.lang.Class.forName("sun.misc.Unsafe").getDeclaredField("theUnsafe")
    unsafe.setAccessible(True)
    unsafe = unsafe.get(None)

    def held():
        with open(f"/proc/{pid}/smaps_rollup") as f:
            return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", f.read()))) / 1024

    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "u long, v long")
    want = {1: 1, 2: 1, 3: 1, 5: 5, 6: 5}
    assert {x.node: x.root for x in connected_components(edges).collect()} == want
    some = [unsafe.allocateMemory(100_000) for _ in range(4000)]
    for x in some:
        unsafe.setMemory(x, 100_000, 1)
    for x in some[:-1]:  # the last one stays, so that what is freed is not at the heap's end
        unsafe.freeMemory(x)
    before = held()
    assert {x.node: x.root for x in connected_components(edges).collect()} == want
    unsafe.freeMemory(some[-1])
    assert before - held() > 150  # of 381 MB that the JVM has freed
    assert QualityModel([(i, f"good words {i}" if i % 2 else f"bad text {i}", i % 2) for i in range(60)])._read is None


def test_few_gone_rows_do_not_shuffle_texts(spark):
    from pairloom.llm.simhash import keep_first

    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    found = docs.selectExpr("doc_id", "xxhash64(text) AS key", "xxhash64(text) AS root")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = keep_first(docs, found)
        assert "BroadcastHashJoin" in kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
