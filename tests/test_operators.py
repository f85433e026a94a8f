"""Operators on hand-made cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pairloom.functions import geo, temporal, text
from pairloom.operators import blocking, compare, graph, queue, scoring, store, sync
from pairloom.sources import entities
from pairloom.streaming import limits


def one(spark, *cols):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_normalize_and_key(spark):
    got = one(spark, text.normalize(F.lit("  HTTPS://www.Ex.org/a//  ")), text.normalize(F.lit("It’s  A")), text.blocking_key(F.lit("A -- b!")), text.blocking_key(F.lit("--")))
    assert got == ["ex.org/a", "it's a", "a b", None]


def test_similarity_is_edit_distance(spark):
    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    r = random.Random(7)
    pairs = [("".join(r.choice("abé ") for _ in range(r.randint(1, 8))), "".join(r.choice("abé ") for _ in range(r.randint(1, 8)))) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for a, b, s in df.select("a", "b", text.similarity(F.col("a"), F.col("b"))).collect():
        assert s == pytest.approx(1 - lev(a, b) / max(len(a), len(b)))


def test_titles_phones_urls(spark):
    i = one(spark, text.installment(F.lit("Quest IV")), text.installment(F.lit("Quest (1999)")), text.installment(F.lit("Quest 2")))
    assert [tuple(x) for x in i] == [("Quest", 4), ("Quest (1999)", None), ("Quest", 2)]
    assert one(spark, text.same_phone(F.lit("+49 (0)30 1234567"), F.lit("030 1234567")), text.is_slug_split(F.lit("a-1"), F.lit("a-2"))) == [True, True]
    assert one(spark, text.compare_urls(F.lit("http://a.b/"), F.lit("https://a.b")), text.compare_urls(F.lit("https://doi.org/10.1/x"), F.lit("http://dx.doi.org/10.1/X"))) == ["identical", "similar"]


def test_times(spark):
    t = lambda a, b: temporal.compare_calendar(F.lit(a), F.lit(b))
    assert one(spark, t("+1977-00-00", "+1977-05-02"), t("+1977-05-01", "+1978-05-01"), t("2019", "2019-03"), temporal.at_precision(F.lit("+1977-05-02T"), F.lit(10))) == [
        "similar: precision", "distinct", "similar", "+1977-05-00T"]
    span = lambda y, p: temporal.coarse_range(F.lit(y), F.lit(p))
    assert [tuple(x) for x in one(spark, span(1950, 7), span(1955, 8), span(-50, 7))] == [(1901, 2000), (1950, 1959), (-100, -1)]


def test_places(spark):
    p = lambda a, b, g="earth": F.array(F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon"), F.lit(g).alias("globe")))
    a, b = one(spark, geo.nearest(p(0.0, 0.0), p(0.0, 1.0)), geo.nearest(p(0.0, 0.0), p(0.0, 1.0, "moon")))
    assert a == pytest.approx(111194.9, abs=1) and b is None


def test_blocking_caps_before_it_expands(spark):
    df = spark.createDataFrame([(i, "a" if i < 30 else "b" if i < 33 else None) for i in range(40)], "id long, k string")
    assert {tuple(r) for r in blocking.pairs(df, ["k"], "id", 10).collect()} == {(30, 31), (30, 32), (31, 32)}
    assert [tuple(r) for r in blocking.oversized(df, ["k"], "id", 10).collect()] == [("a", 30)]


def test_set_status(spark):
    a = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    s = lambda x, y: compare.compare_sets(x, y)
    assert one(spark, s(a("x"), a("x")), s(a(), a()), s(a("x"), a()), s(a("abcd"), a("abce")), s(a("x"), a("y"))) == ["identical", "identical", "one-sided", "similar", "distinct"]


def test_the_fold_keeps_its_order(spark):
    steps = [scoring.Step("weight", "w", 0.9, F.lit(True)), scoring.Step("cap", "c", 0.1, F.lit(True)), scoring.Step("weight", "v", 0.3, F.lit(True)), scoring.Step("cap", "null", 0.0, F.lit(None).cast("boolean"))]
    r = scoring.fold(spark.range(1), steps, trace=True).first()
    assert (r.confidence, r.reasons, list(r.trace)) == (0.4, "c; w; v", [0.9, 0.1, 0.4, 0.4])


def test_valve_and_empty_scan(spark):
    s = spark.createDataFrame([(i + 100, i, 0.5, "x", "open") for i in range(8)], "merged_from long, merged_into long, confidence double, reasons string, status string")
    none = spark.createDataFrame([], "a long, b long")
    some = spark.createDataFrame([(0, 100)], "a long, b long")
    assert store.prune_orphans(s, none).count() == 8
    assert store.prune_orphans(s, some, store.Valve(3, 0.5)).count() == 8
    assert store.prune_orphans(s, some, store.Valve(3, 0.5), force=True).count() == 1
    with pytest.raises(ValueError, match="refusing"):
        sync.prune_missing(s, s.limit(1), "merged_from")


def test_upsert_leaves_protected_rows(spark):
    cols = "merged_from long, merged_into long, confidence double, reasons string"
    old = spark.createDataFrame([(2, 1, 0.5, "o", "merged"), (3, 1, 0.5, "o", "open")], cols + ", status string")
    new = spark.createDataFrame([(2, 1, 0.9, "n"), (3, 1, 0.8, "n"), (4, 1, 0.7, "n")], cols)
    got = {tuple(r) for r in store.upsert(old, new).collect()}
    assert got == {(2, 1, 0.5, "o", "merged"), (3, 1, 0.8, "n", "open"), (4, 1, 0.7, "n", "open")}


def test_closure_with_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "src string, dst string")
    got = {tuple(r) for r in graph.closure(e).collect()}
    assert got == {(x, y) for x in "abc" for y in "abc" if x != y} | {("d", y) for y in "abc"}


def test_page_bounds_and_paging(spark):
    df = spark.range(1, 1001).withColumn("v", F.col("id") % 7)
    assert sorted(tuple(r) for r in queue.page_bounds(df, "id", 300).collect()) == [(1, 300), (2, 600), (3, 900)]
    page, hits = queue.list_rows(df, sort="v", id_="id", floor=("v", float("nan")), size=3)
    assert [r.id for r in page.collect()] == [1000 - 1, 992, 985] or hits.count() == 1000


def test_rate_limit_does_not_count_refusals(spark):
    df = spark.createDataFrame([(i, "u", s) for i, s in enumerate([0, 10, 20, 59, 61, 62])], "id long, k string, s long")
    df = df.withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: r.allowed for r in limits.rate_limit(df, "k", "ts", "id", 2, 60).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True, 5: False}


def test_stream_gives_each_delivery_once(spark, tmp_path):
    src = tmp_path / "in"
    rows = spark.createDataFrame([(1, 0), (1, 5), (2, 7)], "id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    rows.write.parquet(str(src))
    stream = spark.readStream.schema(rows.schema).parquet(str(src))
    q = limits.first_delivery(stream, "id", "ts").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.id for r in spark.sql("SELECT id FROM once").collect()) == [1, 2]


def _entity(id_, cls, rev=1, **more):
    snak = {"snaktype": "value", "property": "P31", "datatype": "wikibase-item", "datavalue": {"type": "wikibase-entityid", "value": {"id": cls, "numeric-id": int(cls[1:])}}}
    ext = lambda v, rank: {"rank": rank, "mainsnak": {"snaktype": "value", "property": "P9", "datatype": "external-id", "datavalue": {"type": "string", "value": v}}}
    claims = {"P31": [{"rank": "normal", "mainsnak": snak}], "P9": [ext("low", "normal"), ext("top", "preferred"), ext("bad", "deprecated")]}
    labels = {"de": {"language": "de", "value": "Name"}}
    return json.dumps({"type": "item", "id": id_, "lastrevid": rev, "labels": labels, "claims": claims, **more}, separators=(",", ":"))


def test_dump_scan(spark, tmp_path):
    f = tmp_path / "dump.json"
    f.write_text("[\n" + ",\n".join([_entity("Q1", "Q5"), _entity("Q2", "Q55"), _entity("Q3", "Q5", 7), '{"numeric-id":5,oops']) + "\n]")
    known = spark.createDataFrame([("Q3", 7)], "id string, lastrevid long")
    good, bad = entities.split_bad(entities.scan(spark, str(f), ["Q5"], known))
    items = entities.of_class(entities.to_items(good), ["Q5"])
    assert [tuple(r) for r in items.select("id", "primary_type", "primary_label").collect()] == [("Q1", "Q5", "Name")]
    assert [tuple(r) for r in entities.external_ids(items).collect()] == [("Q1", "P9", "top")]
    assert [tuple(r) for r in entities.item_values(items, ["P31"]).collect()] == [("Q1", "P31", "Q5")]
    assert bad.count() == 1
    with pytest.raises(ValueError):
        entities.split_bad(entities.scan(spark, str(f), ["Q5"]), 0)


def test_scratch(spark, monkeypatch, tmp_path):
    from pairloom.sources import scratch

    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda k, d: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(ValueError, match="share"):
        scratch.scratch_dir(Elsewhere)
    monkeypatch.setattr(scratch, "scratch_dir", lambda s: f"file://{tmp_path}/own")
    assert scratch.written(spark.range(3), "x").count() == 3 and list((tmp_path / "own").iterdir())
    scratch.drop_scratch(spark)
    assert not (tmp_path / "own").exists()
