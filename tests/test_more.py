"""The smaller operators on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from pairloom.functions import geo, temporal, text
from pairloom.operators import compare, graph, queue, review, sync
from pairloom.sources import entities
from pairloom.streaming import limits


def one(spark, *cols):
    row = spark.range(1).select(*[c.alias(f"c{n}") for n, c in enumerate(cols)]).first()
    return row[0] if len(cols) == 1 else tuple(row)


def ints(*v):
    return F.array(*map(F.lit, v)) if v else F.array().cast("array<int>")


def strings(*v):
    return F.array(*map(F.lit, v)) if v else F.array().cast("array<string>")


def test_years_times_places(spark):
    assert one(spark, temporal.closest_gap(ints(1950, 1990), ints(1953, 2000)), temporal.closest_gap(ints(), ints(1))) == (3, None)
    got = one(spark, *[temporal.timestamp_text(F.lit(x)) for x in ("20240102030405", "2024-01-02T03:04:05Z", "2024-01-02 03:04:05.25", "2024", "x")])
    assert got == ("2024-01-02 03:04:05",) * 3 + (None, None)
    lat, lon = F.lit(1.5), F.lit(-2.0)
    assert one(spark, geo.coordinate_text(lat, lon, F.lit(None)), geo.coordinate_text(lat, lon, F.lit("moon")), geo.coordinate_text(F.lit(None).cast("double"), lon, F.lit(None))) == ("1.5,-2.0", "1.5,-2.0,moon", None)
    assert one(spark, geo.known_precision(F.lit(0.0)), geo.known_precision(F.lit(0.1))) == (None, 0.1)


def test_text_and_arrays(spark):
    assert one(spark, text.encode_languages(strings("es", "de", "de")), text.encode_languages(strings())) == (",de,es", "")
    assert one(spark, text.normalize_languages(strings(" DE", "en", "de", "x", "zh-hant", "a b"))) == ["de", "en", "zh-hant"]
    assert one(spark, text.normalize_user_name(F.lit("_some__user ")), text.normalize_user_name(F.lit("_"))) == ("Some user", None)
    m = lambda *kv: F.create_map(*map(F.lit, kv))
    assert one(spark, text.canonical_json(m("b", 1, "a", 2)) == text.canonical_json(m("a", 2, "b", 1)))
    assert one(spark, text.disjoint(ints(1), ints(2)), text.disjoint(ints(1), ints()), text.disjoint(ints(1, 2), ints(2))) == (True, False, False)
    assert one(spark, text.one_within_other(ints(1), ints(1, 2)), text.one_within_other(ints(1, 3), ints(1, 2))) == (True, False)
    assert one(spark, text.name_within_name(strings("Ann Lee"), strings("Lee")), text.name_within_name(strings("Ann"), strings("Bob"))) == (True, False)
    assert one(spark, text.chunks(strings("a", "b", "c"), 2), text.chunks(strings(), 2)) == ([["a", "b"], ["c"]], [])


def test_queue_filters(spark):
    rows = spark.createDataFrame([(1, 10, 20, True, "2024-01-10"), (2, 11, 21, False, "2024-01-01"), (3, 12, 22, False, None)], "id long, a long, b long, blocked boolean, checked string").withColumn("checked", F.to_timestamp("checked"))
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(queue.without_blockers(rows, "blocked", True)) == [2, 3] and ids(queue.without_blockers(rows, "blocked", False)) == [1, 2, 3]
    made = spark.createDataFrame([(10, "x"), (22, "x"), (22, "x"), (21, "y")], "id long, user_name string")
    assert ids(queue.by_creator(rows, ["a", "b"], made, "x")) == [1, 3] and queue.by_creator(rows, ["a", "b"], made, "z").count() == 0
    assert ids(queue.fresh(rows, "checked", F.lit("2024-01-12").cast("timestamp"), 7)) == [1]
    assert ids(queue.among(rows, spark.createDataFrame([(10, 20), (11, 99)], "a long, b long"), ["a", "b"])) == [1]
    props = spark.createDataFrame([("P1", "ExternalId"), ("P2", "String")], "pid string, datatype string")
    values = spark.createDataFrame([("P1",), ("P2",), ("P3",)], "property string")
    assert [r[0] for r in queue.identifiers_only(values, props).collect()] == ["P1"] and queue.identifiers_only(values, props.limit(0)).count() == 3
    flags = lambda *v: F.array(*[F.lit(x).cast("boolean") for x in v])
    assert one(spark, queue.inapplicable(flags(False, False)), queue.inapplicable(flags(False, None)), queue.inapplicable(flags(False, True)), queue.inapplicable(F.array().cast("array<boolean>"))) == (True, False, False, False)


def test_queue_sums_and_order(spark):
    board = spark.createDataFrame([(1, 2), (3, 4)], "merges long, verdicts long")
    assert tuple(queue.totals(board, ["merges", "verdicts"]).first()) == (4, 6) and tuple(queue.totals(board.limit(0), ["merges"]).first()) == (0,)
    seg = spark.createDataFrame([("t", True, 5), (None, None, None)], "done_at string, failed boolean, matched long")
    assert tuple(queue.progress(seg).first()) == (1, 1, 5) and tuple(queue.progress(seg.limit(0)).first()) == (0, 0, 0)
    edits = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 1, "c")], "item long, id long, who string")
    assert sorted(map(tuple, queue.latest(edits, "item", "id", ["id", "who"]).collect())) == [(1, 7, "b"), (2, 1, "c")]
    assert one(spark, queue.by_strength(strings("a", "b", "c"), F.array(F.lit(1.0), F.lit(3.0), F.lit(1.0)))) == ["b", "a", "c"]
    fields = spark.createDataFrame([(True, 0, "P1"), (False, 1, "P10"), (False, 1, "P9"), (False, 0, "P99")], "d boolean, t long, p string")
    assert [r.p for r in queue.display_order(fields, "d", "t", "p").collect()] == ["P99", "P9", "P10", "P1"]
    items = spark.createDataFrame([(1, "one", "T"), (2, "two", "T"), (3, None, "U")], "id long, label string, type string")
    cand = spark.createDataFrame([(2, 1), (3, 1), (9, 1)], "merged_from long, merged_into long")
    got = {r.merged_from: (r.from_label, r.into_label, r.shared_type) for r in queue.summary(cand, items).collect()}
    assert got == {2: ("two", "one", "T"), 3: (None, "one", None), 9: (None, "one", None)}
    clash = spark.createDataFrame([("Q1", "enwiki", "A"), ("Q1", "dewiki", "B"), ("Q2", "enwiki", "C")], "id string, wiki string, title string")
    pages = spark.createDataFrame([("enwiki", "A", True, "Z"), ("dewiki", "B", True, None), ("enwiki", "C", False, None)], "wiki string, title string, is_redirect boolean, target string")
    assert {r.id: r.redirects for r in queue.redirect_overlay(clash, pages).collect()} == {"Q1": {"dewiki": None, "enwiki": "Z"}}


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_neighbours_across_ranges(spark, parts):
    rows = [(i, None if i % 3 == 0 else "ab"[i % 2], i * 7 % 11) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, g string, s long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.id: (r.prev_id, r.next_id) for r in queue.neighbours(df, ["g"], "s", "id").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {}
    for g in {r[1] for r in rows}:
        own = [r[0] for r in sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], -r[0]))]
        want |= {i: (a, b) for a, i, b in zip([None, *own], own, [*own[1:], None])}
    assert got == want


def test_reviews(spark):
    cand = spark.createDataFrame([(9, 1, "open"), (8, 2, "open"), (7, 3, "merged"), (6, 4, "open")], "merged_from long, merged_into long, status string")
    r = spark.createDataFrame(
        [(1, 9, "first", "done", "different", 0.3), (2, 8, "first", "done", "different", 0.2), (2, 8, "confirm", "done", "different", 0.01), (3, 7, "first", "done", "different", 0.4), (4, 6, "first", "done", "different", 0.05)],
        "low long, high long, stage string, outcome string, verdict string, probability double",
    )
    assert [tuple(x) for x in review.confirm_picks(cand, r).collect()] == [(1, 9, 0.3)]
    done = spark.createDataFrame([("s", 2.0, 10), ("s", 1.0, 1), ("t", 4.0, 12)], "stage string, cost double, day long")
    pending = spark.createDataFrame([("s",), ("s",), ("u",)], "stage string")
    expected = spark.createDataFrame([("s", 0.5), ("u", 0.25)], "stage string, expected double")
    assert dict(map(tuple, review.month_spend(done, pending, expected, "stage", "cost", "day", F.lit(5)).collect())) == {"s": 3.0, "t": 4.0, "u": 0.25}
    assert {tuple(x) for x in review.outcome_counts(r, "stage", "verdict", ["same", "different"]).collect()} == {("first", 0, 4), ("confirm", 0, 1)}
    assert dict(map(tuple, review.oldest(done, "stage", "day").collect())) == {"s": 1, "t": 12}
    flags = lambda *v: [F.lit(x) for x in v]
    cases = [((False, 90, False, False, False), "never submitted"), ((False, 5, False, False, False), "pending"), ((True, 5, False, False, False), "batch not found"),
             ((True, 5, True, False, False), "results gone"), ((True, 5, True, True, False), "no result"), ((True, 5, True, True, True), "ok")]
    for args, want in cases:
        assert one(spark, review.failure(*flags(*args))) == want


def test_closures_and_counts(spark):
    closure = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "k string, up string")
    got = sync.replace_closure(closure, spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a", "w")], "k string, up string"), "k")
    assert sorted(map(tuple, got.collect())) == [("a", "w"), ("c", "z")]
    events = spark.createDataFrame([(1, "a"), (30, "a"), (70, "b")], "s long, kind string").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted((r.kind, r.n) for r in limits.windowed_counts(events, "ts", "kind").collect()) == [("a", 2), ("b", 1)]


VALUE = "struct<type:string,value:string,unit:string,globe:string,latitude:double,longitude:double,time_precision:int>"


def value(type_, text_="", unit=None, globe=None, lat=None, lon=None, precision=None):
    return F.struct(*[F.lit(v).alias(n) for n, v in zip(("type", "value", "unit", "globe", "latitude", "longitude", "time_precision"), (type_, text_, unit, globe, lat, lon, precision))]).cast(VALUE)


@pytest.mark.parametrize("a,b,kw,want", [
    (("item", "Q1"), ("string", "Q1"), {}, "distinct"), (("somevalue",), ("somevalue",), {}, "distinct"), (("novalue",), ("novalue",), {}, "identical"),
    (("quantity", "5", "Q1"), ("quantity", "5", "Q2"), {}, "distinct"), (("quantity", "5"), ("quantity", "5"), {}, "identical"), (("quantity", "5"), ("quantity", "6"), {}, "distinct"),
    (("coordinate", "1,1", None, "Q405", 1.0, 1.0), ("coordinate", "1,1", None, None, 1.0, 1.0), {}, "distinct"),
    (("coordinate", "1,1", None, None, 1.0, 1.0), ("coordinate", "1.001,1", None, None, 1.001, 1.0), {}, "similar"),
    (("coordinate", "1,1", None, None, 1.0, 1.0), ("coordinate", "1.01,1", None, None, 1.01, 1.0), {}, "distinct"),
    (("time", "+1950-00-00T00:00:00Z", None, None, None, None, 8), ("time", "+1955-03-00T00:00:00Z"), {}, "similar"),
    (("time", "+1950-00-00T00:00:00Z", None, None, None, None, 8), ("time", "+1962-00-00T00:00:00Z"), {}, "distinct"),
    (("time", "+1950-01-00T00:00:00Z"), ("time", "+1950-02-00T00:00:00Z"), {}, "similar"), (("item", "Q1"), ("item", "Q2"), {}, "distinct"),
    (("item", "Q1"), ("item", "Q2"), {"level": "local"}, "similar"), (("item", "Q1"), ("item", "Q2"), {"labels": ("North Hill", "north hills")}, "similar"),
    (("item", "Q1"), ("item", "Q2"), {"labels": ("male", "female"), "pid": "P21"}, "distinct"), (("external-id", "a"), ("external-id", "A"), {}, "distinct"),
    (("url", "http://a.org/x"), ("url", "https://a.org/x/"), {}, "identical"), (("string", "+49 (0)30 1234567"), ("string", "0049 30 1234567"), {"pid": "P1329"}, "identical"),
    (("string", "North Hill"), ("string", "north hill"), {}, "similar"), (("string", "abc"), ("string", "xyz"), {}, "distinct"),
])
def test_value_status(spark, a, b, kw, want):
    given = {k: tuple(map(F.lit, v)) if isinstance(v, tuple) else F.lit(v) for k, v in kw.items()}
    assert one(spark, compare.value_status(value(*a), value(*b), **given)) == want


def test_broad_matches(spark):
    def place(x, y):
        wide = (x == 9) | (y == 9)
        return F.struct(F.when(x == y, 2).when(wide | (F.abs(x - y) == 1), 1).otherwise(0).alias("rank"), (wide & (x != y)).alias("broad"))

    places = lambda a, b: one(spark, compare.compare_places(ints(*a), ints(*b), place))
    assert [places([1], [1]), places([5], [6]), places([1, 3], [9]), places([], [1]), places([1], [4])] == ["identical", "similar", "similar", "one-sided", "distinct"]
    assert places([1, 9], [4]) == "distinct" and places([1, 2], [2, 9]) == "similar" and places([], []) == "identical"


SNAK = "struct<snaktype:string,property:string,datatype:string,datavalue:struct<type:string,value:string>>"


def test_statement_values_carry_unit_globe_precision(spark):
    import json

    def snak(kind, v):
        return F.from_json(F.lit(json.dumps({"snaktype": "value", "property": "P1", "datatype": kind, "datavalue": {"type": kind, "value": json.dumps(v)}})), SNAK)

    q = one(spark, entities.snak_value(snak("quantity", {"amount": "+5", "unit": "http://x/entity/Q11573"})))
    assert (q.type, q.value, q.unit) == ("quantity", "5", "Q11573") and one(spark, entities.snak_value(snak("quantity", {"amount": "5", "unit": "1"}))).unit is None
    c = one(spark, entities.snak_value(snak("globecoordinate", {"latitude": 1.5, "longitude": 2, "globe": "http://x/entity/Q405"})))
    assert (c.value, c.globe, c.latitude, c.longitude) == ("1.5,2.0,Q405", "Q405", 1.5, 2.0)
    assert one(spark, entities.snak_value(snak("globecoordinate", {"latitude": 1.5, "longitude": 2, "globe": "http://x/entity/Q2"}))).value == "1.5,2.0"
    t = one(spark, entities.snak_value(snak("time", {"time": "+1950-07-01T00:00:00Z", "precision": 8})))
    assert (t.value, t.time_precision) == ("+1950-00-00T00:00:00Z", 8) and one(spark, entities.snak_value(snak("time", {"time": "+1950-07-01T00:00:00Z", "precision": 11}))).time_precision is None


def test_items_and_properties(spark):
    v = "map<string,array<struct<type:string,value:string>>>"
    rows = [("Q1", {"P31": [("item", "Q5")]}), ("Q2", {"P31": [("item", "Q5")]}), ("Q3", {"P31": [("item", "Q5")], "P106": [("item", "Q9")]}), ("Q4", {"P31": [("item", "Q5")], "P700": [("external-id", "x")]}), ("Q6", {"P31": [("item", "Q7")], "P50": [("item", "Q1")]})]
    items = spark.createDataFrame(rows, f"id string, statements {v}")
    linked = graph.linked(items.filter("id = 'Q6'"))
    assert sorted(r.id for r in linked.collect()) == ["Q1", "Q7"]
    assert sorted(r.id for r in entities.selective(items, ["Q5"], linked, ["Q9"], ["P700"]).collect()) == ["Q1", "Q3", "Q4", "Q6"]
    got = items.select("id", graph.cross_references(F.col("statements"), F.lit("Q1"), ["P31"]).alias("x")).filter("id = 'Q6'").first().x
    assert got == ["P50"] and items.select(graph.cross_references(F.col("statements"), F.lit("Q5"), ["P31"]).alias("x")).first().x == []
    sync_ = spark.createDataFrame([("Q1", 5, "old"), ("Q2", 6, "old")], "id string, lastrevid long, stamp string")
    assert sorted(map(tuple, entities.restamp(sync_, spark.createDataFrame([("Q1", 5), ("Q2", 9)], "id string, lastrevid long"), "new").select("id", "stamp").collect())) == [("Q1", "new"), ("Q2", "old")]


def test_property_entities(spark, tmp_path):
    import json

    text_ = lambda v: {"en": {"language": "en", "value": v}}
    claim = [{"mainsnak": {"snaktype": "value", "property": "P1630", "datatype": "string", "datavalue": {"type": "string", "value": "https://x/$1"}}, "rank": "normal"}]
    lines = [{"type": "property", "id": "P1", "datatype": "external-id", "labels": text_("one"), "claims": {"P1630": claim}}, {"type": "property", "id": "P2", "datatype": "string", "labels": {}, "claims": {}}, {"type": "item", "id": "Q1", "lastrevid": 1, "labels": text_("x"), "claims": {}}]
    (tmp_path / "dump.json").write_text("[\n" + ",\n".join(json.dumps(x, separators=(",", ":")) for x in lines) + "\n]\n")
    got = entities.property_rows(entities.scan(spark, str(tmp_path / "dump.json")))
    assert [tuple(r) for r in got.collect()] == [("P1", "one", "external-id", "https://x/$1")]
    assert entities.scan(spark, str(tmp_path / "dump.json"), limit=1).count() == 1
