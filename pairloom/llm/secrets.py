"""Secret scans through a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean trigram query is derived on the driver: an OR of
clauses, each an AND of trigrams that every match must contain. The index holds one posting per
document and trigram that any rule asks for; intersecting the postings of a clause gives its
candidates, and only those texts are searched with the expression. A rule without mandatory
trigrams is searched for in every text.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass
from re import _constants as _k
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import doc_key, materialise, table, text_or_empty

#: Larger sets of strings are given up and only the trigrams they contain are kept.
_MAX_SET = 64


@dataclass(frozen=True)
class Rule:
    """pattern is read alike by Java, RE2 and Python; a match counts if its group has min_len characters."""

    kind: str
    pattern: str
    group: int = 0
    min_len: int = 1
    base: bool = True


#: In the order in which spans that start together are listed. The last two are the method's own additions.
RULES = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        min_len=8,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", min_len=16),
    Rule("hex", r"[0-9a-f]{32,}", min_len=32),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", base=False),
)


def _strings(items) -> tuple[set[str] | None, list[set[frozenset[str]]]]:
    """The exact lower-case strings that a parsed sequence can match (None: too many), and the queries that its parts imply."""
    exact: set[str] = {""}
    needs: list[set[frozenset[str]]] = []

    def settle() -> None:
        nonlocal exact
        if clause := _query_of(exact):
            needs.append(clause)
        exact = {""}

    for op, arg in items:
        part: set[str] | None
        inner: list[set[frozenset[str]]] = []
        if op is _k.LITERAL:
            part = {chr(arg).lower()}
        elif op is _k.IN:
            chars = {chr(v).lower() for o, v in arg if o is _k.LITERAL}
            part = chars if len(chars) <= 8 and all(o is _k.LITERAL for o, _ in arg) else None
        elif op is _k.SUBPATTERN:
            part, inner = _strings(arg[-1])
        elif op is _k.BRANCH:
            each = [_strings(x) for x in arg[1]]
            part = set().union(*[e for e, _ in each]) if all(e is not None for e, _ in each) else None
            if part is None:
                clauses = [_all_of([*n, *([q] if e and (q := _query_of(e)) else [])]) for e, n in each]
                inner = [set().union(*clauses)] if all(clauses) else []
        elif op is _k.MAX_REPEAT:
            low, high, sub = arg
            one, inner = _strings(sub)
            if (low, high) == (0, 1):
                part, inner = (one | {""} if one is not None else None), []
            elif low == high and one is not None and low <= 4 and len(one) ** low <= _MAX_SET:
                part = {"".join(x) for x in itertools.product(one, repeat=low)}
            else:  # once at least, so what one round needs holds
                part, inner = None, [*inner, *([_query_of(one)] if one else [])] if low else []
        else:
            part = {""} if op is _k.AT else None
        needs += inner
        if part is None or len(part) * len(exact) > _MAX_SET:
            settle()
            known = False
            exact = {""} if part is None else part
        else:
            exact = {a + b for a, b in itertools.product(exact, part)}
            known = True
        if part is None or not known:
            needs.append(set())  # marks that the sequence is no longer exact
    if needs:
        settle()
        return None, [n for n in needs if n]
    return exact, []


def _query_of(strings: set[str]) -> set[frozenset[str]]:
    """The clauses of a set of alternatives; empty if one of them has no trigram."""
    clauses = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return set() if frozenset() in clauses else clauses


def _all_of(queries: list[set[frozenset[str]]]) -> set[frozenset[str]]:
    out = {frozenset()}
    for q in queries:
        if len(out) * len(q) <= _MAX_SET:
            out = {a | b for a, b in itertools.product(out, q)}
    return out - {frozenset()}


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """An OR of ANDs of lower-case trigrams that every match of pattern contains; empty: nothing is mandatory."""
    # Java and RE2 scope flags as Python does; the query is over lower-cased text, so case may be dropped.
    exact, needs = _strings(_parser.parse(pattern))
    found = _query_of(exact) if exact is not None else _all_of(needs)
    return sorted((c for c in found if not any(o < c for o in found)), key=sorted)


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc): the inverted index of those trigrams over all documents, case folded.

    Repeated rows share a doc. Null texts have no postings.
    """
    folded = docs.select(doc_key().alias("doc"), F.lower("text").alias("folded"))
    present = F.array_compact(F.array(*[F.when(F.contains("folded", F.lit(t)), F.lit(t)) for t in trigrams]))
    return folded.select("doc", F.explode(present).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc, rules): the documents in which an indexed rule may match, by intersecting postings."""
    spark = docs.sparkSession
    clauses = [(r.kind, n, t, len(c)) for r in rules for n, c in enumerate(trigram_query(r.pattern)) for t in sorted(c)]
    if not clauses:
        return spark.createDataFrame([], "doc long, rules array<string>")
    # As many rows as the rules have trigrams, whatever the data.
    terms = F.broadcast(spark.createDataFrame(clauses, "rule string, clause int, trigram string, need int"))
    hits = postings(docs, sorted({t for _, _, t, _ in clauses})).join(terms, "trigram")
    # A document's postings arise in one task, so the counts are complete before the shuffle.
    met = hits.groupBy("doc", "rule", "clause", "need").agg(F.countDistinct("trigram").alias("n")).filter("n = need")
    return met.groupBy("doc").agg(F.collect_set("rule").alias("rules"))


def _spans(rule: Rule, order: int, text: Column) -> Column:
    """The rule's spans in text as an array of (start, order, end, kind), in code points.

    The text between matches and the matches themselves alternate, so running lengths are positions.
    """
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    parts = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), found.alias("match"), value.alias("value"))
    kind = "array<struct<start:bigint,kind_order:int,end:bigint,kind:string>>"

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + F.length(part["gap"])
        end = start + F.length(part["match"])
        span = F.struct(start.alias("start"), F.lit(order).alias("kind_order"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        good = F.length(part["value"]) >= rule.min_len
        return F.struct(
            F.coalesce(end, start).cast("long").alias("at"),
            F.when(good, F.concat(acc["out"], F.array(span)).cast(kind)).otherwise(acc["out"]).alias("out"),
        )

    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("out"))
    return F.aggregate(parts, first, step, lambda acc: acc["out"])


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs' doc_id with spans, an array of (start, kind_order, end, kind) in order of start, then rule.

    Spans are leftmost and do not overlap within a rule; positions are code points, the end is
    exclusive. Null and empty texts have no spans. Repeated rows each get their own result. Other
    columns, whatever their names, are not read.
    """
    cand = materialise(candidates(docs, rules), "secret-candidates").withColumnRenamed("doc", "_doc")
    rows = docs.select("doc_id", text_or_empty().alias("text"), doc_key().alias("_key"))
    # Written, so its size is known: Spark broadcasts it only below its threshold.
    rows = rows.join(cand, rows["_key"] == cand["_doc"], "left")
    none = F.array().cast("array<struct<start:bigint,kind_order:int,end:bigint,kind:string>>")
    each = []
    for order, rule in enumerate(rules):
        may = F.array_contains("rules", rule.kind) if trigram_query(rule.pattern) else F.lit(True)
        search = F.coalesce(may, F.lit(False)) & F.col("text").rlike(rule.pattern)
        each.append(F.when(search, _spans(rule, order, F.col("text"))).otherwise(none))
    return rows.select("doc_id", F.array_sort(F.concat(*each)).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: counts by base kind, a digest of the base spans and all spans."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in RULES if r.base]))
    return found.select(
        "doc_id",
        *[count(r.kind) for r in RULES if r.base],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


def _sql() -> str:
    parts, union = [], []
    for order, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        k = r.kind
        parts.append(f"""
  m_{k} AS (SELECT k, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {r.group}) AS v, regexp_split_to_array(t, '{p}') AS s
    FROM d WHERE regexp_matches(t, '{p}')),
  r_{k} AS (SELECT k, m, v, s, unnest(range(1, len(m) + 1)) AS i FROM m_{k}),
  p_{k} AS (SELECT k, len(v[i]) AS n, len(m[i]) AS w,
    list_sum(list_transform(s[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: len(x))), 0) AS a FROM r_{k})""")
        union.append(f"SELECT k, a::BIGINT AS a, (a + w)::BIGINT AS b, {order} AS o, '{k}' AS kind, {str(r.base).lower()} AS base FROM p_{k} WHERE n >= {r.min_len}")
    counts = ", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in RULES if r.base)
    sums = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in RULES if r.base)
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),{",".join(parts)},
  u AS ({" UNION ALL ".join(union)}),
  g AS (SELECT k, {sums}, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o) AS spans,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o) FILTER (base) AS base FROM u GROUP BY k)
SELECT doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (k)
"""


OP4_SQL = _sql()
