"""Every query of the record-linkage operators on the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import geo, temporal, text
from pairloom.operators import blocking, compare, evaluation, graph, queue, review, scoring, store, sync
from pairloom.sources.scratch import written
from pairloom.streaming import limits

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _bucket(c: Column, n: int) -> Column:
    """A number below n from the first hexadecimal digits of an MD5, in either engine."""
    return F.conv(F.substring(F.md5(c.cast("string").cast("binary")), 1, 6), 16, 10).cast("int") % n


def _duck_bucket(c: str, n: int) -> str:
    return f"(('0x' || substr(md5(({c})::VARCHAR), 1, 6))::INT % {n})"


_NORM = r"regexp_replace(regexp_replace(regexp_replace(lower(trim({c})), '^https?://(www\.)?', ''), '/+$', ''), '[ \t\n\r]+', ' ', 'g')"
_KEY = r"nullif(trim(regexp_replace(regexp_replace({n}, '[^\p{{L}}\p{{N}}\s]+', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')), '')"


def _norm(c: str) -> str:
    return _NORM.format(c=c)


def _key(c: str) -> str:
    return _KEY.format(n=_norm(c))


# --- blocking ---------------------------------------------------------------------------------


@_query("blk_shared_keys", "SELECT p_brand, p_type, p_size, count(DISTINCT p_partkey) AS n FROM part GROUP BY ALL HAVING count(DISTINCT p_partkey) > 1")
def blk_shared_keys(spark: SparkSession, d: str) -> DataFrame:
    return blocking.shared_keys(_t(spark, d, "part"), ["p_brand", "p_type", "p_size"], "p_partkey")


def _keyed_parts(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").withColumn("key", text.blocking_key(F.col("p_name")))


_PARTS = f"WITH p AS (SELECT *, {_key('p_name')} AS key FROM part)"
_PAIRS = _PARTS + """, g AS (SELECT key, p_type, count(*) AS n FROM p WHERE key IS NOT NULL AND p_type IS NOT NULL GROUP BY ALL HAVING count(*) BETWEEN 2 AND 100),
 pr AS (SELECT x.p_partkey AS a, y.p_partkey AS b FROM p x JOIN p y ON x.key = y.key AND x.p_type = y.p_type AND x.p_partkey < y.p_partkey
   JOIN g ON g.key = x.key AND g.p_type = x.p_type)"""


@_query("blk_groups", _PARTS + " SELECT key, p_type, string_agg(p_partkey, ',' ORDER BY p_partkey) AS ids, count(*) AS n FROM p GROUP BY ALL HAVING count(*) BETWEEN 2 AND 100")
def blk_groups(spark: SparkSession, d: str) -> DataFrame:
    m = blocking.members(_keyed_parts(spark, d), ["key", "p_type"], "p_partkey")
    return m.select("key", "p_type", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), "n")


@_query("blk_oversized", _PARTS + " SELECT key, count(DISTINCT p_partkey) AS n FROM p GROUP BY key HAVING count(DISTINCT p_partkey) > 20")
def blk_oversized(spark: SparkSession, d: str) -> DataFrame:
    return blocking.oversized(_keyed_parts(spark, d), ["key"], "p_partkey", 20)


@_query("blk_pairs", _PAIRS + """, h AS (SELECT p_brand, p_type, p_size FROM part GROUP BY ALL HAVING count(*) BETWEEN 2 AND 100)
 SELECT a, b FROM pr UNION SELECT x.p_partkey, y.p_partkey FROM part x JOIN part y ON x.p_brand = y.p_brand AND x.p_type = y.p_type AND x.p_size = y.p_size AND x.p_partkey < y.p_partkey
 JOIN h ON h.p_brand = x.p_brand AND h.p_type = x.p_type AND h.p_size = x.p_size""")
def blk_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = _keyed_parts(spark, d)
    by_name = blocking.pairs(rows, ["key", "p_type"], "p_partkey")
    by_id = blocking.pairs(rows, ["p_brand", "p_type", "p_size"], "p_partkey")
    return blocking.union_pairs(by_name, by_id)


@_query("blk_incremental", """WITH w AS (SELECT CAST(max(p_partkey) * 0.9 AS BIGINT) AS at FROM part)
 SELECT DISTINCT n.p_brand, n.p_type, n.p_size FROM part n, w WHERE n.p_partkey > w.at AND EXISTS (SELECT 1 FROM part o
 WHERE o.p_brand = n.p_brand AND o.p_type = n.p_type AND o.p_size = n.p_size AND o.p_partkey <> n.p_partkey)""")
def blk_incremental(spark: SparkSession, d: str) -> DataFrame:
    part = _t(spark, d, "part")
    mark = part.agg((F.max("p_partkey") * F.lit(0.9)).alias("m")).first()[0]
    return blocking.incremental_keys(part, ["p_brand", "p_type", "p_size"], "p_partkey", round(mark))


@_query("blk_block_size", _PARTS + """, h AS (SELECT p_brand, p_type, p_size FROM part GROUP BY ALL HAVING count(*) BETWEEN 2 AND 100),
 q AS (SELECT x.p_partkey AS a, y.p_partkey AS b, x.key AS ka, y.key AS kb FROM p x JOIN p y ON x.p_brand = y.p_brand AND x.p_type = y.p_type AND x.p_size = y.p_size AND x.p_partkey < y.p_partkey
 JOIN h ON h.p_brand = x.p_brand AND h.p_type = x.p_type AND h.p_size = x.p_size), s AS (SELECT key, count(*) AS n FROM p GROUP BY key HAVING count(*) > 1)
 SELECT a, b, CASE WHEN ka = kb THEN n END AS block_size FROM q LEFT JOIN s ON s.key = ka""")
def blk_block_size(spark: SparkSession, d: str) -> DataFrame:
    rows = _keyed_parts(spark, d)
    return blocking.with_block_size(blocking.pairs(rows, ["p_brand", "p_type", "p_size"], "p_partkey"), rows, ["key"], "p_partkey")


# --- text -------------------------------------------------------------------------------------


@_query("txt_normalize", f"SELECT page_id, {_norm('url')} AS norm FROM pages")
def txt_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", text.normalize(F.col("url")).alias("norm"))


@_query("txt_blocking_key", f"SELECT doc_id, left({_key('split_part(text, chr(10), 1)')}, 255) AS key FROM documents")
def txt_blocking_key(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", text.blocking_key(F.split_part("text", F.lit("\n"), F.lit(1))).alias("key"))


@_query("txt_similarity", "SELECT a.p_partkey, CASE WHEN a.p_name = b.p_name THEN 1.0::DOUBLE ELSE round(1 - levenshtein(a.p_name, b.p_name)::DOUBLE / greatest(length(a.p_name), length(b.p_name)), 9) END AS sim FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def txt_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Each part's name and that of the part after it."""
    a = _t(spark, d, "part").select("p_partkey", F.col("p_name").alias("a"))
    b = _t(spark, d, "part").select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b"))
    return a.join(b, "p_partkey").select("p_partkey", F.round(text.similarity(F.col("a"), F.col("b")), 9).alias("sim"))


@_query("txt_best_name", """WITH s AS (SELECT s_nationkey AS k, list(DISTINCT s_name) AS x FROM supplier GROUP BY 1), c AS (SELECT n_nationkey AS k, [n_name, lower(n_name) || ' ltd'] AS y FROM nation)
 SELECT k, round(list_max(flatten(list_transform(x, lambda p: list_transform(y, lambda q: CASE WHEN lower(p) = lower(q) THEN 1.0::DOUBLE ELSE 1 - levenshtein(lower(p), lower(q))::DOUBLE / greatest(length(p), length(q)) END)))), 9) AS best FROM s JOIN c USING (k)""")
def txt_best_name(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.collect_set("s_name").alias("x"))
    c = _t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.array("n_name", F.concat(F.lower("n_name"), F.lit(" ltd"))).alias("y"))
    return s.join(c, "k").select("k", F.round(text.best_name_similarity(F.col("x"), F.col("y")), 9).alias("best"))


_WORDSET = f"list_distinct(list_filter(string_split({_norm('w')}, ' '), lambda z: z <> ''))"


@_query("txt_word_overlap", f"""WITH t AS (SELECT doc_id, lead(doc_id) OVER w AS next_id FROM documents WINDOW w AS (PARTITION BY lang, source ORDER BY doc_id)),
 x AS (SELECT t.doc_id AS a, t.next_id AS b, p.text AS w1, q.text AS w2 FROM t JOIN documents p ON p.doc_id = t.doc_id JOIN documents q ON q.doc_id = t.next_id),
 s AS (SELECT a, b, {_WORDSET.replace("lower(trim(w))", "lower(trim(w1))")} AS ws, {_WORDSET.replace("lower(trim(w))", "lower(trim(w2))")} AS vs FROM x)
 SELECT a, b, CASE WHEN len(ws) + len(vs) = 0 THEN 0.0::DOUBLE ELSE round(2.0::DOUBLE * len(list_intersect(ws, vs)) / (len(ws) + len(vs)), 9) END AS dice FROM s""")
def txt_word_overlap(spark: SparkSession, d: str) -> DataFrame:
    """The whole texts of each document and the next one of its language and source."""
    docs = _t(spark, d, "documents")
    t = queue.neighbours(docs.select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", "doc_id").select(F.col("prev_id").alias("b"), F.col("doc_id").alias("a"))
    a, b = (docs.select(F.col("doc_id").alias(s), text.words(F.col("text")).alias(f"w{s}")) for s in "ab")
    both = F.size("wa") + F.size("wb")
    dice = F.when(both == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect("wa", "wb")) / both)
    return t.join(a, "a").join(b, "b").select("a", "b", F.round(dice, 9).alias("dice"))


@_query("txt_url_compare", r"""WITH u AS (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN replace(url, 'https://', 'http://') WHEN 2 THEN url || '/' ELSE upper(url) END AS other FROM pages),
 s AS (SELECT *, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/+$', '') AS p, regexp_replace(regexp_replace(other, '^[a-z]+://', ''), '/+$', '') AS q FROM u)
 SELECT page_id, CASE WHEN url = other OR p = q THEN 'identical' WHEN """ + _norm("url") + " = " + _norm("other") + """ THEN 'similar' ELSE 'distinct' END AS status FROM s""")
def txt_url_compare(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    k = F.col("page_id") % 4
    other = F.when(k == 0, u).when(k == 1, F.replace(u, F.lit("https://"), F.lit("http://"))).when(k == 2, F.concat(u, F.lit("/"))).otherwise(F.upper(u))
    return _t(spark, d, "pages").select("page_id", text.compare_urls(u, other).alias("status"))


@_query("txt_site_language", r"SELECT page_id, nullif(regexp_extract(regexp_extract(url, '^https?://([^/:?#]+)', 1), '^([a-z]{2,3})\.', 1), '') AS lang FROM pages")
def txt_site_language(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", text.site_language(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1)).alias("lang"))


@_query("txt_slug_split", r"""WITH s AS (SELECT c_custkey AS k, 'item-' || (c_custkey % 50) AS a, CASE c_custkey % 3 WHEN 0 THEN 'item-' || (c_custkey % 7) WHEN 1 THEN 'item-' || (c_custkey % 50) || '--2' ELSE 'other-' || (c_custkey % 9) END AS b FROM customer)
 SELECT k, a <> b AND (regexp_replace(a, '--\d+$', '') = regexp_replace(b, '--\d+$', '') OR (regexp_matches(a, '-\d{1,3}$') AND regexp_matches(b, '-\d{1,3}$') AND regexp_replace(a, '-\d{1,3}$', '') = regexp_replace(b, '-\d{1,3}$', ''))) AS split FROM s""")
def txt_slug_split(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    a = F.concat(F.lit("item-"), k % 50)
    b = F.when(k % 3 == 0, F.concat(F.lit("item-"), k % 7)).when(k % 3 == 1, F.concat(F.lit("item-"), k % 50, F.lit("--2"))).otherwise(F.concat(F.lit("other-"), k % 9))
    return _t(spark, d, "customer").select(k.alias("k"), text.is_slug_split(a, b).alias("split"))


@_query("txt_installment", r"SELECT p_partkey, trim(regexp_extract(p_brand, '^(.*?)[\s#(]*(\d{1,4})\)?$', 1)) AS base, CAST(nullif(regexp_extract(p_brand, '^(.*?)[\s#(]*(\d{1,4})\)?$', 2), '') AS INT) AS number FROM part")
def txt_installment(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", text.installment(F.col("p_brand")).alias("i")).select("p_partkey", "i.base", "i.number")


_PHONE = r"(\+?[0-9][0-9 ().-]{7,}[0-9])"


@_query("txt_phone_digits", rf"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '{_PHONE}', 1), lambda p: regexp_replace(regexp_replace(regexp_replace(p, '\(0\)', '', 'g'), '[^0-9]', '', 'g'), '^00', '')), ',') AS digits FROM documents")
def txt_phone_digits(spark: SparkSession, d: str) -> DataFrame:
    found = F.transform(F.regexp_extract_all("text", F.lit(_PHONE), 1), text.phone_digits)
    return _t(spark, d, "documents").select("doc_id", F.array_join(found, ",").alias("digits"))


@_query("txt_title_years", r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '\b([12][0-9]{3})\b', 1), lambda y: y::INT))), ',') AS years FROM documents")
def txt_title_years(spark: SparkSession, d: str) -> DataFrame:
    years = F.transform(text.title_years(F.col("text")), lambda y: y.cast("string"))
    return _t(spark, d, "documents").select("doc_id", F.array_join(years, ",").alias("years"))


@_query("txt_diff_kind")
def txt_diff_kind(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("p_name")
    k = F.col("p_partkey") % 4
    other = F.when(k == 0, name).when(k == 1, F.upper(name)).when(k == 2, F.replace(name, F.lit(" "), F.lit("-"))).otherwise(F.replace(name, F.lit(" "), F.lit("")))
    return _t(spark, d, "part").select("p_partkey", text.difference_kind(name, other).alias("kind"))


@_query("txt_native_name")
def txt_native_name(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "nation").select("n_nationkey", text.fold_native_name(F.col("n_name")).alias("folded"))


# --- time and place ---------------------------------------------------------------------------

_TIMES = """WITH t AS (SELECT l_orderkey, l_linenumber, strftime(o_orderdate, '+%Y-%m-%dT00:00:00Z') AS x, strftime(l_shipdate, '+%Y-%m-%dT00:00:00Z') AS y, 9 + l_linenumber % 3 AS p
 FROM lineitem JOIN orders ON o_orderkey = l_orderkey), c AS (SELECT *, CASE WHEN p = 9 THEN x[1:5] || '-00-00' || x[12:] WHEN p = 10 THEN x[1:8] || '-00' || x[12:] ELSE x END AS a FROM t)"""


def _two_dates(spark: SparkSession, d: str) -> DataFrame:
    form = "'+'yyyy-MM-dd'T00:00:00Z'"
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.date_format("l_shipdate", form).alias("y"), F.year("l_shipdate").alias("ys"))
    o = _t(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", form).alias("x"), F.year("o_orderdate").alias("yo"))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))


@_query("cmp_time_precision", _TIMES + """ SELECT l_orderkey, l_linenumber, a, CASE WHEN a = y THEN 'identical' WHEN a[2:5] <> y[2:5] THEN 'distinct' WHEN a[7:8] = '00' OR a[10:11] = '00' THEN 'similar: precision'
 WHEN a[7:8] <> y[7:8] THEN 'similar: month' ELSE 'similar: day' END AS status FROM c""")
def cmp_time_precision(spark: SparkSession, d: str) -> DataFrame:
    a = temporal.at_precision(F.col("x"), 9 + F.col("l_linenumber") % 3)
    return _two_dates(spark, d).withColumn("a", a).select("l_orderkey", "l_linenumber", "a", temporal.compare_calendar(F.col("a"), F.col("y")).alias("status"))


@_query("cmp_coarse_time", """WITH t AS (SELECT l_orderkey, l_linenumber, year(o_orderdate) AS x, year(l_shipdate) AS y, 7 + l_linenumber % 2 AS p, 8 AS q FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
 r AS (SELECT *, CASE WHEN p = 8 THEN x // 10 * 10 ELSE (x + 99) // 100 * 100 - 99 END AS a1, CASE WHEN p = 8 THEN x // 10 * 10 + 9 ELSE (x + 99) // 100 * 100 END AS a2, y // 10 * 10 AS b1, y // 10 * 10 + 9 AS b2 FROM t)
 SELECT l_orderkey, l_linenumber, a1::BIGINT AS first_year, a2::BIGINT AS last_year, CASE WHEN a1 = b1 AND a2 = b2 AND p = q THEN 'identical' WHEN a1 <= b2 AND b1 <= a2 THEN 'similar' ELSE 'distinct' END AS status FROM r""")
def cmp_coarse_time(spark: SparkSession, d: str) -> DataFrame:
    p = 7 + F.col("l_linenumber") % 2
    span = temporal.coarse_range(F.col("yo"), p)
    status = temporal.compare_coarse(F.col("yo"), p, F.col("ys"), F.lit(8))
    return _two_dates(spark, d).select("l_orderkey", "l_linenumber", span["first"].alias("first_year"), span["last"].alias("last_year"), status.alias("status"))


_POINT = "({k} * 37 % 170 - 85)::DOUBLE AS lat{s}, ({k} * 53 % 340 - 170)::DOUBLE AS lon{s}"


@_query("geo_nearest", f"""WITH s AS (SELECT s_suppkey, s_nationkey, {_POINT.format(k="s_suppkey", s=1)} FROM supplier), c AS (SELECT c_nationkey, {_POINT.format(k="c_custkey", s=2)} FROM customer),
 h AS (SELECT s_suppkey, 2 * 6371000.0::DOUBLE * asin(least(1.0, sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)))) AS m FROM s JOIN c ON c_nationkey = s_nationkey)
 SELECT s_suppkey, round(min(m))::BIGINT AS metres FROM h GROUP BY 1""")
def geo_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Distinct points of a nation's customers, and the least distance for each supplier."""
    def point(k: str, i: int) -> list[Column]:
        return [(F.col(k) * 37 % 170 - 85).cast("double").alias(f"lat{i}"), (F.col(k) * 53 % 340 - 170).cast("double").alias(f"lon{i}")]
    s = _t(spark, d, "supplier").select("s_suppkey", "s_nationkey", *point("s_suppkey", 1))
    c = _t(spark, d, "customer").select("c_nationkey", *point("c_custkey", 2)).distinct()
    metres = geo.distance(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"), F.lit(geo.RADIUS["earth"]))
    return s.join(c, F.col("s_nationkey") == F.col("c_nationkey")).groupBy("s_suppkey").agg(F.round(F.min(metres)).cast("long").alias("metres"))


# --- comparison and scoring -------------------------------------------------------------------


@_query("cmp_sets", """WITH b AS (SELECT l_suppkey AS k, list_sort(list(DISTINCT p_brand)) AS s FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
 SELECT x.k AS a, y.k AS b, CASE WHEN x.s = y.s THEN 'identical' WHEN len(list_intersect(x.s, y.s)) = 0 THEN 'distinct' ELSE 'similar' END AS status FROM b x JOIN b y ON y.k = x.k + 1""")
def cmp_sets(spark: SparkSession, d: str) -> DataFrame:
    li = _t(spark, d, "lineitem").join(_t(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    b = li.groupBy(F.col("l_suppkey").alias("k")).agg(F.collect_set("p_brand").alias("s"))
    x, y = b.select(F.col("k").alias("a"), F.col("s").alias("sa")), b.select(F.col("k").alias("b"), F.col("s").alias("sb"))
    return x.join(y, F.col("b") == F.col("a") + 1).select("a", "b", compare.compare_sets(F.col("sa"), F.col("sb"), compare.compare_exact).alias("status"))


@_query("cmp_rows", """WITH x AS (SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS seg, c_name AS nm FROM customer), y AS (SELECT s_suppkey AS k, s_nationkey AS n, s_name AS nm FROM supplier),
 j AS (SELECT x.k, x.nm AS xn, y.nm AS yn, x.n AS xk, y.n AS yk FROM x JOIN y USING (k))
 SELECT k, 'name' AS field, CASE WHEN xn = yn THEN 'identical' WHEN 1 - levenshtein(lower(xn), lower(yn))::DOUBLE / greatest(length(xn), length(yn)) >= 0.75 THEN 'similar' ELSE 'distinct' END AS status FROM j
 UNION ALL SELECT k, 'nation', CASE WHEN xk = yk THEN 'identical' WHEN 1 - levenshtein(xk::VARCHAR, yk::VARCHAR)::DOUBLE / greatest(length(xk::VARCHAR), length(yk::VARCHAR)) >= 0.75 THEN 'similar' ELSE 'distinct' END FROM j
 UNION ALL SELECT k, 'segment', 'one-sided' FROM j""")
def cmp_rows(spark: SparkSession, d: str) -> DataFrame:
    def fields(**kv: str) -> Column:
        return F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), F.col(v).cast("string"))])
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), fields(name="c_name", nation="c_nationkey", segment="c_mktsegment").alias("a"))
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), fields(name="s_name", nation="s_nationkey").alias("b"))
    return c.join(s, "k").select("k", F.explode(compare.compare_rows(F.col("a"), F.col("b"))).alias("r")).select("k", "r.field", "r.status")


@_query("cmp_status_counts", """WITH s AS (SELECT o_orderstatus AS x, CASE WHEN l_linestatus = o_orderstatus THEN 'identical' ELSE 'distinct' END AS status FROM lineitem JOIN orders ON o_orderkey = l_orderkey) SELECT status, count(*) AS n FROM s GROUP BY 1""")
def cmp_status_counts(spark: SparkSession, d: str) -> DataFrame:
    j = _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    rank = compare.compare_exact(F.col("l_linestatus"), F.col("o_orderstatus"))
    return j.groupBy(compare.status(rank).alias("status")).agg(F.count(F.lit(1)).alias("n"))


_GAP = "abs(x.p_size - y.p_size)"
_SCORED = _PAIRS + f""", v AS (SELECT pr.a, pr.b, x.p_brand = y.p_brand AS brand, {_GAP} AS gap, abs(x.p_retailprice - y.p_retailprice) AS price,
  CASE WHEN {_norm("x.p_name")} = {_norm("y.p_name")} THEN 1.0::DOUBLE ELSE 1 - levenshtein({_norm("x.p_name")}, {_norm("y.p_name")})::DOUBLE / greatest(length({_norm("x.p_name")}), length({_norm("y.p_name")})) END AS sim
  FROM pr JOIN part x ON x.p_partkey = pr.a JOIN part y ON y.p_partkey = pr.b),
 s1 AS (SELECT *, 0.0::DOUBLE + CASE WHEN brand THEN 0.6::DOUBLE ELSE 0 END AS t1 FROM v), s2 AS (SELECT *, t1 + 0.1::DOUBLE AS t2 FROM s1),
 s3 AS (SELECT *, t2 + CASE WHEN sim >= 0.995 THEN 0.35::DOUBLE WHEN sim >= 0.75 THEN 0.2::DOUBLE ELSE -0.35::DOUBLE END AS t3 FROM s2),
 s4 AS (SELECT *, t3 + CASE WHEN gap >= 10 AND brand THEN -0.3::DOUBLE ELSE 0 END AS t4 FROM s3),
 s5 AS (SELECT *, CASE WHEN gap >= 10 AND NOT brand THEN least(t4, 0.1::DOUBLE) ELSE t4 END AS t5 FROM s4),
 s6 AS (SELECT *, CASE WHEN gap >= 2 AND gap < 10 THEN t5 + -least(0.35::DOUBLE, 0.25::DOUBLE + (gap - 2)::DOUBLE / 30.0::DOUBLE) ELSE t5 END AS t6 FROM s5),
 s7 AS (SELECT *, t6 + CASE WHEN price > 200 THEN -0.2::DOUBLE ELSE 0 END AS t7 FROM s6),
 s8 AS (SELECT *, CASE WHEN brand AND gap = 0 THEN 0.93::DOUBLE WHEN brand THEN 0.85::DOUBLE ELSE 0.72::DOUBLE END AS top FROM s7),
 s9 AS (SELECT *, least(t7, top) AS t8 FROM s8),
 sc AS (SELECT greatest(a, b) AS merged_from, least(a, b) AS merged_into, round(greatest(0.0, least(1.0, t8)), 9) AS confidence,
  concat_ws('; ', CASE WHEN t8 < t7 THEN 'held below by few signals' END, CASE WHEN gap >= 10 AND NOT brand THEN 'sizes far apart, no shared brand' END, CASE WHEN brand THEN 'shared brand' END, 'same type',
   CASE WHEN sim >= 0.995 THEN 'same name' WHEN sim >= 0.75 THEN 'similar name' ELSE 'different name' END, CASE WHEN gap >= 10 AND brand THEN 'sizes far apart' END,
   CASE WHEN gap >= 2 AND gap < 10 THEN 'sizes differ' END, CASE WHEN price > 200 THEN 'prices differ' END) AS reasons, t1, t2, t3, t4, t5, t6, t7, t8 FROM s9)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Written, since a filter on the score would otherwise be pushed into the fold and repeat its steps."""
    return written(scoring.score_parts(_t(spark, d, "part")), "scored")


@_query("score_pairs", _SCORED + " SELECT merged_from, merged_into, confidence, reasons FROM sc WHERE confidence >= 0.4")
def score_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).filter("confidence >= 0.4")


@_query("score_trace", _SCORED + " SELECT merged_from, merged_into, " + ", ".join(f"round(t{n}, 6) AS t{n}" for n in (1, 3, 5, 7, 8)) + " FROM sc")
def score_trace(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.score_parts(_t(spark, d, "part"), trace=True)
    place = {1: 0, 3: 4, 5: 6, 7: 8, 8: 9}  # steps 3 to 5 of the fold are one of the oracle's
    return out.select("merged_from", "merged_into", *[F.get("trace", F.lit(i)).alias(f"t{n}") for n, i in place.items()])


@_query("score_bands", _SCORED + " SELECT CASE WHEN confidence >= 0.8 THEN '0.8' WHEN confidence >= 0.7 THEN '0.7' WHEN confidence >= 0.6 THEN '0.6' WHEN confidence >= 0.5 THEN '0.5' ELSE '0.4' END AS band, count(*) AS n FROM sc WHERE confidence >= 0.4 GROUP BY 1")
def score_bands(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.bands(_scored(spark, d), F.col("confidence"), [0.4, 0.5, 0.6, 0.7, 0.8])


# --- the store --------------------------------------------------------------------------------

_ST = "CASE {b} WHEN 0 THEN 'dismissed' WHEN 1 THEN 'merged' WHEN 2 THEN 'merging' ELSE 'open' END"
_OLD = _SCORED + f""", al AS (SELECT *, merged_from || '-' || merged_into AS id FROM sc),
 old AS (SELECT merged_from, merged_into, 0.5::DOUBLE AS confidence, 'old' AS reasons, {_ST.format(b=_duck_bucket("id || 's'", 8))} AS status FROM al WHERE {_duck_bucket("id", 3)} > 0),
 new AS (SELECT merged_from, merged_into, confidence, reasons FROM al WHERE {_duck_bucket("id", 5)} > 0 AND confidence >= 0.4)"""


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all scored, an older store, this run's candidates)."""
    ident = F.concat_ws("-", "merged_from", "merged_into")
    al = _scored(spark, d).withColumn("id", ident)
    s = _bucket(F.concat("id", F.lit("s")), 8)
    status = F.when(s == 0, "dismissed").when(s == 1, "merged").when(s == 2, "merging").otherwise("open")
    old = al.filter(_bucket(F.col("id"), 3) > 0).select("merged_from", "merged_into", F.lit(0.5).alias("confidence"), F.lit("old").alias("reasons"), status.alias("status"))
    new = al.filter((_bucket(F.col("id"), 5) > 0) & (F.col("confidence") >= 0.4)).select("merged_from", "merged_into", "confidence", "reasons")
    return al.drop("id"), old, new


@_query("store_upsert", _OLD + """ SELECT merged_from, merged_into, CASE WHEN n.confidence IS NULL OR o.status IN ('merging', 'dismissed', 'merged') THEN o.confidence ELSE n.confidence END AS confidence,
 CASE WHEN n.confidence IS NULL OR o.status IN ('merging', 'dismissed', 'merged') THEN o.reasons ELSE n.reasons END AS reasons, coalesce(o.status, 'open') AS status FROM old o FULL JOIN new n USING (merged_from, merged_into)""")
def store_upsert(spark: SparkSession, d: str) -> DataFrame:
    _, old, new = _snapshots(spark, d)
    return store.upsert(old, new)


@_query("store_stale", _OLD + " SELECT o.* FROM old o WHERE o.status <> 'open' OR NOT EXISTS (SELECT 1 FROM sc WHERE sc.merged_from = o.merged_from AND sc.merged_into = o.merged_into AND sc.confidence < 0.4)")
def store_stale(spark: SparkSession, d: str) -> DataFrame:
    al, old, _ = _snapshots(spark, d)
    return store.drop_stale(old, al)


@_query("store_orphans", _OLD + " SELECT o.* FROM old o WHERE o.status = 'open' AND NOT EXISTS (SELECT 1 FROM new n WHERE n.merged_from = o.merged_from AND n.merged_into = o.merged_into)")
def store_orphans(spark: SparkSession, d: str) -> DataFrame:
    _, old, new = _snapshots(spark, d)
    return store.orphans(old, new.select(F.col("merged_into").alias("a"), F.col("merged_from").alias("b")))


@_query("store_prune_guard", _OLD + """, lost AS (SELECT o.merged_from, o.merged_into FROM old o WHERE o.status = 'open' AND NOT EXISTS (SELECT 1 FROM new n WHERE n.merged_from = o.merged_from AND n.merged_into = o.merged_into)),
 go AS (SELECT NOT ((SELECT count(*) FROM lost) > 100 AND (SELECT count(*) FROM lost) > 0.5 * (SELECT count(*) FROM old WHERE status = 'open')) AS ok)
 SELECT o.* FROM old o, go WHERE NOT ok OR NOT EXISTS (SELECT 1 FROM lost l WHERE l.merged_from = o.merged_from AND l.merged_into = o.merged_into)""")
def store_prune_guard(spark: SparkSession, d: str) -> DataFrame:
    _, old, new = _snapshots(spark, d)
    return store.prune_orphans(old, new.select(F.col("merged_into").alias("a"), F.col("merged_from").alias("b")))


@_query("store_null_safe_refresh", """WITH o AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment, c_nationkey + (c_custkey % 7 = 0)::INT AS c_nationkey FROM customer)
 SELECT c.c_custkey, c.c_mktsegment, c.c_nationkey FROM customer c JOIN o USING (c_custkey) WHERE c.c_mktsegment IS DISTINCT FROM o.c_mktsegment OR c.c_nationkey IS DISTINCT FROM o.c_nationkey""")
def store_null_safe_refresh(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    k = F.col("c_custkey")
    old = c.select(k, F.when(k % 5 != 0, F.col("c_mktsegment")).alias("c_mktsegment"), (F.col("c_nationkey") + (k % 7 == 0).cast("int")).alias("c_nationkey"))
    return store.null_safe_changes(old, c, "c_custkey", ["c_mktsegment", "c_nationkey"])


@_query("store_after_merge", _OLD + """, m AS (SELECT merged_from, merged_into FROM old WHERE status = 'merging'), gg AS (SELECT DISTINCT merged_from AS g FROM m)
 SELECT o.merged_from, o.merged_into, o.confidence, o.reasons, CASE WHEN m.merged_from IS NOT NULL THEN 'merged' WHEN o.status = 'open' AND (o.merged_from IN (SELECT g FROM gg) OR o.merged_into IN (SELECT g FROM gg)) THEN 'dismissed' ELSE o.status END AS status
 FROM old o LEFT JOIN m ON m.merged_from = o.merged_from AND m.merged_into = o.merged_into""")
def store_after_merge(spark: SparkSession, d: str) -> DataFrame:
    _, old, _ = _snapshots(spark, d)
    return store.after_merge(old, old.filter("status = 'merging'"))


@_query("store_claims", """WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'merging' WHEN 2 THEN 'dismissed' ELSE 'merged' END AS s, CASE event_type WHEN 'view' THEN 'claim' WHEN 'click' THEN 'dismiss' WHEN 'purchase' THEN 'merge' WHEN 'signup' THEN 'release' ELSE 'reopen' END AS a, event_id % 1200 AS age FROM events)
 SELECT event_id, CASE WHEN a = 'claim' AND (s = 'open' OR (s = 'merging' AND age > 600)) THEN 'merging' WHEN a = 'release' AND s = 'merging' THEN 'open' WHEN a = 'merge' AND s = 'merging' AND age <= 600 THEN 'merged'
 WHEN a = 'dismiss' AND (s = 'open' OR (s = 'merging' AND age > 600)) THEN 'dismissed' WHEN a = 'reopen' AND s = 'dismissed' THEN 'open' ELSE s END AS status FROM e""")
def store_claims(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 4
    s = F.when(k == 0, "open").when(k == 1, "merging").when(k == 2, "dismissed").otherwise("merged")
    t = F.col("event_type")
    a = F.when(t == "view", "claim").when(t == "click", "dismiss").when(t == "purchase", "merge").when(t == "signup", "release").otherwise("reopen")
    return _t(spark, d, "events").select("event_id", store.next_status(s, a, F.col("event_id") % 1200).alias("status"))


# --- synchronisation --------------------------------------------------------------------------

_NEWC = "SELECT c_custkey, c_name, CASE WHEN c_custkey % 11 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 13 <> 0"


def _two_customers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = _t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    k = F.col("c_custkey")
    new = c.filter(k % 13 != 0).withColumn("c_mktsegment", F.when(k % 11 == 0, "MOVED").otherwise(F.col("c_mktsegment")))
    return c.filter(k % 17 != 0), new


@_query("sync_change_detect", f"""WITH o AS (SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 17 <> 0), n AS ({_NEWC})
 SELECT c_custkey, CASE WHEN o.c_name IS NULL THEN 'added' WHEN n.c_name IS NULL THEN 'removed' WHEN o.c_mktsegment = n.c_mktsegment AND o.c_name = n.c_name THEN 'same' ELSE 'changed' END AS change FROM o FULL JOIN n USING (c_custkey)""")
def sync_change_detect(spark: SparkSession, d: str) -> DataFrame:
    old, new = _two_customers(spark, d)
    return sync.detect_changes(old, new, "c_custkey", ["c_name", "c_mktsegment"])


@_query("sync_diff", f"""WITH o AS (SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 17 <> 0), n AS (SELECT c_custkey, c_mktsegment FROM ({_NEWC}))
 SELECT *, 'delete' AS op FROM (FROM o EXCEPT FROM n) UNION ALL SELECT *, 'insert' FROM (FROM n EXCEPT FROM o)""")
def sync_diff(spark: SparkSession, d: str) -> DataFrame:
    old, new = _two_customers(spark, d)
    return sync.row_diff(old, new, ["c_custkey", "c_mktsegment"])


@_query("sync_hash", "SELECT c_custkey, sha1(concat_ws(chr(31), '=' || c_mktsegment, '=' || c_name)) AS hash FROM customer")
def sync_hash(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").select("c_custkey", sync.content_hash(["c_name", "c_mktsegment"]).alias("hash"))


@_query("sync_insert_ignore", "SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, 'new' FROM nation WHERE n_nationkey % 2 = 1")
def sync_insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    new = n.select("k", F.lit("new").alias("name"))
    return sync.insert_ignore(n.filter("k % 2 = 0"), new.unionByName(new), ["k"])


@_query("sync_settle", """WITH c AS (SELECT o_orderkey AS merged_from, o_custkey AS merged_into, CASE WHEN o_orderstatus = 'P' THEN 'merged' ELSE 'open' END AS status FROM orders),
 f AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN o_custkey WHEN o_orderkey % 10 = 0 THEN -1 END AS r, o_orderkey % 200 = 3 AS x FROM orders),
 j AS (SELECT c.*, a.r AS ar, b.r AS br, coalesce(a.x, false) OR coalesce(b.x, false) AS gone FROM c LEFT JOIN f a ON a.id = merged_from LEFT JOIN f b ON b.id = merged_into),
 v AS (SELECT NOT (count(*) FILTER (status = 'open' AND gone) > 50 AND count(*) FILTER (status = 'open' AND gone) > 0.01 * count(*) FILTER (status = 'open')) AS ok FROM j)
 SELECT merged_from, merged_into, CASE WHEN status <> 'open' THEN status WHEN ar = merged_into OR br = merged_from THEN 'merged' WHEN ar IS NOT NULL OR br IS NOT NULL THEN 'merged elsewhere' WHEN gone AND ok THEN 'dismissed' ELSE status END AS status FROM j, v""")
def sync_settle(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    k = F.col("o_orderkey")
    c = o.select(k.alias("merged_from"), F.col("o_custkey").alias("merged_into"), F.when(F.col("o_orderstatus") == "P", "merged").otherwise("open").alias("status"))
    f = o.select(k.alias("id"), F.when(k % 9 == 0, F.col("o_custkey")).when(k % 10 == 0, F.lit(-1).cast("long")).alias("redirect"), (k % 200 == 3).alias("deleted"))
    return store.settle(c, f)


@_query("sync_staggered_refresh", "WITH t AS (SELECT o_orderkey, o_orderdate::DATE AS dt, 6 + (('0x' || substr(md5(o_orderkey::VARCHAR), 1, 4))::INT % 28) AS limit_days, (SELECT max(o_orderdate)::DATE FROM orders) AS m FROM orders) SELECT o_orderkey, limit_days FROM t WHERE m - dt > limit_days")
def sync_staggered_refresh(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("dt"))
    as_of = o.agg(F.max("dt")).first()[0]
    return sync.due_for_refresh(o, "o_orderkey", "dt", F.lit(as_of)).select("o_orderkey", "limit_days")


# --- the queue --------------------------------------------------------------------------------


@_query("queue_list", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 1000) AS hits FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 1000 ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 25 OFFSET 25")
def queue_list(spark: SparkSession, d: str) -> DataFrame:
    page, hits = queue.list_rows(_t(spark, d, "orders"), sort="o_totalprice", id_="o_orderkey", status=("o_orderstatus", "O"), floor=("o_totalprice", 1000.0), page=2)
    return page.select("o_orderkey", "o_totalprice", F.lit(hits.count()).cast("long").alias("hits"))


@_query("queue_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'an') OR contains(lower(p_type), 'an') ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 100")
def queue_search(spark: SparkSession, d: str) -> DataFrame:
    return queue.list_rows(_t(spark, d, "part"), sort="p_retailprice", id_="p_partkey", search=(["p_name", "p_type"], " AN "), size=100)[0].select("p_partkey", "p_name")


@_query("queue_types", "SELECT p_partkey FROM part WHERE p_type IN (SELECT min(p_type) FROM part UNION ALL SELECT max(p_type) FROM part) OR p_brand IN (SELECT min(p_type) FROM part UNION ALL SELECT max(p_type) FROM part)")
def queue_types(spark: SparkSession, d: str) -> DataFrame:
    part = _t(spark, d, "part")
    row = part.agg(F.min("p_type"), F.max("p_type")).first()
    return queue.list_rows(part, sort="p_size", id_="p_partkey", types=(["p_type", "p_brand"], list(row)))[1].select("p_partkey")


@_query("queue_mine", "SELECT o_orderkey, 'known' AS viewer FROM orders WHERE o_orderpriority = '1-URGENT'")
def queue_mine(spark: SparkSession, d: str) -> DataFrame:
    """What a known viewer sees of their own, and one who is not known: nothing."""
    o = _t(spark, d, "orders")
    seen = [queue.list_rows(o, sort="o_totalprice", id_="o_orderkey", mine=("o_orderpriority", who))[1].select("o_orderkey", F.lit(name).alias("viewer")) for who, name in (("1-URGENT", "known"), (None, "unknown"))]
    return seen[0].unionByName(seen[1])


@_query("queue_lang", "SELECT doc_id FROM documents WHERE doc_id % 5 = 0 OR (lang IN ('en', 'fr') AND (doc_id % 3 <> 0 OR lang = 'en'))")
def queue_lang(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    labels = F.when(k % 5 != 0, F.array("lang"))
    clashes = F.when(k % 5 != 0, F.when((k % 3 == 0) & (F.col("lang") != "en"), F.array(F.lit("xx"))).otherwise(F.array().cast("array<string>")))
    return _t(spark, d, "documents").filter(queue.readable(["en", "fr"], labels, clashes)).select("doc_id")


@_query("queue_neighbours", "SELECT o_orderkey, lag(o_orderkey) OVER w AS prev_id, lead(o_orderkey) OVER w AS next_id FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey DESC)")
def queue_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return queue.neighbours(_t(spark, d, "orders"), ["o_orderstatus"], "o_totalprice", "o_orderkey").select("o_orderkey", "prev_id", "next_id")


@_query("queue_neighbours_of", """WITH m AS (SELECT min(o_orderkey) AS id FROM orders), w AS (SELECT o_orderkey, lag(o_orderkey) OVER w AS prev_id, lead(o_orderkey) OVER w AS next_id FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey DESC))
 SELECT prev_id, next_id FROM w JOIN m ON id = o_orderkey""")
def queue_neighbours_of(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    return queue.neighbours_of(o, "o_orderstatus", "o_totalprice", "o_orderkey", o.agg(F.min("o_orderkey")).first()[0])


@_query("queue_keyset", "SELECT o_orderkey FROM orders WHERE o_orderkey > 100 ORDER BY 1 LIMIT 50")
def queue_keyset(spark: SparkSession, d: str) -> DataFrame:
    return queue.keyset_page(_t(spark, d, "orders"), "o_orderkey", 100, 50).select("o_orderkey")


@_query("queue_leaderboard", """WITH p AS (SELECT * FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY), u AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS m, 0 AS v FROM p GROUP BY 1 UNION ALL SELECT user_id, 0, count(DISTINCT CASE WHEN event_type = 'view' THEN event_id END) FROM p GROUP BY 1)
 SELECT user_id AS "user", sum(m)::BIGINT AS merges, sum(v)::BIGINT AS verdicts, sum(m + v)::BIGINT AS total FROM u GROUP BY 1 ORDER BY total DESC, merges DESC, "user" LIMIT 100""")
def queue_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    last = e.agg(F.max("ts")).first()[0]
    e = e.filter(F.col("ts") >= F.lit(last) - F.expr("INTERVAL 10 DAYS")).withColumn("user", F.col("user_id"))
    merges = e.groupBy("user").agg(F.count_if(F.col("event_type") == "purchase").alias("n"))
    views = e.groupBy("user").agg(F.countDistinct(F.when(F.col("event_type") == "view", F.col("event_id"))).alias("n"))
    return queue.leaderboard(merges, views)


@_query("row_bounds", "SELECT (r / 100)::BIGINT AS page, c_custkey AS upper FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS r FROM customer) WHERE r % 100 = 0")
def row_bounds(spark: SparkSession, d: str) -> DataFrame:
    return queue.page_bounds(_t(spark, d, "customer"), "c_custkey", 100)


# --- review and evaluation --------------------------------------------------------------------


@_query("review_picks", _OLD + f""", r AS (SELECT least(merged_from, merged_into) AS low, greatest(merged_from, merged_into) AS high, CASE WHEN {_duck_bucket("merged_from", 2)} = 0 THEN 'failed' ELSE 'done' END AS outcome, {_duck_bucket("merged_into", 5)} AS attempts FROM old WHERE {_duck_bucket("merged_from || 'r'", 2)} = 0)
 SELECT least(merged_from, merged_into) AS low, greatest(merged_from, merged_into) AS high, o.confidence FROM old o LEFT JOIN r ON low = least(merged_from, merged_into) AND high = greatest(merged_from, merged_into)
 WHERE o.status = 'open' AND (r.outcome IS NULL OR (r.outcome = 'failed' AND r.attempts < 3))""")
def review_picks(spark: SparkSession, d: str) -> DataFrame:
    _, old, _ = _snapshots(spark, d)
    r = old.filter(_bucket(F.concat("merged_from", F.lit("r")), 2) == 0).select(
        F.least("merged_from", "merged_into").alias("low"), F.greatest("merged_from", "merged_into").alias("high"),
        F.when(_bucket(F.col("merged_from"), 2) == 0, "failed").otherwise("done").alias("outcome"), _bucket(F.col("merged_into"), 5).alias("attempts"))
    return review.first_picks(old, r)


@_query("review_budget", "WITH o AS (SELECT o_orderkey, (o_orderkey % 7 + 1)::BIGINT AS cost, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS n FROM orders QUALIFY n <= 2000), s AS (SELECT *, sum(cost) OVER (ORDER BY n) AS spent FROM o) SELECT o_orderkey, n, spent::BIGINT AS spent, ((n - 1) // 5000)::BIGINT AS batch FROM s WHERE spent <= 5000")
def review_budget(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").withColumn("cost", (F.col("o_orderkey") % 7 + 1).cast("long"))
    return review.affordable(o, [F.col("o_totalprice"), F.col("o_orderkey")], "cost", 5000, 2000).select("o_orderkey", F.col("n").cast("long").alias("n"), "spent", F.col("batch").cast("long").alias("batch"))


@_query("review_spend", """WITH e AS (SELECT event_type, count(value) AS n, round((CASE WHEN count(value) >= 200 THEN avg(value) ELSE 0.5 END) * 1.5, 6) AS expected FROM events GROUP BY 1), m AS (SELECT event_type, round(sum(value) FILTER (ts >= date_trunc('month', (SELECT max(ts) FROM events))), 4) AS spent FROM events GROUP BY 1)
 SELECT event_type, n, expected, coalesce(spent, 0) AS spent FROM e JOIN m USING (event_type)""")
def review_spend(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    start = e.agg(F.date_trunc("month", F.max("ts"))).first()[0]
    cost = review.expected_cost(e, "event_type", "value", 0.5).select("event_type", "n", F.round("expected", 6).alias("expected"))
    spent = e.groupBy("event_type").agg(F.coalesce(F.round(F.sum(F.when(F.col("ts") >= F.lit(start), F.col("value"))), 4), F.lit(0.0)).alias("spent"))
    return cost.join(spent, "event_type")


@_query("review_sample", "WITH b AS (SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN '300000' WHEN o_totalprice >= 100000 THEN '100000' WHEN o_totalprice >= 1000 THEN '1000' END AS band FROM orders) SELECT o_orderkey, band FROM b WHERE band IS NOT NULL QUALIFY row_number() OVER (PARTITION BY band ORDER BY md5(o_orderkey::VARCHAR), o_orderkey) <= 20")
def review_sample(spark: SparkSession, d: str) -> DataFrame:
    return review.sample_bands(_t(spark, d, "orders"), F.col("o_totalprice"), [1000, 100000, 300000], 20, "o_orderkey").select("o_orderkey", "band")


@_query("review_parse", """WITH a AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '{"verdict":"same","probability":1.5,"rationale":"x"}' WHEN 1 THEN '{"verdict":"different","probability":0.05,"rationale":"y"}' WHEN 2 THEN '{"verdict":"maybe","probability":0.5,"rationale":"z"}' ELSE 'oops' END AS j FROM orders)
 SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'same' WHEN 1 THEN 'different' END AS verdict, CASE o_orderkey % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.05::DOUBLE END AS probability, CASE o_orderkey % 4 WHEN 0 THEN false WHEN 1 THEN false END AS confirm, CASE o_orderkey % 4 WHEN 0 THEN false WHEN 1 THEN true END AS hidden FROM a""")
def review_parse(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    j = F.when(k == 0, '{"verdict":"same","probability":1.5,"rationale":"x"}').when(k == 1, '{"verdict":"different","probability":0.05,"rationale":"y"}').when(k == 2, '{"verdict":"maybe","probability":0.5,"rationale":"z"}').otherwise("oops")
    a = _t(spark, d, "orders").select("o_orderkey", review.parse_answer(j).alias("a"))
    v, p = F.col("a.verdict"), F.col("a.probability")
    return a.select("o_orderkey", v.alias("verdict"), p.alias("probability"), review.needs_confirmation(v, p).alias("confirm"), review.hides(v, p, F.lit("open")).alias("hidden"))


_RULE = "n_chars >= 1000"
_LAB = f"WITH r AS (SELECT doc_id, {_RULE} AS pred, quality = 1 AS act FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id").filter("quality is not null").select("doc_id", (F.col("n_chars") >= 1000).alias("pred"), (F.col("quality") == 1).alias("act"), "n_chars")


@_query("eval_confusion", _LAB + """, c AS (SELECT count(*) FILTER (pred AND act) AS tp, count(*) FILTER (pred AND NOT act) AS fp, count(*) FILTER (NOT pred AND act) AS fn, count(*) FILTER (NOT pred AND NOT act) AS tn FROM r)
 SELECT tp, fp, fn, tn, coalesce((tp + tn)::DOUBLE / nullif(tp + fp + fn + tn, 0), 0) AS accuracy, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, coalesce((2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c""")
def eval_confusion(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.confusion(_labelled(spark, d), F.col("pred"), F.col("act"))


@_query("eval_gate", _LAB + ", b AS (SELECT doc_id, act AS correct FROM r WHERE doc_id % 10 <> 1), c AS (SELECT doc_id, pred = act AS correct FROM r WHERE doc_id % 10 <> 2) SELECT doc_id, CASE WHEN b.correct IS NULL THEN 'added' WHEN c.correct IS NULL THEN 'removed' WHEN b.correct AND NOT c.correct THEN 'regressed' WHEN NOT b.correct AND c.correct THEN 'fixed' ELSE 'same' END AS change FROM b FULL JOIN c USING (doc_id)")
def eval_gate(spark: SparkSession, d: str) -> DataFrame:
    r = _labelled(spark, d)
    return evaluation.gate(r.filter("doc_id % 10 <> 1").select("doc_id", F.col("act").alias("correct")), r.filter("doc_id % 10 <> 2").select("doc_id", (F.col("pred") == F.col("act")).alias("correct")), "doc_id")


@_query("eval_escalation", _LAB + """, x AS (SELECT 'always' AS rule, true AS up, pred = act AS c, act AS d FROM r UNION ALL SELECT 'never', false, pred = act, act FROM r UNION ALL SELECT 'unsure', doc_id % 3 = 0, pred = act, act FROM r),
 g AS (SELECT rule, count(*) FILTER (up) AS escalated, count(*) FILTER (CASE WHEN up THEN d ELSE c END) AS "right", count(*) AS n FROM x GROUP BY 1) SELECT rule, escalated, "right", escalated::DOUBLE / n AS share, 0.125::DOUBLE + escalated::DOUBLE / n * 4.0::DOUBLE AS mean_cost FROM g""")
def eval_escalation(spark: SparkSession, d: str) -> DataFrame:
    rules = {"always": F.lit(True), "never": F.lit(False), "unsure": F.col("doc_id") % 3 == 0}
    return evaluation.escalation(_labelled(spark, d), rules, F.col("pred") == F.col("act"), F.col("act"), 0.125, 4.0)


# --- graph, JSON, first events, terms, limits -------------------------------------------------

_EDGES = "SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 'r' || r_regionkey, 'r' || (r_regionkey + 1) % 3 FROM region"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Nations to regions, and a cycle among the regions."""
    n = _t(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    r = _t(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("src"), F.concat(F.lit("r"), (F.col("r_regionkey") + 1) % 3).alias("dst"))
    return n.unionByName(r)


_CLOSURE = f"WITH RECURSIVE e AS ({_EDGES}), c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON e.src = c.dst)"


@_query("graph_closure", _CLOSURE + " SELECT src, dst FROM c WHERE src <> dst UNION SELECT src, src FROM e UNION SELECT dst, dst FROM e")
def graph_closure(spark: SparkSession, d: str) -> DataFrame:
    return graph.closure(_edges(spark, d), reflexive=True)


@_query("graph_contains", _CLOSURE + """, p AS (SELECT 'n' || n_nationkey AS x, CASE WHEN n_nationkey % 4 = 0 THEN 'n' || n_nationkey ELSE 'r' || (n_nationkey % 5) END AS y FROM nation), pc AS (SELECT src, dst FROM c WHERE src <> dst),
 h AS (SELECT p.*, CASE WHEN EXISTS (SELECT 1 FROM pc WHERE src = x AND dst = y) THEN y WHEN EXISTS (SELECT 1 FROM pc WHERE src = y AND dst = x) THEN x END AS h FROM p)
 SELECT x, y, CASE WHEN x = y THEN 'equal' WHEN h IS NULL THEN NULL WHEN h IN ('r0', 'r1') THEN 'country' ELSE 'local' END AS level FROM h""")
def graph_contains(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    x = F.concat(F.lit("n"), k)
    p = _t(spark, d, "nation").select(x.alias("x"), F.when(k % 4 == 0, x).otherwise(F.concat(F.lit("r"), k % 5)).alias("y"))
    countries = spark.createDataFrame([("r0",), ("r1",)], "id string")
    return graph.containment(p, graph.closure(_edges(spark, d)), countries)


@_query("json_explode", "WITH j AS (SELECT event_id, unnest(json_keys(props)) AS k, props FROM events) SELECT event_id, k, json_extract_string(props, '$.' || k) AS v FROM j")
def json_explode(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("k", "v"))


@_query("first_revision", "SELECT user_id, min(event_id) AS first_id, arg_min(event_type, event_id) AS first_type, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS tags FROM events GROUP BY 1")
def first_revision(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").groupBy("user_id").agg(
        F.min("event_id").alias("first_id"), F.min_by("event_type", "event_id").alias("first_type"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("tags"))


@_query("term_groups", "SELECT text, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, count(*) AS n FROM conversations GROUP BY text ORDER BY n DESC, text LIMIT 12")
def term_groups(spark: SparkSession, d: str) -> DataFrame:
    g = _t(spark, d, "conversations").groupBy("text").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.col("n").desc(), "text").limit(12)


@_query("window_hits", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS hits FROM events")
def window_hits(spark: SparkSession, d: str) -> DataFrame:
    return limits.hits_in_window(_t(spark, d, "events"), "user_id", "ts", 3600).select("event_id", "hits")


@_query("rate_limit")
def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    return limits.rate_limit(_t(spark, d, "events"), "user_id", "ts", "event_id", 2, 86400)
