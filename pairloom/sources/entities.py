"""Entity dumps: JSON lines to flat items, identifiers and item-valued statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TEXTS = "map<string,struct<language:string,value:string>>"
_SNAK = "struct<snaktype:string,property:string,datatype:string,datavalue:struct<type:string,value:string>>"
SCHEMA = (
    f"id string, type string, lastrevid long, datatype string, labels {_TEXTS}, descriptions {_TEXTS}, "
    "aliases map<string,array<struct<language:string,value:string>>>, sitelinks map<string,struct<site:string,title:string,badges:array<string>>>, "
    f"claims map<string,array<struct<mainsnak:{_SNAK},rank:string>>>, _corrupt string"
)
MAX_SKIPPED = 100
MAX_ID_LENGTH = 512


def scan(spark: SparkSession, path: str, classes: list[str] | None = None, known: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Entities of a dump of one JSON object a line between brackets.

    Lines that do not mention a wanted class, and those whose (id, lastrevid) known has already,
    are dropped as text, before they are parsed. Compressed files are read as Spark reads them;
    ones that cannot be split should be many.
    """
    if path.endswith(".bz2"):
        raise ValueError("bz2 dumps are refused: they inflate too slowly")
    raw = spark.read.text(path).select(F.regexp_replace(F.trim("value"), r",$", "").alias("line")).filter("length(line) > 1")
    if classes:
        # A superset: the exact test is on the parsed statements.
        raw = raw.filter(F.col("line").rlike('"numeric-id":(' + "|".join(c.lstrip("Q") for c in classes) + r")[^0-9]"))
    if known is not None:
        key = raw.withColumn("id", F.regexp_extract("line", r'"id":"(Q\d+)"', 1)).withColumn("lastrevid", F.regexp_extract("line", r'"lastrevid":(\d+)', 1).try_cast("long"))
        raw = key.join(known.select("id", "lastrevid"), ["id", "lastrevid"], "left_anti").select("line")
    if limit is not None:  # the feature: a trial run over some lines
        raw = raw.limit(limit)
    rows = raw.select("line", F.from_json("line", SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("e"))
    return rows.select("line", "e.*")


def split_bad(entities: DataFrame, most: int = MAX_SKIPPED) -> tuple[DataFrame, DataFrame]:
    """(good entities, quarantined lines); raises if more than most lines are bad."""
    bad = entities.filter(F.col("_corrupt").isNotNull() | F.col("id").isNull())
    if bad.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} lines cannot be read")
    return entities.filter(F.col("_corrupt").isNull() & F.col("id").isNotNull()).drop("line", "_corrupt"), bad.select("line")


def best_rank(statements: Column) -> Column:
    """The preferred statements if there are any, else the normal ones."""
    def of(rank: str) -> Column:
        return F.filter(statements, lambda s: s["rank"] == rank)
    return F.when(F.size(of("preferred")) > 0, of("preferred")).otherwise(of("normal"))


def snak_value(s: Column) -> Column:
    """(type, value, unit, globe, latitude, longitude, time_precision) of a main snak; null if it has no value of a known form.

    The unit is that of a quantity that has one, the globe that of a place that is not on the Earth,
    the precision that of a time coarser than a year.
    """
    v, kind, data = s["datavalue"]["value"], s["datavalue"]["type"], s["datatype"]
    def field(name: str) -> Column:
        return F.get_json_object(v, f"$.{name}")
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    def out(t: Column | str, x: Column, unit: Column = text, globe: Column = text, lat: Column = number, lon: Column = number, precision: Column | None = None) -> Column:
        kept = F.lit(None).cast("int") if precision is None else precision
        return F.struct(
            (F.lit(t) if isinstance(t, str) else t).alias("type"), x.alias("value"), unit.alias("unit"), globe.alias("globe"),
            lat.alias("latitude"), lon.alias("longitude"), kept.alias("time_precision"),
        )
    from pairloom.functions.geo import coordinate_text
    from pairloom.functions.temporal import at_precision

    lat, lon = field("latitude").try_cast("double"), field("longitude").try_cast("double")
    on = F.nullif(F.regexp_extract(field("globe"), r"(Q\d+)$", 1), F.lit(""))
    globe = F.when(on != "Q2", on)
    unit = F.nullif(F.regexp_extract(field("unit"), r"(Q\d+)$", 1), F.lit(""))
    precision = field("precision").try_cast("int")
    return (
        F.when(s["snaktype"].isin("somevalue", "novalue"), out(s["snaktype"], F.lit("")))
        .when(kind == "wikibase-entityid", out("item", field("id")))
        .when(kind == "time", out("time", at_precision(field("time"), precision), precision=F.when(precision < 9, precision)))
        .when(kind == "quantity", out("quantity", F.regexp_replace(field("amount"), r"^\+", ""), unit=unit))
        .when(kind == "monolingualtext", out("string", field("text")))
        .when(kind == "globecoordinate", out("coordinate", coordinate_text(lat, lon, globe), globe=globe, lat=lat, lon=lon))
        .when(kind == "string", out(F.when(data.isin("external-id", "url", "musical-notation"), data).otherwise(F.lit("string")), v))
    )


def to_items(entities: DataFrame) -> DataFrame:
    """Flat items: texts by language, titles by site and best-rank values by property."""
    values = F.transform_values("claims", lambda _, s: F.filter(F.transform(best_rank(s), lambda x: snak_value(x["mainsnak"])), lambda v: v.isNotNull()))
    items = entities.select(
        "id", "lastrevid",
        F.transform_values("labels", lambda _, x: x["value"]).alias("labels"),
        F.transform_values("descriptions", lambda _, x: x["value"]).alias("descriptions"),
        F.transform_values("aliases", lambda _, x: F.transform(x, lambda a: a["value"])).alias("aliases"),
        F.transform_values("sitelinks", lambda _, x: x["title"]).alias("sitelinks"),
        F.map_filter(values, lambda _, v: F.size(v) > 0).alias("statements"),
    )
    first = F.filter(F.try_element_at("statements", F.lit("P31")), lambda v: v["type"] == "item")
    return items.withColumn("primary_type", F.get(first, 0)["value"]).withColumn("primary_label", primary_label(F.col("labels")))


def primary_label(labels: Column) -> Column:
    """English, then multilingual, then the first that is not empty; cut to 255 characters."""
    any_ = F.get(F.filter(F.map_values(labels), lambda v: v != ""), 0)
    best = F.coalesce(F.nullif(F.try_element_at(labels, F.lit("en")), F.lit("")), F.nullif(F.try_element_at(labels, F.lit("mul")), F.lit("")), any_)
    return F.when(F.length(best) > 255, F.concat(F.substring(best, 1, 255), F.lit("…"))).otherwise(best)


def of_class(items: DataFrame, classes: list[str]) -> DataFrame:
    return items.filter(F.exists(F.try_element_at("statements", F.lit("P31")), lambda v: (v["type"] == "item") & v["value"].isin(*classes)))


def external_ids(items: DataFrame) -> DataFrame:
    """(id, property, value), once each; values over 512 characters are left out."""
    rows = items.select("id", F.explode("statements").alias("property", "vs")).select("id", "property", F.explode("vs").alias("v"))
    return rows.filter((F.col("v.type") == "external-id") & (F.length("v.value") <= MAX_ID_LENGTH)).select("id", "property", "v.value").distinct()


def item_values(items: DataFrame, properties: list[str]) -> DataFrame:
    rows = items.select("id", F.explode("statements").alias("property", "vs")).filter(F.col("property").isin(*properties))
    return rows.select("id", "property", F.explode("vs").alias("v")).filter("v.type = 'item'").select("id", "property", "v.value").distinct()


def property_rows(entities: DataFrame) -> DataFrame:
    """(pid, label, datatype, formatter) of property entities that have an English label; formatter: the first of P1630."""
    rows = entities.filter("type = 'property'").withColumn("_f", F.get(best_rank(F.try_element_at("claims", F.lit("P1630"))), 0))
    label = F.try_element_at("labels", F.lit("en"))["value"]
    return rows.filter(label.isNotNull()).select(F.col("id").alias("pid"), label.alias("label"), "datatype", F.col("_f.mainsnak.datavalue.value").alias("formatter"))


def selective(items: DataFrame, classes: list[str], linked: DataFrame, occupations: list[str], identifiers: list[str]) -> DataFrame:
    """items, of those of classes only such as are linked, have one of the occupations (P106) or an identifier of the list."""
    def any_item(pid: str, wanted: list[str]) -> Column:
        return F.coalesce(F.exists(F.try_element_at("statements", F.lit(pid)), lambda v: (v["type"] == "item") & v["value"].isin(*wanted)), F.lit(False))

    own = F.arrays_overlap(F.map_keys("statements"), F.array(*map(F.lit, identifiers))) if identifiers else F.lit(False)
    known = linked.select(F.col("id").alias("_linked")).distinct()
    out = items.join(known, F.col("id") == F.col("_linked"), "left")
    return out.filter(~any_item("P31", classes) | F.col("_linked").isNotNull() | any_item("P106", occupations) | own).drop("_linked")


def restamp(sync: DataFrame, seen: DataFrame, stamp: str) -> DataFrame:
    """sync (id, lastrevid, stamp) with a new stamp on the revisions in seen (id, lastrevid), which were not parsed again."""
    hit = seen.select("id", "lastrevid", F.lit(True).alias("_seen")).distinct()
    out = sync.join(hit, ["id", "lastrevid"], "left")
    return out.withColumn("stamp", F.when(F.col("_seen"), F.lit(stamp)).otherwise(F.col("stamp"))).drop("_seen")
