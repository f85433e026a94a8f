"""String normalisation, keys and similarities as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"(?U)\s+"
#: Characters that stand for an apostrophe. Fixed values.
APOSTROPHES = "‘’‛ʼʹ′`´"
#: Roman numerals by value, for installments up to 20.
ROMAN = dict(enumerate("I II III IV V VI VII VIII IX X XI XII XIII XIV XV XVI XVII XVIII XIX XX".split(), 1))


def normalize(c: Column) -> Column:
    """Lower case, trimmed, one kind of apostrophe, without scheme, www. and trailing slash, single spaces."""
    c = F.regexp_replace(F.lower(c), r"(?U)^\s+|\s+$", "")
    c = F.translate(c, APOSTROPHES, "'" * len(APOSTROPHES))
    c = F.regexp_replace(c, r"^https?://(www\.)?", "")
    c = F.regexp_replace(c, r"/+$", "")
    return F.regexp_replace(c, _SPACE, " ")


def blocking_key(c: Column) -> Column:
    """normalize() with runs of anything but letters, digits and spaces as one space; null if nothing is left."""
    c = F.regexp_replace(normalize(c), r"[^\p{L}\p{N}\s]+", " ")
    c = F.substring(F.trim(F.regexp_replace(c, _SPACE, " ")), 1, 255)
    return F.nullif(c, F.lit(""))


def similarity(a: Column, b: Column) -> Column:
    """1 less edit distance over the longer length, in code points; 1 for equal strings."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longer)


def similarity_at_least(a: Column, b: Column, least: float) -> Column:
    """similarity() where the lengths allow least, else the bound that they allow; spares the distance."""
    longer, shorter = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    bound = shorter / longer
    return F.when(a == b, 1.0).when(bound < least, bound).otherwise(1.0 - F.levenshtein(a, b) / longer)


def words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalize(c), " "), lambda w: w != ""))


def word_overlap(a: Column, b: Column) -> Column:
    """Dice coefficient of the word sets; 0 if both are empty."""
    x, y = words(a), words(b)
    both = F.size(x) + F.size(y)
    return F.when(both == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / both)


def best_name_similarity(a: Column, b: Column) -> Column:
    """The highest similarity over two arrays of names; an equal pair answers at once, an empty side is 0."""
    x, y = (F.array_distinct(F.transform(n, normalize)) for n in (a, b))
    best = F.aggregate(
        x, F.lit(0.0), lambda m, p: F.greatest(m, F.coalesce(F.array_max(F.transform(y, lambda q: similarity(p, q))), F.lit(0.0)))
    )
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).when(F.arrays_overlap(x, y), 1.0).otherwise(best)


def schemeless_url(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^[a-z]+://", ""), r"/+$", "")


def doi_of(c: Column) -> Column:
    """The DOI in a doi.org address, lower-cased; null without one."""
    return F.nullif(F.lower(F.regexp_extract(c, r"^https?://(?:dx\.)?doi\.org/(10\.\S+)$", 1)), F.lit(""))


def compare_urls(a: Column, b: Column) -> Column:
    same_doi = F.coalesce(doi_of(a) == doi_of(b), F.lit(False))
    return (
        F.when(a == b, "identical")
        .when(schemeless_url(a) == schemeless_url(b), "identical")
        .when(normalize(a) == normalize(b), "similar")
        .when(same_doi, "similar")
        .otherwise("distinct")
    )


def is_slug_split(a: Column, b: Column) -> Column:
    """Whether one slug is the other with a number: `--N` on either side, or `-N` of up to three digits on both."""
    def stem(c: Column, p: str) -> Column:
        return F.regexp_replace(c, p, "")
    double = (a != b) & (stem(a, r"--\d+$") == stem(b, r"--\d+$"))
    single = a.rlike(r"-\d{1,3}$") & b.rlike(r"-\d{1,3}$") & (a != b) & (stem(a, r"-\d{1,3}$") == stem(b, r"-\d{1,3}$"))
    return double | single


def installment(c: Column) -> Column:
    """(base, number) of a title that ends in an Arabic or Roman number; number is null without one.

    A bracketed number of 1000 or more is a year, not an installment.
    """
    c = F.trim(c)
    arabic = F.regexp_extract(c, r"^(.*?)[\s#(]*(\d{1,4})\)?$", 2)
    roman = F.upper(F.regexp_extract(c, r"^(.*\s)([IVXivx]+)$", 2))
    value = F.coalesce(*[F.when(roman == r, F.lit(n)) for n, r in ROMAN.items()])
    year = c.rlike(r"\(\d{4}\)$")
    number = F.when((arabic != "") & ~year, arabic.cast("int")).otherwise(value)
    base = F.when((arabic != "") & ~year, F.regexp_extract(c, r"^(.*?)[\s#(]*(\d{1,4})\)?$", 1)).when(
        value.isNotNull(), F.regexp_extract(c, r"^(.*\s)([IVXivx]+)$", 1)
    ).otherwise(c)
    return F.struct(F.trim(base).alias("base"), number.alias("number"))


def phone_digits(c: Column) -> Column:
    """Digits of a phone number without extension, international prefix 00 or a bracketed trunk 0; null if none."""
    c = F.regexp_replace(F.lower(c), r"(ext|x).*$", "")
    c = F.regexp_replace(c, r"\(0\)", "")
    c = F.regexp_replace(c, r"[^0-9]", "")
    return F.nullif(F.regexp_replace(c, r"^00", ""), F.lit(""))


def same_phone(a: Column, b: Column) -> Column:
    """Equal digits, or one number ends in the other's digits after a trunk 0, eight at least."""
    x, y = phone_digits(a), phone_digits(b)
    p, q = F.regexp_replace(x, "^0", ""), F.regexp_replace(y, "^0", "")
    long = F.least(F.length(p), F.length(q)) >= 8
    return (x == y) | (long & (x.startswith("0") | y.startswith("0")) & (p.endswith(q) | q.endswith(p)))


def title_years(c: Column) -> Column:
    """Distinct years from 1000 to 2999 that stand alone, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\b([12][0-9]{3})\b"), 1), lambda y: y.cast("int"))))


def site_language(host: Column) -> Column:
    """The language label that a host begins with, if any."""
    return F.nullif(F.regexp_extract(host, r"^([a-z]{2,3})\.", 1), F.lit(""))


def _plain(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


def difference_kind(a: Column, b: Column) -> Column:
    """What alone explains a difference: same, case, accents, punctuation, spacing or words."""

    @F.pandas_udf("string")
    def kind(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(p: str | None, q: str | None) -> str | None:
            if p is None or q is None:
                return None
            if p == q:
                return "same"
            if p.casefold() == q.casefold():
                return "case"
            p, q = p.casefold(), q.casefold()
            if _plain(p) == _plain(q):
                return "accents"
            if "".join(p.split()) == "".join(q.split()):
                return "spacing"
            bare = ["".join(c for c in s if c.isalnum() or c.isspace()).split() for s in (p, q)]
            return "punctuation" if bare[0] == bare[1] else "words"

        return pd.Series([one(p, q) for p, q in zip(x, y, strict=True)])

    return kind(a, b)


def fold_native_name(c: Column) -> Column:
    """NFKC, without bracketed parts and separators, katakana as hiragana."""

    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        import re

        def one(v: str | None) -> str | None:
            if v is None:
                return None
            v = re.sub(r"\([^)]*\)|[\s・·=\-]+", "", unicodedata.normalize("NFKC", v))
            return "".join(chr(ord(c) - 0x60) if "ァ" <= c <= "ヶ" else c for c in v)

        return s.map(one)

    return fold(c)


def encode_languages(langs: Column) -> Column:
    """,de,es: every code after a comma, ascending, once; empty for none, null for not known."""
    return F.array_join(F.transform(F.array_sort(F.array_distinct(langs)), lambda x: F.concat(F.lit(","), x)), "")


def normalize_languages(langs: Column, most: int = 50) -> Column:
    """Language codes in lower case, trimmed, once each, in their order; others are dropped, and so is what exceeds most."""
    plain = F.transform(langs, lambda x: F.lower(F.trim(x)))
    return F.slice(F.array_distinct(F.filter(plain, lambda x: x.rlike(r"^[a-z]{2,12}(-[a-z0-9]{1,12})*$"))), 1, most)


def normalize_user_name(c: Column) -> Column:
    """Underscores as spaces, single, trimmed, the first letter a capital; null if nothing is left."""
    c = F.trim(F.regexp_replace(c, "[_ ]+", " "))
    return F.nullif(F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2))), F.lit(""))


def canonical_json(entries: Column) -> Column:
    """JSON of a map with its keys in order, so that equal maps give equal texts."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def disjoint(a: Column, b: Column) -> Column:
    """Whether two arrays that both have values share none."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def one_within_other(a: Column, b: Column) -> Column:
    """Whether all values of one array are in the other."""
    return (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)


def name_within_name(a: Column, b: Column) -> Column:
    """Whether a name of one side is a part of one of the other's."""
    return F.exists(a, lambda x: F.exists(b, lambda y: F.contains(x, y) | F.contains(y, x)))


def chunks(values: Column, size: int) -> Column:
    """An array cut into arrays of size."""
    n = F.ceil(F.size(values) / size).cast("int")
    return F.when(n == 0, F.array().cast("array<array<string>>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(values, i * size + 1, size)))
