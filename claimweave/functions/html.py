"""Page metadata and visible text by native regular expressions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .urls import bound

#: The named references that are decoded; others stay.
NAMED = {"amp": "&", "apos": "'", "gt": ">", "lt": "<", "nbsp": " ", "quot": '"'}
INVISIBLE = ("script", "style", "noscript", "svg", "nav", "header", "footer")
#: Types of JSON-LD objects that describe a page, and the fields in order of where they come from.
ARTICLE_TYPES = ("article", "newsarticle", "report", "webpage", "blogposting")
FIELDS = ("title", "author", "publisher", "published_at", "description", "language")
_SPACE = "[\\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"
_REFERENCE = "&([a-zA-Z][a-zA-Z0-9]+|#[0-9]+|#x[0-9a-fA-F]+);"


def _character(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def decoded(text: Column) -> Column:
    """References decoded in one pass: decimal, hexadecimal and the named ones above."""
    named = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])

    def meaning(r: Column) -> Column:
        code = F.when(F.startswith(r, F.lit("#x")), F.conv(F.substr(r, F.lit(3)), 16, 10)).when(F.startswith(r, F.lit("#")), F.substr(r, F.lit(2))).try_cast("long")
        number = bound(code, lambda c: F.when(c.between(1, 0x10FFFF) & ~c.between(0xD800, 0xDFFF), _character(c)))
        return F.when(r == "", "").otherwise(F.coalesce(number, F.try_element_at(named, r), F.concat(F.lit("&"), r, F.lit(";"))))

    def one_pass(x: Column) -> Column:
        references = F.concat(F.regexp_extract_all(x, F.lit(_REFERENCE), F.lit(1)), F.array(F.lit("")))
        joined = F.array_join(F.zip_with(F.split(x, _REFERENCE, -1), references, lambda p, r: F.concat(p, meaning(r))), "")
        return F.when(F.contains(x, F.lit("&")), joined).otherwise(x)

    return bound(text, one_pass)


def tidy(text: Column) -> Column:
    """Decoded, white space collapsed and trimmed; nothing left: null."""
    return F.nullif(F.trim(F.regexp_replace(decoded(text), _SPACE, " ")), F.lit(""))


def region(html: Column) -> Column:
    """The inside of the first article, else main, else body, else all."""
    inner = [F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1) for tag in ("article", "main", "body")]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in inner], html)


def visible_text(html: Column) -> Column:
    """Text of the region, without invisible elements."""
    kept = F.regexp_replace(region(html), "(?s)<!--.*?--!?>", " ")
    for tag in INVISIBLE:
        kept = F.regexp_replace(kept, rf"(?is)<{tag}\b.*?</{tag}\b[^>]*>", " ")
    return tidy(F.regexp_replace(kept, "(?s)<[^>]*>", " "))


def first(html: Column, tag: str) -> Column:
    return tidy(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), "(?s)<[^>]*>", " "))


def attribute(tag: Column, name: str) -> Column:
    """An attribute's tidied value; null if it is absent or blank."""
    found = rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+))"
    return tidy(F.concat(*[F.regexp_extract(tag, found, i) for i in (1, 2, 3)]))


def lang(html: Column) -> Column:
    return attribute(F.regexp_extract(html, r"(?is)(<html\b[^>]*>)", 1), "lang")


def meta(html: Column) -> Column:
    """(name, property, itemprop: in lower case; content) of each meta element with content."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<meta\b[^>]*>)"), F.lit(1))
    kinds = ("name", "property", "itemprop")
    told = F.transform(tags, lambda t: F.struct(*[F.lower(attribute(t, k)).alias(k) for k in kinds], attribute(t, "content").alias("content")))
    return F.filter(told, lambda e: e["content"].isNotNull())


def _last(elements: Column, kind: str, *keys: str) -> Column:
    """The content of the last element of the first key that one has."""
    return F.coalesce(*[F.try_element_at(F.filter(elements, _is(kind, k)), F.lit(-1))["content"] for k in keys])


def _is(kind: str, key: str):
    return lambda e: e[kind] == key


def _named(value) -> str | None:
    """A name in a JSON-LD value: of the first of a list that has one, of an object, or the value itself."""
    if isinstance(value, list):
        return next((x for x in map(_named, value) if x), None)
    if isinstance(value, dict):
        return _string(value.get("name")) or _string(value.get("headline"))
    return _string(value)


def _string(value) -> str | None:
    if isinstance(value, bool):
        return None
    if isinstance(value, (int, float)):
        return str(int(value) if isinstance(value, float) and value.is_integer() else value)
    return _plain(value) if isinstance(value, str) else None


def _plain(text: str) -> str | None:
    """``tidy`` of one string."""

    def meaning(m: re.Match) -> str:
        r = m[1]
        if r[0] != "#":
            return NAMED.get(r, m[0])
        code = int(r[2:], 16) if r[1] == "x" else int(r[1:])
        return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else m[0]

    return " ".join(re.sub(_REFERENCE, meaning, text).replace("\ufeff", " ").split()) or None


def _objects(value) -> list[dict]:
    """An object and what its @graph holds, through lists."""
    if isinstance(value, list):
        return [o for x in value for o in _objects(x)]
    return [value, *_objects(value.get("@graph"))] if isinstance(value, dict) else []


def json_ld_fields(scripts: list[str]) -> dict[str, str | None]:
    """FIELDS of decoded JSON-LD scripts: of each, the first object of an article's type, else the first; earlier scripts win.

    A script that is no JSON is passed over.
    """
    out: dict[str, str | None] = dict.fromkeys(FIELDS)
    for script in scripts:
        try:
            objects = _objects(json.loads(script))
        except ValueError:
            continue
        kinds = lambda o: o.get("@type") if isinstance(o.get("@type"), list) else [o.get("@type")]
        article = next((o for o in objects if any((_string(k) or "").lower() in ARTICLE_TYPES for k in kinds(o))), objects[0] if objects else None)
        if article is None:
            continue
        told = {
            "title": _string(article.get("headline")) or _string(article.get("name")), "author": _named(article.get("author")), "publisher": _named(article.get("publisher")),
            "published_at": _string(article.get("datePublished")) or _string(article.get("dateCreated")), "description": _string(article.get("description")), "language": _string(article.get("inLanguage")),
        }
        for field, value in told.items():
            out[field] = out[field] or value
    return out


def json_ld(decoded_scripts: Column) -> Column:
    """FIELDS of each row's decoded JSON-LD scripts: nesting without bound is beyond native expressions; few rows have scripts."""

    @F.pandas_udf(StructType([StructField(f, StringType()) for f in FIELDS]))
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([json_ld_fields(list(x) if x is not None else []) for x in values], columns=list(FIELDS), dtype=object)

    return run(decoded_scripts)


def scripts(html: Column) -> Column:
    """The decoded bodies of JSON-LD scripts."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script\b[^>]*>"), F.lit(1))
    return F.transform(found, decoded)


def collected() -> dict[str, dict[str, Column]]:
    """Fields by where they come from, in order of precedence, of rows with __html, __ld (fields of ``json_ld``), __meta and __region."""
    m, html = F.col("__meta"), F.col("__html")
    name, prop, item = (lambda *k: _last(m, "name", *k)), (lambda *k: _last(m, "property", *k)), (lambda *k: _last(m, "itemprop", *k))
    times = F.regexp_extract(html, r"(?is)(<time\b[^>]*itemprop\s*=\s*[\"']datePublished[\"'][^>]*>)", 1)
    return {
        "jsonLd": {f: F.col(f"__ld.{f}") for f in FIELDS},
        "schemaOrg": {"title": item("headline", "name"), "author": item("author"), "publisher": item("publisher"), "published_at": F.coalesce(item("datepublished", "datecreated"), attribute(times, "datetime")), "description": item("description"), "language": item("inlanguage")},
        "openGraph": {"title": F.coalesce(prop("og:title"), name("twitter:title")), "author": prop("article:author"), "publisher": prop("og:site_name"), "published_at": prop("article:published_time"), "description": F.coalesce(prop("og:description"), name("twitter:description")), "language": prop("og:locale")},
        "html": {"title": first(html, "title"), "author": name("author"), "publisher": name("publisher", "application-name"), "published_at": name("date", "dc.date", "dc.date.issued"), "description": name("description"), "language": lang(html)},
        "visibleContent": {"title": first(F.col("__region"), "h1")},
    }


def metadata(df: DataFrame, html: str = "html") -> DataFrame:
    """``df`` with the page's FIELDS, text, extraction_status and field_sources (where each field comes from).

    The first source that has a field gives it: JSON-LD, itemprop, OpenGraph, plain elements, visible content.  A date that
    cannot be read wins all the same, and is null in the end; languages that are none do not win.
    """
    from .text import language

    page = F.coalesce(F.col(html), F.lit(""))
    ld = json_ld(F.when(F.contains(F.lower(page), F.lit("ld+json")), scripts(page)).otherwise(F.array().cast("array<string>")))
    told = df.withColumn("__html", page).withColumn("__ld", ld).withColumn("__meta", meta(F.col("__html"))).withColumn("__region", region(F.col("__html"))).withColumn("text", visible_text(F.col("__html")))
    found = [(source, f, (bound(tidy(c), language) if f == "language" else tidy(c))) for source, fields in collected().items() for f, c in fields.items()]
    told = told.withColumns({f"__{source}_{f}": c for source, f, c in found})
    of = {f: [(source, F.col(f"__{source}_{f}")) for source, g, _ in found if g == f] for f in FIELDS}
    told = told.withColumns({f: F.coalesce(*[c for _, c in of[f]]) for f in FIELDS})
    origin = {f: F.coalesce(*[F.when(c.isNotNull(), F.lit(source)) for source, c in of[f]]) for f in FIELDS}
    any_field, text = F.coalesce(*FIELDS).isNotNull(), F.col("text")
    status = F.when(~any_field & text.isNull(), "FAILED").when(text.isNull(), "METADATA_ONLY").when(F.col("title").isNotNull(), "SUCCESS").otherwise("PARTIAL")
    sources = F.map_filter(F.create_map(*[x for f in FIELDS for x in (F.lit(f), origin[f])], F.lit("text"), F.when(text.isNotNull(), F.lit("visibleContent"))), lambda _, v: v.isNotNull())
    day = F.col("published_at")
    published = F.coalesce(day.try_cast("timestamp"), F.try_to_timestamp(F.regexp_replace(day, "^[A-Za-z]{3}, *", ""), F.lit("d MMM yyyy HH:mm:ss z")))
    told = told.withColumns({"extraction_status": status, "field_sources": sources}).withColumn("published_at", published)
    return told.drop(*[c for c in told.columns if c.startswith("__")])
