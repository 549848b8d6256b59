"""Feeds and sitemaps: items of RSS, Atom and sitemap documents, and the walk of sitemap indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import decoded


def _inner(block: Column, tag: str) -> Column:
    raw = F.regexp_extract(block, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)
    return F.trim(decoded(F.regexp_replace(raw, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")))


def kind(xml: Column) -> Column:
    return F.when(xml.rlike("(?i)<sitemapindex[\\s>]"), "SITEMAP_INDEX").when(xml.rlike("(?i)<urlset[\\s>]"), "SITEMAP").when(xml.rlike("(?i)<(rss|rdf:RDF)[\\s>]"), "RSS").when(xml.rlike("(?i)<feed[\\s>]"), "ATOM")


def items(documents: DataFrame) -> DataFrame:
    """(source_id, kind, url, title, published) of each item in ``documents`` (source_id, xml); unknown kinds give none."""
    typed = documents.select("source_id", "xml", kind(F.col("xml")).alias("kind"))
    tag = F.when(F.col("kind") == "SITEMAP_INDEX", "sitemap").when(F.col("kind") == "SITEMAP", "url").when(F.col("kind") == "RSS", "item").otherwise("entry")
    pattern = F.concat(F.lit("(?is)(<"), tag, F.lit("\\b[^>]*>.*?</"), tag, F.lit("\\s*>)"))
    blocks = typed.where("kind is not null").select("source_id", "kind", F.explode(F.regexp_extract_all("xml", pattern, F.lit(1))).alias("block"))
    b = F.col("block")
    alternate = F.regexp_extract(b, r"(?is)<link\b[^>]*rel=[\"']alternate[\"'][^>]*href=[\"']([^\"']*)[\"']", 1)
    anylink = F.regexp_extract(b, r"(?is)<link\b[^>]*href=[\"']([^\"']*)[\"']", 1)
    has_link = b.rlike("(?i)<link\\b[^>]*>")
    rss = F.when(has_link, _inner(b, "link")).otherwise(_inner(b, "guid"))
    url = F.when(F.col("kind").isin("SITEMAP", "SITEMAP_INDEX"), _inner(b, "loc")).when(F.col("kind") == "RSS", rss).otherwise(F.when(alternate != "", alternate).otherwise(anylink))
    day = F.when(F.col("kind").isin("SITEMAP", "SITEMAP_INDEX"), _inner(b, "lastmod")).when(F.col("kind") == "RSS", F.regexp_replace(_inner(b, "pubDate"), "^[A-Za-z]{3}, *", "")).otherwise(_inner(b, "updated"))
    published = F.coalesce(F.try_to_timestamp(day), F.try_to_timestamp(day, F.lit("d MMM yyyy HH:mm:ss z")))
    return blocks.select("source_id", "kind", url.alias("url"), F.nullif(_inner(b, "title"), F.lit("")).alias("title"), published.alias("published")).where("url <> ''")


def run_status(candidates: Column, errors: Column) -> Column:
    return F.when(errors == 0, "SUCCEEDED").when(candidates > 0, "PARTIAL").otherwise("FAILED")


#: Fixed value: why an index is not followed.
TOO_DEEP = "Sitemap recursion depth exceeded."


def walk(children: DataFrame, roots: DataFrame, most: int = 3) -> DataFrame:
    """(root, url, depth, error) below ``roots`` (url) along ``children`` (parent, child): a loop of at most ``most`` joins.

    What lies at depth ``most`` and has children itself is not followed, and has an error.
    """
    level = roots.select(F.col("url").alias("root"), "url", F.lit(0).alias("depth"))
    out = level
    for depth in range(1, most + 1):
        level = level.join(children, level.url == children.parent).select("root", F.col("child").alias("url"), F.lit(depth).alias("depth"))
        out = out.union(level)
    parents = children.select(F.col("parent").alias("url"), F.lit(most).alias("depth"), F.lit(TOO_DEEP).alias("error")).distinct()
    return out.join(parents, ["url", "depth"], "left").select("root", "url", "depth", "error")


def candidate_errors(found: DataFrame) -> DataFrame:
    """(discovery_url, url, reason, depth) of found items (discovery_url, url, canonical_url, depth) that make no candidate."""
    return found.where(F.col("canonical_url").isNull()).select("discovery_url", "url", F.lit("Only http and https URLs can be ingested.").alias("reason"), "depth")  # a fixed value


def pending(candidates: DataFrame, run: object = None) -> DataFrame:
    """Candidates that wait to be fetched, of one crawl run if it is given."""
    waiting = candidates.where(F.col("status") == "PENDING")
    return waiting if run is None else waiting.where(F.col("crawl_run_id") == F.lit(run))


def submit(given: DataFrame, candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    """(canonical_url, candidate_id, job_id, reused_candidate, reused_job) of submitted urls (canonical_url), one for each.

    candidates: canonical_url, candidate_id; jobs: id, url_candidate_id, job_kind, status.  A known candidate and its active fetch
    job are reused; new ones get an id from the url.
    """
    active = jobs.where((F.col("job_kind") == "FETCH_URL") & F.col("status").isin("PENDING", "RUNNING")).groupBy(F.col("url_candidate_id").alias("candidate_id")).agg(F.min("id").alias("job"))
    known = given.select("canonical_url").distinct().join(candidates, "canonical_url", "left").join(active, "candidate_id", "left")
    fresh = F.sha2("canonical_url", 256)
    return known.select("canonical_url", F.coalesce(F.col("candidate_id").cast("string"), fresh).alias("candidate_id"), F.coalesce(F.col("job").cast("string"), F.concat(F.lit("FETCH_URL:"), fresh)).alias("job_id"), F.col("candidate_id").isNotNull().alias("reused_candidate"), F.col("job").isNotNull().alias("reused_job"))


#: What a submitted url's metadata say beside what was there; fixed names.
MANUAL, SUBMITTED = "manualSubmission", "lastManualSubmissionAt"


def submissions(given: DataFrame, candidates: DataFrame, jobs: DataFrame, at: str) -> DataFrame:
    """The rows that submitted urls (source_id, url, canonical_url) make: one for each source and canonical url, the least url told.

    candidates: id, source_id, canonical_url, crawl_run_id, metadata (map of strings); jobs: id, url_candidate_id, job_kind, status.  A known
    candidate is PENDING again, keeps its other metadata and is marked as submitted; its active fetch job is reused, else ``job`` is a
    new one (struct), due at once.  Urls without a canonical form make nothing.
    """
    iso = F.date_format(F.lit(at).cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    keys = ["source_id", "canonical_url"]
    asked = given.where("canonical_url IS NOT NULL").groupBy(*keys).agg(F.min(F.trim("url")).alias("original_url"))
    known = candidates.groupBy(*keys).agg(F.min(F.struct("id", "crawl_run_id", F.map_entries("metadata").alias("entries"))).alias("known"))
    active = jobs.where((F.col("job_kind") == "FETCH_URL") & F.col("status").isin("PENDING", "RUNNING")).groupBy(F.col("url_candidate_id").cast("string").alias("candidate_id")).agg(F.min("id").cast("string").alias("active"))
    joined = asked.join(known, keys, "left")
    fresh = F.sha2(F.concat_ws("|", F.col("source_id").cast("string"), "canonical_url"), 256)
    named = joined.withColumn("candidate_id", F.coalesce(F.col("known.id").cast("string"), fresh)).join(active, "candidate_id", "left")
    kept = F.filter(F.coalesce("known.entries", F.array().cast("array<struct<key:string,value:string>>")), lambda e: ~e["key"].isin(MANUAL, SUBMITTED))
    metadata = F.map_from_entries(F.concat(kept, F.array(F.struct(F.lit(MANUAL).alias("key"), F.lit("true").alias("value")), F.struct(F.lit(SUBMITTED).alias("key"), iso.alias("value")))))
    job = F.struct("source_id", F.col("known.crawl_run_id").alias("crawl_run_id"), F.col("candidate_id").alias("url_candidate_id"), F.lit("FETCH_URL").alias("job_kind"), F.lit("PENDING").alias("status"), F.lit(0).alias("attempts"), F.lit(3).alias("max_attempts"), iso.alias("scheduled_at"), F.create_map(F.lit("canonicalUrl"), F.col("canonical_url"), F.lit(MANUAL), F.lit("true")).alias("metadata"))
    return named.select("candidate_id", "source_id", F.lit("MANUAL").alias("discovery_type"), "original_url", "canonical_url", F.lit("PENDING").alias("status"), metadata.alias("metadata"), F.col("known").isNotNull().alias("reused_candidate"), F.col("active").isNotNull().alias("reused_job"), F.coalesce("active", F.concat(F.lit("FETCH_URL:"), "candidate_id")).alias("job_id"), F.when(F.col("active").isNull(), job).alias("job"))


def clamped(value, low: int, high: int):
    """A form's number as a whole one between bounds; what is none is the lower one."""
    number = value.try_cast("double")
    sound = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    towards_zero = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))
    return F.when(sound, F.least(F.lit(high), F.greatest(F.lit(low), towards_zero))).otherwise(F.lit(low)).cast("int")


def saved_sources(forms: DataFrame) -> DataFrame:
    """Rows of the source registry from its form (id, name, domain, source_type, source_quality, requests_per_minute and concurrency as text, and flags, which stay)."""
    from ..functions.urls import domain

    changed = {"name": F.trim("name"), "domain": domain(F.col("domain")), "requests_per_minute": clamped(F.col("requests_per_minute"), 0, 600), "concurrency": clamped(F.col("concurrency"), 1, 10)}
    return forms.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in forms.columns])


def registry(sources: DataFrame, saved: DataFrame) -> DataFrame:
    """The registry after saves: a saved row replaces that of its id (the last by updated_at counts), newest first."""
    from .jobs import latest

    last = latest(saved, ["id"], [F.desc("updated_at")])
    return sources.join(last.select("id"), "id", "left_anti").unionByName(last.select(*sources.columns)).orderBy(F.desc("updated_at"), "id")
