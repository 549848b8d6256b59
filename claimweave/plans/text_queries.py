"""Queries of URLs, pages, feeds, text, resolution and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..bridge import Bridge
from ..functions import html, text, urls
from ..operators import discovery, jobs, resolution, validation
from ..ontology import NEGATIONS
from ..written import sorted_in, written
from .registry import query

_TRACK = "('fbclid', 'gclid', 'mc_cid', 'mc_eid', 'msclkid', 'amp', 'amp_js_v', 'usqp')"


def _canonical_sql(source: str) -> str:
    """For urls with lower-case scheme and host, one amp or print segment at most, and plain parameters."""
    return f"""SELECT *, regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/' || array_to_string(list_filter(string_split(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '' AND s <> 'amp' AND s <> 'print'), '/')
   || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_') AND split_part(p, '=', 1) NOT IN {_TRACK})), '&'), ''), '') AS canonical FROM ({source})"""


_VARIANTS = "SELECT page_id, url FROM pages UNION ALL SELECT page_id + 1000000, regexp_replace(url, '(://[^/]*)/', '\\1/amp/') || CASE WHEN contains(url, '?') OR contains(url, '#') THEN '' ELSE '?utm_campaign=x&b=2&a=1&gclid=7' END FROM pages"


def _variants(b: Bridge) -> DataFrame:
    plain = F.contains("url", F.lit("?")) | F.contains("url", F.lit("#"))
    more = b("pages").select((F.col("page_id") + 1000000).alias("page_id"), F.concat(F.regexp_replace("url", "(://[^/]*)/", "$1/amp/"), F.when(plain, "").otherwise("?utm_campaign=x&b=2&a=1&gclid=7")).alias("url"))
    return b("pages").select("page_id", "url").union(more)


@query("url_canonical", f"SELECT page_id, canonical FROM ({_canonical_sql(_VARIANTS)})")
def url_canonical(b: Bridge) -> DataFrame:
    return _variants(b).select("page_id", urls.canonical(F.col("url")).alias("canonical"))


@query("url_candidates", f"SELECT (page_id % 7)::BIGINT AS source_id, canonical AS canonical_url, CASE WHEN count(*) > 1 THEN count(*) END AS discovery_count, 'PENDING' AS status FROM ({_canonical_sql(_VARIANTS)}) GROUP BY ALL")
def url_candidates(b: Bridge) -> DataFrame:
    found = _variants(b).select((F.col("page_id") % 7).alias("source_id"), urls.canonical(F.col("url")).alias("canonical_url"), F.col("url").alias("title"), F.col("page_id").alias("at"), F.col("page_id").alias("id"))
    return jobs.url_candidates(found).drop("title")


_RESOLVED = """SELECT page_id, CASE page_id % 4 WHEN 0 THEN o || '/moved/x?b=1' WHEN 1 THEN o || regexp_replace(p, '[^/]*$', '') || '/next' WHEN 2 THEN o || '/' || 'top' ELSE 'https://moved.example.org/z' END AS url
  FROM (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS o, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS p FROM pages)"""


@query("url_resolve", f"SELECT page_id, canonical FROM ({_canonical_sql(_RESOLVED)})")
def url_resolve(b: Bridge) -> DataFrame:
    i = F.col("page_id") % 4
    location = F.when(i == 0, "/moved/x?b=1#part").when(i == 1, "./next").when(i == 2, "../../../../../top").otherwise("HTTPS://Moved.Example.org:443/z")
    return b("pages").select("page_id", urls.resolved(F.col("url"), location).alias("canonical"))


_PARTS = "page_id, CASE page_id % 6 WHEN 0 THEN 'HTTP://Bücher.Example:80/a b/' || page_id || '/ü\"x\"?z=%7e&ü=é&a=1+2' WHEN 1 THEN 'https://user:pw@EXAMPLE.org:8443/x/../' || page_id || '/%2e/ok?b=%zz&B=2&a=x%26y#f' WHEN 2 THEN ' http:{b}{b}example.org{b}dir{b}' || page_id || '  '  WHEN 3 THEN 'https://example.org:99999/' || page_id WHEN 4 THEN 'https://日本語.example/' || page_id || '?utm_source=x&q=%E6%97%A5%20本' ELSE url END AS url"


@query("url_international", """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'http://xn--bcher-kva.example/a%20b/' || page_id || '/%C3%BC%22x%22?a=1+2&%C3%BC=%C3%A9&z=%7E' WHEN 1 THEN 'https://user:pw@example.org:8443/' || page_id || '/ok?a=x%26y&b=%25zz&B=2' WHEN 2 THEN 'http://example.org/dir/' || page_id WHEN 4 THEN 'https://xn--wgv71a119e.example/' || page_id || '?q=%E6%97%A5+%E6%9C%AC' WHEN 5 THEN canonical END AS canonical FROM (""" + _canonical_sql("SELECT page_id, url FROM pages") + ")")
def url_international(b: Bridge) -> DataFrame:
    given = b.spark.sql(f"SELECT {_PARTS.replace('{b}', chr(92) * 2)} FROM {{pages}}", pages=b("pages"))
    return given.select("page_id", urls.canonical(F.col("url"), international=True).alias("canonical"))


@query("pending_candidates", "SELECT page_id, url FROM pages WHERE page_id % 3 <> 0 AND page_id % 4 = 1")
def pending_candidates(b: Bridge) -> DataFrame:
    found = b("pages").select("page_id", "url", F.when(F.col("page_id") % 3 == 0, "FETCHED").otherwise("PENDING").alias("status"), (F.col("page_id") % 4).alias("crawl_run_id"))
    return discovery.pending(found, 1).select("page_id", "url")


_ROBOTS = "User-agent: *\nDisallow: /en/\nAllow: /en/a\n\nUser-agent: other\nDisallow: /\n"


@query("robots_allowed", "SELECT page_id, starts_with(p, '/en/a') OR NOT starts_with(p, '/en/') AS allowed FROM (SELECT page_id, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS p FROM pages)")
def robots_allowed(b: Bridge) -> DataFrame:
    rules = urls.robots_rules(_ROBOTS, "Reader/1.0 (no other)")
    return b("pages").select("page_id", urls.robots_verdict(F.regexp_extract("url", "^https?://[^/?#]*([^?#]*)", 1), rules).alias("allowed"))


@query("content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(b: Bridge) -> DataFrame:
    return b("documents").select("doc_id", urls.content_hash(F.col("text")).alias("hash"))


@query("evidence_hash", "SELECT item_id, sha256(trim(text)) AS hash FROM benchmark")
def evidence_hash(b: Bridge) -> DataFrame:
    return b("benchmark").select("item_id", F.sha2(F.trim("text"), 256).alias("hash"))


@query("evidence_admission", """SELECT e.id, CASE WHEN trim(evidence_text) = '' THEN 'evidenceText must not be empty.' WHEN e.claim_id NOT IN (SELECT id FROM g_claims WHERE status <> 'DISPUTED') THEN 'Cannot add evidence to an unknown claim.' WHEN e.document_id NOT IN (SELECT id FROM g_documents) THEN 'Cannot add evidence from an unknown document.' WHEN length(e.id) % 5 = 0 THEN 'startChar must be before or equal to endChar.' END AS reason, sha256(trim(evidence_text)) AS evidence_hash FROM g_evidence e""")
def evidence_admission(b: Bridge) -> DataFrame:
    drafts = b("g_evidence").select("*", F.lit(5).alias("start_char"), F.when(F.length("id") % 5 == 0, 4).alias("end_char"))
    return validation.add_evidence(drafts, b("g_claims").where("status <> 'DISPUTED'"), b("g_documents")).select("id", "reason", "evidence_hash")


@query("storage_path", """SELECT page_id, 'raw-documents/news_article/src-' || CAST(page_id % 5 AS VARCHAR) || '/' || lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) || '/' || sha256(url) || '.' || CASE page_id % 5 WHEN 0 THEN 'html' WHEN 1 THEN 'pdf' WHEN 2 THEN 'json' WHEN 3 THEN 'txt' ELSE 'html' END AS path FROM pages""")
def storage_path(b: Bridge) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("text/HTML; charset=utf-8", " Application/PDF", "application/ld+json;x", "text/plain", "application/rss+xml")])
    kind = F.element_at(kinds, (F.col("page_id") % 5 + 1).cast("int"))
    return b("pages").select("page_id", urls.storage_path(F.lit("NEWS_ARTICLE"), F.concat(F.lit("!SRC "), (F.col("page_id") % 5).cast("string"), F.lit("?")), F.col("url"), F.sha2("url", 256), kind).alias("path"))


@query("fetch_classify", """WITH r AS (SELECT event_id, CASE event_id % 11 WHEN 0 THEN 401 WHEN 1 THEN 402 WHEN 2 THEN 451 WHEN 3 THEN 410 WHEN 4 THEN 503 WHEN 5 THEN 301 WHEN 6 THEN 429 ELSE 200 END AS status, CASE WHEN event_id % 13 = 0 THEN 'Subscribe to continue' WHEN event_id % 13 < 4 THEN 'text' ELSE '' END AS body, event_id % 17 = 0 AS wall FROM events),
a AS (SELECT *, CASE WHEN status = 401 THEN 'LOGIN_REQUIRED' WHEN status = 402 OR wall THEN 'PAYWALLED' WHEN status IN (403, 451) THEN 'BLOCKED' WHEN status IN (404, 410) THEN 'REMOVED' WHEN contains(lower(body), 'subscribe to continue') THEN 'PAYWALLED' WHEN status BETWEEN 200 AND 299 THEN 'PUBLIC' ELSE 'UNKNOWN' END AS access FROM r)
SELECT event_id, access, CASE WHEN access = 'PAYWALLED' THEN CASE WHEN body <> '' THEN 'PARTIAL' ELSE 'METADATA_ONLY' END WHEN status BETWEEN 200 AND 299 THEN 'PENDING' ELSE 'FAILED' END AS extraction, status = 301 AS redirect, status IN (408, 429) OR status >= 500 AS retry FROM a""")
def fetch_classify(b: Bridge) -> DataFrame:
    i, j = F.col("event_id") % 11, F.col("event_id") % 13
    status = F.when(i == 0, 401).when(i == 1, 402).when(i == 2, 451).when(i == 3, 410).when(i == 4, 503).when(i == 5, 301).when(i == 6, 429).otherwise(200)
    r = b("events").select("event_id", status.alias("status"), F.when(j == 0, "Subscribe to continue").when(j < 4, "text").otherwise("").alias("body"), F.create_map(F.lit("X-Paywall"), F.when(F.col("event_id") % 17 == 0, "True").otherwise("no")).alias("headers"))
    a = r.withColumn("access", urls.access_status(F.col("status"), F.col("body"), urls.header_map(F.col("headers"))["x-paywall"]))
    return a.select("event_id", "access", urls.extraction_status(F.col("access"), F.col("status"), F.length("body")).alias("extraction"), urls.is_redirect(F.col("status")).alias("redirect"), urls.is_retryable(F.col("status")).alias("retry"))


@query("source_normalize", "SELECT source AS id, source || '.example.org' AS domain, least(10, greatest(1, k)) AS concurrency FROM (SELECT DISTINCT source, CAST(substr(source, 4) AS INT) AS k FROM documents)")
def source_normalize(b: Bridge) -> DataFrame:
    s = b("g_sources")
    return s.select("id", urls.domain(F.concat(F.lit(" HTTPS://"), F.upper("domain"), F.lit(":443/path "))).alias("domain"), F.least(F.lit(10), F.greatest(F.lit(1), F.col("k"))).alias("concurrency"))


@query("manual_candidates", f"""WITH v AS ({_canonical_sql("SELECT page_id, url FROM pages")}), c AS (SELECT canonical, min(page_id) AS cand FROM v WHERE page_id % 2 = 0 GROUP BY canonical), j AS (SELECT min(id) AS job, user_id FROM g_jobs WHERE job_kind = 'FETCH_URL' AND status IN ('PENDING', 'RUNNING') GROUP BY user_id)
SELECT DISTINCT v.canonical AS canonical_url, c.cand IS NOT NULL AS reused_candidate, j.job IS NOT NULL AS reused_job FROM v LEFT JOIN c USING (canonical) LEFT JOIN j ON j.user_id = c.cand""")
def manual_candidates(b: Bridge) -> DataFrame:
    given = b("pages").select("page_id", urls.canonical(F.col("url")).alias("canonical_url"))
    there = given.where("page_id % 2 = 0").groupBy("canonical_url").agg(F.min("page_id").alias("candidate_id"))
    return discovery.submit(given, there, b("g_jobs").withColumnRenamed("user_id", "url_candidate_id")).select("canonical_url", "reused_candidate", "reused_job")


@query("manual_submissions", f"""WITH v AS ({_canonical_sql("SELECT page_id, url FROM pages")}), a AS (SELECT page_id % 3 AS source_id, canonical, min(url) AS original FROM v GROUP BY ALL),
c AS (SELECT page_id % 3 AS source_id, canonical, min(page_id) AS cand FROM v WHERE page_id % 2 = 0 GROUP BY ALL), j AS (SELECT min(id) AS job, user_id FROM g_jobs WHERE job_kind = 'FETCH_URL' AND status IN ('PENDING', 'RUNNING') GROUP BY user_id)
SELECT coalesce(CAST(cand AS VARCHAR), sha256(a.source_id || '|' || a.canonical)) AS candidate_id, a.source_id, original AS original_url, a.canonical AS canonical_url, 'PENDING' AS status, CASE WHEN cand IS NULL THEN '' ELSE 'found=feed,' END || 'lastManualSubmissionAt=2024-01-15T00:00:00.000Z,manualSubmission=true' AS metadata,
  cand IS NOT NULL AS reused_candidate, job IS NOT NULL AS reused_job, CASE WHEN job IS NULL THEN 'r' || cand % 4 || '/3/2024-01-15T00:00:00.000Z/' || a.canonical END AS job FROM a LEFT JOIN c ON c.source_id = a.source_id AND c.canonical = a.canonical LEFT JOIN j ON j.user_id = c.cand""")
def manual_submissions(b: Bridge) -> DataFrame:
    i = F.col("page_id")
    given = b("pages").select((i % 3).alias("source_id"), "url", urls.canonical(F.col("url")).alias("canonical_url"), "page_id")
    there = given.where("page_id % 2 = 0").select(i.alias("id"), "source_id", "canonical_url", F.concat(F.lit("r"), (i % 4).cast("string")).alias("crawl_run_id"), F.create_map(F.lit("found"), F.lit("feed"), F.lit("manualSubmission"), F.lit("false")).alias("metadata"))
    made = discovery.submissions(given, there, b("g_jobs").withColumnRenamed("user_id", "url_candidate_id"), "2024-01-15 00:00:00")
    told = F.array_join(F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    job = F.concat(F.col("job.crawl_run_id"), F.lit("/"), F.col("job.max_attempts").cast("string"), F.lit("/"), F.col("job.scheduled_at"), F.lit("/"), F.col("job.metadata")["canonicalUrl"])
    return made.select("candidate_id", "source_id", "original_url", "canonical_url", "status", told.alias("metadata"), "reused_candidate", "reused_job", job.alias("job"))


@query("html_text", """WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(html, '(?is)<article\\b[^>]*>(.*?)</article\\s*>', 1), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM pages)
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&quot;', '"'), '&apos;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[\\s\u00a0]+', ' ', 'g')) AS text FROM a""")
def html_text(b: Bridge) -> DataFrame:
    return b("pages").select("page_id", html.visible_text(F.col("html")).alias("text"))


_TEXT = """trim(regexp_replace(replace(replace(replace(replace(replace(replace({}, '&nbsp;', ' '), '&quot;', '"'), '&apos;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[\\s\u00a0]+', ' ', 'g'))"""


@query("html_meta", "SELECT page_id, nullif(regexp_extract(html, '<html lang=\"([a-z]+)\"', 1), '') AS lang, regexp_extract(html, '<meta charset=\"([^\"]*)\"', 1) AS charset FROM pages")
def html_meta(b: Bridge) -> DataFrame:
    tag = F.regexp_extract("html", r"(?is)(<meta\b[^>]*>)", 1)
    return b("pages").select("page_id", html.lang(F.col("html")).alias("lang"), html.attribute(tag, "charset").alias("charset"))


@query("html_extract", f"""WITH p AS (SELECT page_id, {_TEXT.format("regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '(?s)<[^>]*>', ' ', 'g')")} AS title, nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), '') AS language,
 {_TEXT.format("regexp_replace(regexp_replace(regexp_extract(html, '(?is)<article>(.*?)</article>', 1), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')")} AS text FROM pages WHERE html IS NOT NULL)
SELECT page_id, nullif(title, '') AS title, NULL::VARCHAR AS author, NULL::VARCHAR AS publisher, NULL::VARCHAR AS published_at, NULL::VARCHAR AS description, language, nullif(text, '') AS text, CASE WHEN text = '' THEN 'METADATA_ONLY' ELSE 'SUCCESS' END AS extraction_status, 'html' AS title_from FROM p""")
def html_extract(b: Bridge) -> DataFrame:
    told = html.metadata(b("pages").select("page_id", "html"))
    return told.select("page_id", *html.FIELDS[:3], F.col("published_at").cast("string").alias("published_at"), "description", "language", "text", "extraction_status", F.col("field_sources")["title"].alias("title_from"))


@query("lang_normalize", "SELECT doc_id, lang || '-' || upper(lang) AS tag FROM documents")
def lang_normalize(b: Bridge) -> DataFrame:
    return b("documents").select("doc_id", text.language(F.concat(F.lit(" "), F.upper("lang"), F.lit("_"), F.lower("lang"), F.lit(" "))).alias("tag"))


def _feeds(b: Bridge) -> DataFrame:
    loc = F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc><lastmod>2024-01-0"), (F.col("page_id") % 9 + 1).cast("string"), F.lit("</lastmod></url>"))
    item = F.concat(F.lit("<item><title>T"), F.col("page_id").cast("string"), F.lit("</title><link>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</link><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item>"))
    # Feeds of fifty pages at most: a source has as many as it needs.
    number = F.floor(F.col("page_id") / 250)
    sitemap = b("pages").groupBy((F.col("page_id") % 5).alias("source_id"), number.alias("number")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(loc), ""), F.lit("</urlset>")).alias("xml"))
    rss = b("pages").groupBy((F.col("page_id") % 5 + 5).alias("source_id"), number.alias("number")).agg(F.concat(F.lit('<rss version="2.0">'), F.array_join(F.collect_list(item), ""), F.lit("</rss>")).alias("xml"))
    return sitemap.union(rss).drop("number")


@query("discover_parse", """SELECT page_id % 5 AS source_id, 'SITEMAP' AS kind, url, NULL AS title, '2024-01-0' || CAST(page_id % 9 + 1 AS VARCHAR) || ' 00:00:00' AS published FROM pages
UNION ALL SELECT page_id % 5 + 5, 'RSS', url, 'T' || CAST(page_id AS VARCHAR), '2024-01-01 10:00:00' FROM pages""")
def discover_parse(b: Bridge) -> DataFrame:
    return discovery.items(_feeds(b)).withColumn("published", F.date_format("published", "yyyy-MM-dd HH:mm:ss"))


@query("discovery_status", "SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'error') = 0 THEN 'SUCCEEDED' WHEN count(*) FILTER (event_type <> 'error') > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM events GROUP BY user_id")
def discovery_status(b: Bridge) -> DataFrame:
    error = F.col("event_type") == "error"
    return b("events").groupBy("user_id").agg(discovery.run_status(F.count_if(~error), F.count_if(error)).alias("status"))


@query("sitemap_walk", """WITH RECURSIVE w(root, url, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION ALL SELECT root, c.p_partkey, depth + 1 FROM w JOIN part c ON c.p_partkey // 7 = w.url AND c.p_partkey <> w.url WHERE depth < 3)
SELECT root, url, depth, CASE WHEN depth = 3 AND url IN (SELECT p_partkey // 7 FROM part WHERE p_partkey // 7 <> p_partkey) THEN 'Sitemap recursion depth exceeded.' END AS error FROM w""")
def sitemap_walk(b: Bridge) -> DataFrame:
    p = F.col("p_partkey")
    children = b("part").select(F.floor(p / 7).alias("parent"), p.alias("child")).where("parent <> child")
    return discovery.walk(children, b("part").select(p.alias("url")))


@query("text_normalize", "SELECT item_id, trim(regexp_replace(replace(strip_accents(lower(text)), '''', ''), '[^a-z0-9]+', ' ', 'g')) AS text FROM benchmark")
def text_normalize(b: Bridge) -> DataFrame:
    return b("benchmark").select("item_id", text.normalized(F.col("text")).alias("text"))


@query("text_tokens", "SELECT item_id, len(string_split(trim(regexp_replace(replace(strip_accents(lower(text)), '''', ''), '[^a-z0-9]+', ' ', 'g')), ' '))::INT AS n FROM benchmark")
def text_tokens(b: Bridge) -> DataFrame:
    return b("benchmark").select("item_id", F.size(text.tokens(F.col("text"))).alias("n"))


@query("lexicon_hits", "SELECT doc_id FROM (SELECT doc_id, ' ' || trim(regexp_replace(replace(strip_accents(lower(text)), '''', ''), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM documents) WHERE " + " OR ".join(f"contains(t, ' {n} ')" for n in NEGATIONS))
def lexicon_hits(b: Bridge) -> DataFrame:
    return b("documents").where(text.contains_any(text.normalized(F.col("text")), NEGATIONS)).select("doc_id")


def _spans(b: Bridge) -> DataFrame:
    """Benchmark passages in documents, met through the longest word that has spaces on both sides in the passage,
    and so in the document, and verified; passages of under three words through their rarest trigram."""
    items = b("benchmark").select("item_id", F.col("text").alias("evidence"), F.split("text", " ").alias("w"))
    docs = b("documents").select("doc_id", "text")
    keyed = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    inner = F.transform(F.slice("w", 2, F.greatest(F.lit(1), F.size("w") - 2)), lambda x: F.struct(F.length(x).alias("n"), x.alias("word")))
    long = items.where(F.size("w") >= 3).select("item_id", "evidence", F.array_max(inner)["word"].alias("word"))
    short = items.where(F.size("w") < 3).select("item_id", "evidence")
    met = keyed.join(long, "word").select("doc_id", "item_id", "evidence")
    if not short.isEmpty():
        one = F.lit("")
        found = resolution.contained(short.select(one.alias("block"), F.struct("item_id", "evidence").alias("asked_id"), F.col("evidence").alias("inner")), docs.select(one.alias("block"), F.col("doc_id").alias("held_id"), F.col("text").alias("outer")))
        met = met.unionByName(found.select(F.col("held_id").alias("doc_id"), "asked_id.item_id", "asked_id.evidence"))
    met = met.join(docs, "doc_id")
    return met.select("doc_id", "item_id", "text", "evidence", text.span(F.col("text"), F.col("evidence")).alias("s")).where("s is not null")


_SPANS = "SELECT doc_id, item_id, d.text, b.text AS evidence, (strpos(d.text, b.text) - 1)::INT AS start FROM documents d JOIN benchmark b ON contains(d.text, b.text)"


@query("evidence_span", f"SELECT doc_id, item_id, start, (start + length(evidence))::INT AS \"end\" FROM ({_SPANS})")
def evidence_span(b: Bridge) -> DataFrame:
    return _spans(b).select("doc_id", "item_id", "s.start", "s.end")


@query("evidence_context", f"""WITH s AS ({_SPANS}), p AS (SELECT *, start + length(evidence) - 1 AS stop FROM s)
SELECT doc_id, item_id, trim(regexp_extract(substr(text, 1, start), '[^.!?]*$', 0) || substr(text, start + 1, (stop - start)::INT) || regexp_extract(substr(text, (stop + 1)::INT), '^[^.!?]*[.!?]?', 0)) AS sentence, trim(substr(text, greatest(0, start - 180) + 1, (start - greatest(0, start - 180))::INT)) AS before, trim(substr(text, (stop + 2)::INT, 180)) AS after FROM p""")
def evidence_context(b: Bridge) -> DataFrame:
    s = _spans(b).withColumn("near", text.nearby(F.col("text"), F.col("s.start"), F.col("s.end")))
    return s.select("doc_id", "item_id", text.sentence(F.col("text"), F.col("s.start"), F.col("s.end")).alias("sentence"), "near.before", "near.after")


def _mentions(b: Bridge) -> DataFrame:
    people = b("customer").select(F.concat(F.lit("m:"), F.col("c_custkey").cast("string")).alias("mention_id"), F.lit("PERSON").alias("entity_type"), F.upper("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("canton"), F.col("c_nationkey").cast("string").alias("country"))
    firms = b("supplier").select(F.concat(F.lit("f:"), F.col("s_suppkey").cast("string")), F.lit("COMPANY"), F.concat(F.lit("the "), F.col("s_name")), F.lit(None).cast("string"), F.col("s_nationkey").cast("string"))
    # Mentions that do not resolve: a surname alone, two surnames, and a name that no one has.
    i, number = F.col("c_custkey"), F.substring_index("c_name", "#", -1)
    name = F.when(i % 3 == 0, F.concat(F.lit("Mx "), number)).when(i % 3 == 1, F.concat(number, F.lit(" "), F.lpad((i + 1).cast("string"), 9, "0"))).otherwise("Nobody Else")
    vague = b("customer").select(F.concat(F.lit("x:"), i.cast("string")), F.lit("PERSON"), name, F.lit(None).cast("string"), F.when(i % 3 == 0, F.col("c_nationkey").cast("string")))
    return people.union(firms).union(vague)


_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_CANDIDATES = f"""m AS (SELECT 'm:' || CAST(c_custkey AS VARCHAR) AS mention_id, 'PERSON' AS entity_type, {_NORM.format('c_name')} AS n, CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) END AS canton, CAST(c_nationkey AS VARCHAR) AS country FROM customer
  UNION ALL SELECT 'f:' || CAST(s_suppkey AS VARCHAR), 'COMPANY', {_NORM.format("'the ' || s_name")}, NULL, CAST(s_nationkey AS VARCHAR) FROM supplier
  UNION ALL SELECT 'x:' || CAST(c_custkey AS VARCHAR), 'PERSON', CASE c_custkey % 3 WHEN 0 THEN 'mx ' || split_part(c_name, '#', 2) WHEN 1 THEN split_part(c_name, '#', 2) || ' ' || lpad(CAST(c_custkey + 1 AS VARCHAR), 9, '0') ELSE 'nobody else' END, NULL, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_nationkey AS VARCHAR) END FROM customer),
e AS (SELECT id AS entity_id, entity_type, canonical_name, {_NORM.format('canonical_name')} AS n, lower(canton) AS canton, country, string_split({_NORM.format('canonical_name')}, ' ')[-1] AS last FROM g_entities WHERE entity_type IN ('PERSON', 'COMPANY')),
al AS (SELECT entity_id, list(DISTINCT {_NORM.format('alias')}) AS names FROM g_aliases GROUP BY entity_id),
p AS (SELECT m.mention_id, e.entity_id, e.canonical_name, e.last, m.canton IS NOT DISTINCT FROM e.canton AND m.canton IS NOT NULL AS canton, m.country = e.country AS country,
   CASE WHEN m.n = e.n THEN 'exact canonical name' WHEN list_contains(al.names, m.n) THEN 'exact alias' WHEN m.entity_type = 'PERSON' AND list_contains(string_split(m.n, ' '), e.last) THEN 'same surname' WHEN m.entity_type <> 'PERSON' AND (contains(e.n, m.n) OR contains(m.n, e.n)) THEN 'partial name' END AS sig
   FROM m JOIN e ON e.entity_type = m.entity_type LEFT JOIN al USING (entity_id)),
c AS (SELECT mention_id, entity_id, canonical_name, sig, last, least(1.0::DOUBLE, round(CASE sig WHEN 'exact canonical name' THEN 0.86 WHEN 'exact alias' THEN 0.90 WHEN 'same surname' THEN 0.34 WHEN 'partial name' THEN 0.42 ELSE 0.0 END::DOUBLE + CASE WHEN canton THEN 0.12 ELSE 0.0 END::DOUBLE + CASE WHEN country THEN 0.08 ELSE 0.0 END::DOUBLE, 4)) AS score,
   array_to_string(list_filter([sig, CASE WHEN canton THEN 'same canton' END, CASE WHEN country THEN 'same country' END], lambda x: x IS NOT NULL), '+') AS signals FROM p),
r AS (SELECT mention_id, entity_id, score, CASE WHEN sig = 'same surname' THEN last END AS surname, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, canonical_name, entity_id)::INT AS rank, signals FROM c WHERE score >= 0.20)"""


def _resolved(b: Bridge) -> tuple[DataFrame, DataFrame, DataFrame]:
    return _mentions(b), b("g_entities").where("entity_type in ('PERSON', 'COMPANY')").drop("metadata"), b("g_aliases")


def _scored(b: Bridge, best: int | None = None) -> DataFrame:
    return resolution.candidates(*_resolved(b), best=best)


@query("resolve_by_metadata", """WITH m AS (SELECT 'z:' || CAST(c_custkey AS VARCHAR) AS mention_id, 'p' || (c_custkey % 10) AS party, CASE WHEN c_custkey % 2 = 0 THEN 'o' || right('0' || c_custkey, 2) END AS position, CASE WHEN c_custkey % 3 = 0 THEN '2015' END AS f, CASE WHEN c_custkey % 3 <> 1 THEN '2018' END AS t, 's:' || (c_custkey % 9) AS met FROM customer),
p AS (SELECT mention_id, e.id AS entity_id, canonical_name, m.party = 'p' || right(slug, 1) AS party, coalesce(position = 'o' || right(slug, 2), false) AS position, (f IS NOT NULL OR t IS NOT NULL) AND '201' || right(slug, 1) <= coalesce(t, '9999-12-31') AS period, met = 's:' || right(slug, 1) AS met FROM m, g_entities e WHERE entity_type = 'PERSON'),
c AS (SELECT *, round(CASE WHEN party THEN 0.08 ELSE 0 END::DOUBLE + CASE WHEN position THEN 0.07 ELSE 0 END::DOUBLE + CASE WHEN period THEN 0.05 ELSE 0 END::DOUBLE + CASE WHEN met THEN 0.05 ELSE 0 END::DOUBLE, 4) AS score FROM p)
SELECT mention_id, entity_id, score, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, canonical_name, entity_id)::INT AS rank,
  array_to_string(list_filter([CASE WHEN party THEN 'same party' END, CASE WHEN position THEN 'same position' END, CASE WHEN period THEN 'overlapping time period' END, CASE WHEN met THEN 'co-mentioned entity' END], lambda x: x IS NOT NULL), '+') AS signals FROM c WHERE score >= 0.2::DOUBLE""")
def resolve_by_metadata(b: Bridge) -> DataFrame:
    i, text_of = F.col("c_custkey"), lambda c: c.cast("string")
    told = F.map_filter(F.create_map(F.lit("party"), F.concat(F.lit("p"), text_of(i % 10)), F.lit("role"), F.when(i % 2 == 0, F.concat(F.lit("o"), F.right(F.concat(F.lit("0"), text_of(i)), F.lit(2)))), F.lit("from"), F.when(i % 3 == 0, "2015"), F.lit("to"), F.when(i % 3 != 1, "2018")), lambda _, v: v.isNotNull())
    mentions = b("customer").select(F.concat(F.lit("z:"), text_of(i)).alias("mention_id"), F.lit("PERSON").alias("entity_type"), F.lit("No one of that name").alias("name"), told.alias("metadata"), F.array(F.concat(F.lit("s:"), text_of(i % 9))).alias("co_mentioned"))
    people = b("g_entities").where("entity_type = 'PERSON'").select("id", "entity_type", "canonical_name", "metadata")
    return resolution.candidates(mentions, people, b("g_aliases")).drop("surname")


@query("resolve_candidates", f"WITH {_CANDIDATES} SELECT * EXCLUDE (surname) FROM r")
def resolve_candidates(b: Bridge) -> DataFrame:
    return _scored(b).drop("surname")


_RESOLVED_MENTIONS = f"""{_CANDIDATES}, t AS (SELECT mention_id, max(entity_id) FILTER (rank = 1) AS entity_id, max(score) FILTER (rank = 1) AS top, max(score) FILTER (rank = 2) AS second, max(surname) FILTER (rank = 1) AS s1, max(surname) FILTER (rank = 2) AS s2 FROM r GROUP BY mention_id),
d AS (SELECT m.mention_id, CASE WHEN top IS NULL THEN 0 WHEN second IS NOT NULL AND (top - second <= 0.08::DOUBLE OR s1 = s2) THEN 1 WHEN top < 0.82::DOUBLE THEN 2 ELSE 3 END AS k, t.entity_id, top FROM m LEFT JOIN t USING (mention_id))"""


@query("resolve_mentions", f"""WITH {_RESOLVED_MENTIONS} SELECT mention_id, CASE k WHEN 0 THEN 'NO_MATCH' WHEN 3 THEN 'AUTO_RESOLVED' ELSE 'MANUAL_REVIEW' END AS status,
CASE k WHEN 0 THEN 'No candidate met the minimum score.' WHEN 1 THEN 'Ambiguous entity candidates require manual review.' WHEN 2 THEN 'Top candidate is below the automatic resolution threshold.' END AS reason, CASE WHEN k = 3 THEN entity_id END AS entity_id, top FROM d""")
def resolve_mentions(b: Bridge) -> DataFrame:
    return resolution.resolve(_mentions(b), _scored(b, best=2))


@query("review_tasks", f"WITH {_RESOLVED_MENTIONS} SELECT 't:' || mention_id AS id, mention_id AS local_id, 'OPEN' AS status FROM d WHERE k <> 3")
def review_tasks(b: Bridge) -> DataFrame:
    return resolution.review_tasks(resolution.resolve(_mentions(b), _scored(b, best=2))).drop("reason")


def _relations(b: Bridge) -> DataFrame:
    """Every claim with each of its evidence rows, or with none; evidence quotes the document for even parts, and is a benchmark passage for odd ones.

    A passage is located in its document once, however many claims it is evidence of; entities have their names normalised once.
    """
    odd = F.col("partkey") % 2 != 0
    unclear = written(resolution.unclear_entities(*_resolved(b))).withColumn("unclear", F.lit(True))  # named twice each
    names = b("g_aliases").groupBy(F.col("entity_id").alias("id")).agg(F.collect_list("alias").alias("aliases"))
    e = written(b("g_entities").select("id", "canonical_name", "entity_type").join(sorted_in(names), "id", "left").join(sorted_in(unclear), "id", "left").select("id", F.col("canonical_name").isNotNull().alias("named"), F.col("entity_type").alias("type"), F.array_distinct(validation.explicit_names(F.col("canonical_name"), F.col("aliases"))).alias("names"), "unclear"))
    r = b("g_claims").select("id", "predicate", "subject_id", "object_id", "partkey", (F.col("valid_from").isNotNull() | F.col("valid_to").isNotNull()).alias("ranged"))
    r = r.join(b("g_evidence").select(F.col("claim_id").alias("id"), "document_id"), "id", "left")
    # Entities come before the passages, which are long.
    for s in ("subject", "object"):
        r = r.join(sorted_in(e.select(*[F.col(c).alias(f"{s}_{c}") for c in e.columns])), f"{s}_id", "left")
    items = b("benchmark").agg(F.count("*").alias("n_items"))  # one row
    r = r.join(F.broadcast(items)).withColumn("item_id", F.when(odd & F.col("document_id").isNotNull(), F.col("partkey") % F.col("n_items")))
    pair = F.struct("document_id", "item_id")
    sources = b("g_sources").select(F.col("id").alias("source_id"), "source_quality")
    docs = b("g_documents").select(F.col("id").alias("document_id"), "source_id", "is_published", F.col("extracted_text").alias("text"), F.lit(True).alias("there")).join(sources, "source_id", "left")
    asked = r.select(pair.alias("pair")).distinct().select("pair", "pair.*")
    placed = asked.join(docs, "document_id", "left").join(b("benchmark").select("item_id", F.col("text").alias("passage")), "item_id", "left")
    told = validation.located(placed.withColumn("evidence_text", F.when(F.col("item_id").isNotNull(), F.col("passage")).otherwise(F.substring("text", 10, 80))))
    r = r.withColumn("pair", pair).join(told.select("pair", "evidence_text", *validation.LOCATED, "source_quality", "is_published", "there"), "pair")
    r = r.join(F.broadcast(b("g_compatible").withColumn("compatible", F.lit(True))), ["predicate", "subject_type", "object_type"], "left")
    false = F.lit(False)
    return r.select(
        "id", "predicate", "evidence_text", *validation.LOCATED, *[F.when(F.col(f"{s}_named"), "").alias(f"{s}_name") for s in ("subject", "object")], "subject_names", "object_names", F.coalesce("compatible", false).alias("compatible"), "source_quality",
        (F.col("ranged") | F.coalesce("is_published", false)).alias("dated"), (F.col("partkey") % 29 == 0).alias("requires_review"), F.coalesce("subject_unclear", "object_unclear", false).alias("ambiguous"),
        F.coalesce("there", false).alias("known_document"), F.col("object_id").isNotNull().alias("given_object"),
    )


@query("claim_validate")
def claim_validate(b: Bridge) -> DataFrame:
    return validation.validate(_relations(b)).select("id", "status", "evidence_score", F.array_join("reasons", "; ").alias("reasons"), F.array_join("warnings", "; ").alias("warnings"))


_SHAPE = """CASE WHEN valid_from > valid_to THEN 'Date range must start before it ends.' WHEN s.id IS NULL THEN 'Claim subject entity does not exist.' WHEN c.object_id IS NULL AND literal IS NULL THEN 'A claim needs either an object entity or a literal value.'
  WHEN c.object_id IS NOT NULL AND o.id IS NULL THEN 'Claim object entity does not exist.' WHEN c.object_id = c.subject_id THEN 'A claim cannot relate an entity to itself.' WHEN c.object_id IS NOT NULL AND k.predicate IS NULL THEN 'Claim predicate is incompatible with the subject or object entity type.'"""
_SHAPED = "(SELECT *, CASE WHEN partkey % 2 = 0 THEN '{{}}' END AS literal FROM g_claims) c LEFT JOIN g_entities s ON s.id = c.subject_id LEFT JOIN g_entities o ON o.id = c.object_id LEFT JOIN g_compatible k ON k.predicate = c.predicate AND k.subject_type = s.entity_type AND k.object_type = o.entity_type".replace("{{}}", "{}")


def _drafts(b: Bridge, once: bool = False) -> DataFrame:
    return (b.once if once else b)("g_claims").withColumn("literal_value", F.when(F.col("partkey") % 2 == 0, "{}"))


@query("claim_admission", f"SELECT id, r IS NULL AS accepted, r AS reason FROM (SELECT c.id, {_SHAPE} WHEN c.status = 'VERIFIED' THEN 'Claims must be verified through the reviewer transition service.' END AS r FROM {_SHAPED}) x")
def claim_admission(b: Bridge) -> DataFrame:
    return validation.admit(_drafts(b, once=True), b("g_entities"), b("g_compatible"))


@query("claim_verifiable", f"SELECT id, r IS NULL AS verifiable, r AS reason FROM (SELECT c.id, {_SHAPE} WHEN c.id NOT IN (SELECT claim_id FROM g_evidence) THEN 'A claim cannot be verified without evidence.' WHEN c.object_id IS NULL THEN 'Literal claims are not publishable graph relationships yet.' END AS r FROM {_SHAPED}) x")
def claim_verifiable(b: Bridge) -> DataFrame:
    return validation.verifiable(_drafts(b), b("g_entities"), b("g_compatible"), b("g_evidence"))


@query("publish_rule", "WITH e AS (SELECT claim_id, count(*) FILTER (trim(evidence_text) <> '') AS n FROM g_evidence GROUP BY claim_id) SELECT c.id FROM g_claims c JOIN e ON e.claim_id = c.id WHERE c.status = 'VERIFIED' AND e.n > 0 AND c.predicate <> 'SPOKE_AT'")
def publish_rule(b: Bridge) -> DataFrame:
    texts = b("g_evidence").groupBy(F.col("claim_id").alias("id")).agg(F.collect_list("evidence_text").alias("texts"))
    claim = F.struct("status", (F.col("predicate") != "SPOKE_AT").alias("compatible"))
    return b("g_claims").join(texts, "id").where(validation.publishable(claim, F.col("texts"))).select("id")
