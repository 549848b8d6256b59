"""Queries of drafts that refer to drafts, and of edits that change several tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..bridge import Bridge
from ..operators import admission, review
from ..written import written
from .registry import query

#: Drafts of eight tables: many name records that are neither stored nor drafted, or drafts that are refused themselves.
_DRAFTS = {
    "sources": "SELECT source AS id, CASE WHEN k % 5 = 0 THEN ' ' ELSE source END AS name FROM {g_sources}",
    "entities": "SELECT id, CASE WHEN slug LIKE '%7' THEN '' ELSE canonical_name END AS canonical_name, CASE WHEN slug LIKE '%8' THEN ' ' ELSE slug END AS slug FROM {g_entities}",
    "entity_aliases": "SELECT id, alias, entity_id, CASE WHEN language = 'de' THEN 'src3' END AS source_id, CASE WHEN alias LIKE '%3' THEN '2024-02-01' END AS valid_from, '2024-01-01' AS valid_to FROM {g_aliases}",
    "documents": "SELECT id, source_id, CASE WHEN number % 9 = 0 THEN '' ELSE original_url END AS original_url FROM {g_documents}",
    "crawl_runs": "SELECT CAST(user_id AS STRING) AS id, CASE WHEN user_id % 6 = 0 THEN 'src99999' ELSE 'src' || CAST(user_id % 20 AS STRING) END AS source_id, min(ts) AS started_at, CASE WHEN user_id % 4 = 0 THEN min(ts) - INTERVAL 1 HOUR ELSE max(ts) END AS finished_at FROM {events} GROUP BY user_id",
    "url_candidates": "SELECT CAST(page_id AS STRING) AS id, url AS original_url, CASE WHEN page_id % 10 = 0 THEN ' ' ELSE url END AS canonical_url, 'src' || CAST(page_id % 20 AS STRING) AS source_id, CASE WHEN page_id % 3 <> 0 THEN CAST(page_id % 200 AS STRING) END AS crawl_run_id FROM {pages}",
    "ingestion_jobs": "SELECT id, 'src' || CAST(user_id % 20 AS STRING) AS source_id, CAST(user_id AS STRING) AS crawl_run_id, CASE WHEN job_kind = 'FETCH_URL' THEN CAST(id % 400 AS STRING) END AS url_candidate_id, CASE WHEN job_kind <> 'FETCH_URL' THEN 'd' || CAST(id % 1200 AS STRING) END AS document_id, attempts - 1 AS attempts, CASE WHEN id % 8 = 0 THEN 0 ELSE 3 END AS max_attempts FROM {g_jobs}",
    "claims": "SELECT id, subject_id, object_id, CASE WHEN line > 1 THEN CAST(orderkey AS STRING) || '-' || CAST(line - 1 AS STRING) END AS supersedes_id FROM {g_claims}",
}
_DRAFTS["sources"] = _DRAFTS["sources"].replace("SELECT source AS id", "SELECT id").replace("ELSE source END", "ELSE id END")


def _plain(sql: str) -> str:
    return sql.replace("{", "").replace("}", "")


def _told(table: str, whens: list[tuple[str, str]], from_: str) -> str:
    cases = " ".join(f"WHEN {test} THEN '{reason}'" for test, reason in whens)
    return f"r_{table} AS (SELECT d.id, CASE {cases} END AS reason FROM {from_})"


def _missing(column: str, table: str, needed: bool = True) -> str:
    test = f"NOT EXISTS (SELECT 1 FROM ok_{table} x WHERE x.id = d.{column})"
    return test if needed else f"d.{column} IS NOT NULL AND {test}"


#: Tables from those that refer to none to those that refer to others; claims refer to claims, along each order's lines.
_ADMITTED = ", ".join([
    *(f"d_{t} AS ({_plain(sql)})" for t, sql in _DRAFTS.items()),
    _told("sources", [("trim(d.name) = ''", "name must not be empty.")], "d_sources d"), "ok_sources AS (SELECT id FROM r_sources WHERE reason IS NULL UNION ALL SELECT 'src0')",
    _told("entities", [("trim(d.canonical_name) = ''", "canonicalName must not be empty."), ("trim(d.slug) = ''", "slug must not be empty.")], "d_entities d"), "ok_entities AS (SELECT id FROM r_entities WHERE reason IS NULL)",
    _told("entity_aliases", [("trim(d.alias) = ''", "alias must not be empty."), ("d.valid_from > d.valid_to", "validFrom must be before or equal to validTo."), (_missing("entity_id", "entities"), "Cannot create an alias for an unknown entity."), (_missing("source_id", "sources", False), "Cannot create an alias from an unknown source.")], "d_entity_aliases d"),
    _told("documents", [("trim(d.original_url) = ''", "originalUrl must not be empty."), (_missing("source_id", "sources"), "Cannot create a document for an unknown source.")], "d_documents d"), "ok_documents AS (SELECT id FROM r_documents WHERE reason IS NULL)",
    _told("crawl_runs", [(_missing("source_id", "sources"), "Cannot create a crawl run for an unknown source."), ("d.finished_at < d.started_at", "crawl run finishedAt must be after startedAt.")], "d_crawl_runs d"), "ok_crawl_runs AS (SELECT id FROM r_crawl_runs WHERE reason IS NULL)",
    _told("url_candidates", [("trim(d.original_url) = ''", "originalUrl must not be empty."), ("trim(d.canonical_url) = ''", "canonicalUrl must not be empty."), (_missing("source_id", "sources"), "Cannot create a URL candidate for an unknown source."), (_missing("crawl_run_id", "crawl_runs", False), "Cannot create a URL candidate for an unknown crawl run.")], "d_url_candidates d"), "ok_url_candidates AS (SELECT id FROM r_url_candidates WHERE reason IS NULL)",
    _told("ingestion_jobs", [(_missing("source_id", "sources"), "Cannot create an ingestion job for an unknown source."), (_missing("crawl_run_id", "crawl_runs", False), "Cannot create an ingestion job for an unknown crawl run."), (_missing("url_candidate_id", "url_candidates", False), "Cannot create an ingestion job for an unknown URL candidate."), (_missing("document_id", "documents", False), "Cannot create an ingestion job for an unknown document."), ("d.attempts < 0", "Ingestion job attempts cannot be negative."), ("d.max_attempts < 1", "Ingestion jobs require at least one allowed attempt.")], "d_ingestion_jobs d"),
    "s_claims AS (SELECT d.id, d.supersedes_id, CASE WHEN " + _missing("subject_id", "entities") + " THEN 'Claim subject entity does not exist.' WHEN " + _missing("object_id", "entities", False) + " THEN 'Claim object entity does not exist.' END AS shape FROM d_claims d)",
    "ok_claims(id) AS (SELECT id FROM s_claims WHERE shape IS NULL AND supersedes_id IS NULL UNION SELECT s.id FROM s_claims s JOIN ok_claims o ON o.id = s.supersedes_id WHERE shape IS NULL)",
    "r_claims AS (SELECT s.id, coalesce(shape, CASE WHEN supersedes_id IS NOT NULL AND supersedes_id NOT IN (SELECT id FROM ok_claims) THEN 'Claim does not exist.' END) AS reason FROM s_claims s)",
])


@query("draft_admission", f"WITH RECURSIVE {_ADMITTED} " + " UNION ALL ".join(f"SELECT '{t}' AS tbl, CAST(id AS VARCHAR) AS id, reason IS NULL AS accepted, reason FROM r_{t}" for t in _DRAFTS))
def draft_admission(b: Bridge) -> DataFrame:
    import re

    table = lambda name: b.once(name) if name == "g_claims" else b(name)
    made = {t: b.spark.sql(sql, **{n: table(n) for n in re.findall(r"\{(\w+)\}", sql)}) for t, sql in _DRAFTS.items()}
    stored = {"sources": b("g_sources").agg(F.lit("src0").alias("id"))}
    return admission.admit(made, stored).withColumnRenamed("table", "tbl")


#: An edit of most verified claims, a second one of some, and some of claims that are not verified or not there; evidence can be missing, blank or of no known document.
_EDITS = """SELECT 'x' || CAST(n AS STRING) || '-' || id AS id, CASE WHEN partkey % 23 = 0 THEN 'gone' ELSE id END AS claim_id, partkey * 2 + n AS seq, 'e' || CAST(n AS STRING) AS actor_id, CASE WHEN partkey % 13 = 0 THEN object_id ELSE subject_id END AS subject_id, CASE WHEN partkey % 2 = 0 THEN 'EMPLOYED_BY' ELSE predicate END AS predicate,
  CASE WHEN partkey % 17 <> 0 THEN object_id END AS object_id, 'HISTORICAL' AS connection_class, valid_from, CASE WHEN partkey % 19 = 0 THEN DATE '1900-01-01' ELSE valid_to END AS valid_to, '{}' AS literal_value
  FROM (SELECT *, 1 AS n FROM {g_claims} WHERE status <> 'DISPUTED' UNION ALL SELECT *, 2 FROM {g_claims} WHERE partkey % 3 = 0 AND status = 'VERIFIED') c"""
_PROOF = """SELECT 'x' || CAST(n AS STRING) || '-' || claim_id AS claim_id, CASE WHEN length(id) % 6 = 0 THEN 'none' ELSE document_id END AS document_id, evidence_text, 3 AS start_char, CASE WHEN length(id) % 5 = 0 THEN 2 ELSE 9 END AS end_char FROM (SELECT *, 1 AS n FROM {g_evidence} UNION ALL SELECT *, 2 FROM {g_evidence}) v"""
_JUDGED = f"""ed AS ({_EDITS.replace("'{}'", "'{{}}'").format(g_claims='g_claims')}), pr AS ({_plain(_PROOF)}),
bad AS (SELECT claim_id, count(*) AS n, min(CASE WHEN trim(evidence_text) = '' THEN 'evidenceText must not be empty.' WHEN claim_id NOT IN (SELECT id FROM ed) THEN 'Cannot add evidence to an unknown claim.' WHEN document_id NOT IN (SELECT id FROM g_documents) THEN 'Cannot add evidence from an unknown document.' WHEN start_char > end_char THEN 'startChar must be before or equal to endChar.' END) AS reason FROM pr GROUP BY claim_id),
j0 AS (SELECT ed.*, CASE WHEN bad.n IS NULL THEN 'Edited verified claims require replacement evidence.' WHEN c.id IS NULL THEN 'Claim does not exist.' WHEN c.status <> 'VERIFIED' THEN 'Only verified claims can be superseded.' WHEN ed.valid_from > ed.valid_to THEN 'Date range must start before it ends.' WHEN s.id IS NULL THEN 'Claim subject entity does not exist.'
   WHEN ed.object_id IS NOT NULL AND ed.object_id = ed.subject_id THEN 'A claim cannot relate an entity to itself.' WHEN ed.object_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM g_compatible k WHERE k.predicate = ed.predicate AND k.subject_type = s.entity_type AND k.object_type = o.entity_type) THEN 'Claim predicate is incompatible with the subject or object entity type.'
   WHEN bad.reason IS NOT NULL THEN bad.reason WHEN ed.object_id IS NULL THEN 'Literal claims are not publishable graph relationships yet.' END AS reason
   FROM ed LEFT JOIN bad ON bad.claim_id = ed.id LEFT JOIN g_claims c ON c.id = ed.claim_id LEFT JOIN g_entities s ON s.id = ed.subject_id LEFT JOIN g_entities o ON o.id = ed.object_id),
judged AS (SELECT * REPLACE (CASE WHEN reason IS NULL AND EXISTS (SELECT 1 FROM j0 e WHERE e.reason IS NULL AND e.claim_id = j0.claim_id AND (e.seq, e.id) < (j0.seq, j0.id)) THEN 'Only verified claims can be superseded.' ELSE reason END AS reason) FROM j0)"""


def _judged(b: Bridge, judge=review.edit_verdicts) -> tuple[DataFrame, DataFrame]:
    edits = b.spark.sql(_EDITS.replace("'{}'", "'{{}}'"), g_claims=b("g_claims"))
    proof = b.spark.sql(_PROOF, g_evidence=b("g_evidence"))
    return judge(edits, proof, b("g_claims"), b("g_entities"), b("g_compatible"), b("g_documents")), proof


@query("edit_verdicts", f"WITH {_JUDGED} SELECT id, claim_id, reason FROM judged")
def edit_verdicts(b: Bridge) -> DataFrame:
    return _judged(b)[0].select("id", "claim_id", "reason")


@query("edited_tables", f"""WITH {_JUDGED}, made AS (SELECT * FROM judged WHERE reason IS NULL)
SELECT 'claims' AS tbl, id, 'VERIFIED' AS status, claim_id AS about FROM made UNION ALL SELECT 'claims', claim_id, 'OUTDATED', NULL FROM made
UNION ALL SELECT 'evidence', sha256(claim_id || '|' || document_id || '|' || trim(evidence_text)), sha256(trim(evidence_text)), claim_id FROM pr WHERE claim_id IN (SELECT id FROM made)
UNION ALL SELECT 'audit', seq || ':' || step, action, entity FROM (SELECT seq, unnest([0, 1, 2]) AS step, unnest(['CLAIM_OUTDATED', 'CLAIM_SUPERSEDED', 'CLAIM_VERIFIED']) AS action, unnest([claim_id, id, id]) AS entity FROM made)
UNION ALL SELECT 'queue', id, 'RESOLVED', claim_id FROM g_queue WHERE status IN ('OPEN', 'ASSIGNED') AND claim_id IN (SELECT claim_id FROM made UNION SELECT id FROM made)""")
def edited_tables(b: Bridge) -> DataFrame:
    made, proof = _judged(b, review.edits_made)
    t = review.edit_changes(written(made.select("id", "claim_id", "seq")), proof, b("g_claims"), b("g_queue"))  # named by each table
    row = lambda name, *columns: t[name].select(F.lit(name).alias("tbl"), *[F.col(c).alias(a) for c, a in zip(columns, ("id", "status", "about"), strict=True)])
    return row("claims", "id", "status", "supersedes_id").union(row("evidence", "id", "evidence_hash", "claim_id")).union(row("audit", "id", "action", "entity_id")).union(row("queue", "id", "status", "claim_id"))
