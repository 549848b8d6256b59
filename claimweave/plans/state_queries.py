"""Queries of review, integrity, roles and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..bridge import Bridge
from ..functions import urls
from ..ontology import ENTITY_TYPES, PREDICATES
from ..operators import api, contracts, integrity, jobs, review
from .registry import query

_UNQ = "g_claims c WHERE c.status IN ('DETECTED', 'PENDING_REVIEW', 'DISPUTED') AND NOT EXISTS (SELECT 1 FROM g_queue q WHERE q.claim_id = c.id AND q.status IN ('OPEN', 'ASSIGNED'))"
AS_OF = "2024-01-15 00:00:00"


@query("scan_sources", "SELECT id, name, domain, source_quality, source_type, enabled FROM g_sources")
def scan_sources(b: Bridge) -> DataFrame:
    return b("g_sources").select("id", "name", "domain", "source_quality", "source_type", "enabled")


@query("enabled_sources", "SELECT id, name FROM g_sources WHERE enabled")
def enabled_sources(b: Bridge) -> DataFrame:
    return b("g_sources").where("enabled").select("id", "name").orderBy("name")


@query("typed_projection", "SELECT id, nullif(trim(canonical_name), '') AS canonical_name, nullif(trim(canton), '') AS canton, TRY_CAST(country AS INT) AS country FROM g_entities")
def typed_projection(b: Bridge) -> DataFrame:
    from ..sources.tables import typed

    rows, _ = typed(b("g_entities").select("id", "canonical_name", "canton", "country"), _schema("id string, canonical_name string, canton string, country int"), ("id",))
    return rows


def _schema(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


@query("unqueued_claims", f"SELECT c.id FROM {_UNQ}")
def unqueued_claims(b: Bridge) -> DataFrame:
    return review.unqueued(b("g_claims"), b("g_queue")).select("id")


@query("review_items", f"""WITH i AS (SELECT q.id AS queue_id, q.claim_id, q.status AS queue_status, q.created_on AS queued_on, c.subject_id, c.object_id, c.predicate, c.status, c.created_on FROM g_queue q JOIN g_claims c ON c.id = q.claim_id WHERE q.status IN ('OPEN', 'ASSIGNED')
UNION ALL SELECT NULL, c.id, NULL, NULL, c.subject_id, c.object_id, c.predicate, c.status, c.created_on FROM {_UNQ}),
e AS (SELECT ev.claim_id, count(*) AS n, string_agg(DISTINCT s.source_quality, ',' ORDER BY s.source_quality) AS qualities FROM g_evidence ev LEFT JOIN g_documents d ON d.id = ev.document_id LEFT JOIN g_sources s ON s.id = d.source_id GROUP BY ev.claim_id)
SELECT queue_id, i.claim_id, queue_status, predicate, status, s.canonical_name AS subject_name, o.canonical_name AS object_name, CAST(coalesce(queued_on, created_on) AS VARCHAR) AS sort_day, coalesce(e.n, 0) AS n_evidence, e.qualities
FROM i LEFT JOIN g_entities s ON s.id = i.subject_id LEFT JOIN g_entities o ON o.id = i.object_id LEFT JOIN e ON e.claim_id = i.claim_id""")
def review_items(b: Bridge) -> DataFrame:
    items = review.review_items(b("g_claims"), b("g_queue"), b("g_entities")).join(review.evidence_sides(b("g_evidence"), b("g_documents"), b("g_sources")), "claim_id", "left")
    shown = items.select("queue_id", "claim_id", "queue_status", "predicate", "status", "subject_name", "object_name", F.col("sort_day").cast("string").alias("sort_day"), F.coalesce("n_evidence", F.lit(0).cast("long")).alias("n_evidence"), "qualities")
    return shown.orderBy("sort_day", "claim_id")


@query("review_resolution", """WITH k AS (SELECT DISTINCT claim_id, document_id FROM g_evidence WHERE document_id IN (SELECT id FROM g_documents)),
l AS (SELECT task_id, string_agg(entity_id || '=' || coalesce(e.canonical_name, ''), ';' ORDER BY score DESC, entity_id) AS c FROM g_task_candidates t LEFT JOIN g_entities e ON e.id = t.entity_id GROUP BY task_id)
SELECT k.claim_id, t.id AS task_id, t.status, coalesce(l.c, '') AS candidates FROM k JOIN g_tasks t ON t.document_id = k.document_id LEFT JOIN l ON l.task_id = t.id""")
def review_resolution(b: Bridge) -> DataFrame:
    found = review.review_resolution(b("g_evidence"), b("g_documents"), b("g_tasks"), b("g_task_candidates"), b("g_entities"))
    return found.select("claim_id", "task_id", "status", F.array_join(F.transform("candidates", lambda c: F.concat(c["entity_id"], F.lit("="), F.coalesce(c["name"], F.lit("")))), ";").alias("candidates"))


@query("resolve_queue", "SELECT id, claim_id, CASE WHEN status IN ('OPEN', 'ASSIGNED') AND claim_id IN (SELECT id FROM g_claims WHERE status = 'DISPUTED') THEN 'RESOLVED' ELSE status END AS status FROM g_queue")
def resolve_queue(b: Bridge) -> DataFrame:
    return review.resolve_queue(b("g_queue"), b("g_claims").where("status = 'DISPUTED'").select(F.col("id").alias("claim_id")))


@query("queue_claims", f"SELECT c.id || ':new' AS id, c.id AS claim_id, 'OPEN' AS status FROM {_UNQ}")
def queue_claims(b: Bridge) -> DataFrame:
    return review.queue_claims(b("g_claims"), b("g_queue")).select("id", "claim_id", "status")


#: A log of reviews: some claims are verified before their evidence comes, some twice, and some transitions are of claims that do not exist.
_LOG = """SELECT CASE WHEN partkey % 7 = 0 THEN 'gone-' || id ELSE id END AS claim_id, 1 AS seq, CASE WHEN partkey % 3 = 0 THEN 'REJECTED' ELSE 'VERIFIED' END AS to_status, 'r1' AS actor_id FROM {g_claims} WHERE status = 'PENDING_REVIEW'
  UNION ALL SELECT id, 2, 'DISPUTED', 'r2' FROM {g_claims} WHERE status = 'PENDING_REVIEW' AND partkey % 4 = 0 UNION ALL SELECT id, 3, 'VERIFIED', 'r3' FROM {g_claims} WHERE status = 'PENDING_REVIEW' AND partkey % 2 = 0
  UNION ALL SELECT id, 4, 'OUTDATED', 'r1' FROM {g_claims} WHERE status IN ('VERIFIED', 'DISPUTED') AND partkey % 8 = 0"""
_DATED = "SELECT claim_id, min(CASE WHEN document_id LIKE '%1' THEN 2 WHEN document_id LIKE '%2' THEN 9 ELSE 0 END) AS seq FROM g_evidence GROUP BY claim_id"
_LITERAL = "SELECT *, CASE WHEN partkey % 2 = 0 THEN '{}' END AS literal FROM g_claims"
_JUDGED = f"""log AS ({_LOG.replace('{g_claims}', 'g_claims')}), ev AS ({_DATED}), cl AS ({_LITERAL}),
shape AS (SELECT c.*, CASE WHEN c.valid_from > c.valid_to THEN 'Date range must start before it ends.' WHEN s.id IS NULL THEN 'Claim subject entity does not exist.' WHEN c.object_id IS NULL AND literal IS NULL THEN 'A claim needs either an object entity or a literal value.'
   WHEN c.object_id IS NOT NULL AND o.id IS NULL THEN 'Claim object entity does not exist.' WHEN c.object_id = c.subject_id THEN 'A claim cannot relate an entity to itself.' WHEN c.object_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM g_compatible k WHERE k.predicate = c.predicate AND k.subject_type = s.entity_type AND k.object_type = o.entity_type) THEN 'Claim predicate is incompatible with the subject or object entity type.' END AS shape
   FROM cl c LEFT JOIN g_entities s ON s.id = c.subject_id LEFT JOIN g_entities o ON o.id = c.object_id),
judged AS (SELECT log.*, c.*, CASE WHEN c.id IS NULL THEN 'Claim does not exist.' WHEN to_status = 'VERIFIED' THEN CASE WHEN shape IS NOT NULL THEN shape WHEN ev.seq IS NULL OR ev.seq > log.seq THEN 'A claim cannot be verified without evidence.' WHEN object_id IS NULL THEN 'Literal claims are not publishable graph relationships yet.' END END AS reason
   FROM log LEFT JOIN shape c ON c.id = log.claim_id LEFT JOIN ev ON ev.claim_id = log.claim_id)"""


def _log(b: Bridge) -> tuple[DataFrame, ...]:
    """Claims, a log of their transitions, and what it is judged by."""
    document = F.col("document_id")
    dated = b("g_evidence").select("claim_id", F.when(document.endswith("1"), 2).when(document.endswith("2"), 9).otherwise(0).alias("seq"))
    claims = b("g_claims").withColumn("literal_value", F.when(F.col("partkey") % 2 == 0, "{}"))
    return claims, b.spark.sql(_LOG, g_claims=b("g_claims")), b("g_entities"), b("g_compatible"), dated


def _judged(b: Bridge) -> DataFrame:
    return review.transitions(*_log(b))


@query("transition_log", f"WITH {_JUDGED} SELECT claim_id, seq, to_status, reason FROM judged")
def transition_log(b: Bridge) -> DataFrame:
    return _judged(b).select("claim_id", "seq", "to_status", "reason")


@query("claim_current_state", f"WITH {_JUDGED}, l AS (SELECT id, arg_max(to_status, seq) AS to_status, arg_max(actor_id, seq) AS actor_id, count(*) AS n FROM judged WHERE reason IS NULL GROUP BY id) SELECT c.id, coalesce(l.to_status, c.status) AS status, l.actor_id AS reviewed_by, coalesce(n, 0) AS n_transitions FROM g_claims c LEFT JOIN l ON l.id = c.id")
def claim_current_state(b: Bridge) -> DataFrame:
    return review.reviewed(*_log(b))


_VALUE = """'{{"predicate":"' || predicate || '","connectionClass":"' || connection_class || '","verificationStatus":"' || {} || '","subjectEntityId":"' || subject_id || CASE WHEN object_id IS NULL THEN '' ELSE '","objectEntityId":"' || object_id END || '"}}'"""


@query("audit_values", f"""WITH {_JUDGED}, a AS (SELECT *, coalesce(lag(to_status) OVER (PARTITION BY claim_id ORDER BY seq), status) AS old FROM judged WHERE reason IS NULL)
SELECT claim_id, seq, actor_id, 'CLAIM_' || to_status AS action, {_VALUE.format('old')} AS old_value, {_VALUE.format('to_status')} AS new_value FROM a""")
def audit_values(b: Bridge) -> DataFrame:
    return review.audit(_judged(b))


#: Suppliers merge into the next smaller one or into one of a tenth of their number, in an order that mixes them: chains, and targets that are gone before or after.
_MERGES = "SELECT 's:' || CAST(s_suppkey AS STRING) AS source_id, 's:' || CAST(CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey - 1 ELSE s_suppkey // 10 + 1 END AS STRING) AS target_id, (s_suppkey * 7919) % 1000003 AS seq FROM {supplier} WHERE s_suppkey % 4 <> 1".replace("//", "DIV")


def _merges(b: Bridge) -> DataFrame:
    return b.spark.sql(_MERGES, supplier=b("supplier"))


_M = _MERGES.replace("{supplier}", "supplier").replace("DIV", "//")


@query("merge_entities", f"""WITH RECURSIVE m AS (SELECT * FROM ({_M}) WHERE source_id <> target_id),
go(first, here, seq) AS (SELECT id, id, -1 FROM g_entities UNION ALL SELECT first, m.target_id, m.seq FROM go JOIN m ON m.source_id = go.here AND m.seq > go.seq AND NOT EXISTS (SELECT 1 FROM m e WHERE e.source_id = go.here AND e.seq > go.seq AND e.seq < m.seq)),
f AS (SELECT first, arg_max(here, seq) AS here FROM go GROUP BY first)
SELECT c.id, coalesce(a.here, c.subject_id) AS subject_id, coalesce(z.here, c.object_id) AS object_id, c.predicate FROM g_claims c LEFT JOIN f a ON a.first = c.subject_id LEFT JOIN f z ON z.first = c.object_id""")
def merge_entities(b: Bridge) -> DataFrame:
    return review.merge_entities(b("g_claims"), _merges(b))


@query("merge_check", f"WITH m AS (SELECT 's:' || CAST(s_suppkey AS STRING) AS source_id, 'c:' || CAST(s_suppkey AS STRING) AS target_id FROM supplier) SELECT c.id FROM g_claims c LEFT JOIN m z ON z.source_id = c.object_id WHERE c.subject_id = coalesce(z.target_id, c.object_id)")
def merge_check(b: Bridge) -> DataFrame:
    merges = b("supplier").selectExpr("'s:' || CAST(s_suppkey AS STRING) AS source_id", "'c:' || CAST(s_suppkey AS STRING) AS target_id")
    return review.merge_conflicts(b("g_claims"), merges).select("id")


_PROPOSED = "SELECT id AS source_id, CASE WHEN k % 5 = 0 THEN id WHEN k % 5 = 1 THEN 's:' || CAST(k + 1 AS STRING) WHEN k % 5 = 2 THEN 'c:' || CAST(k AS STRING) WHEN k % 5 = 3 THEN 'n:' || CAST(k AS STRING) ELSE 's:1' END AS target_id FROM (SELECT s_suppkey AS k, 's:' || CAST(s_suppkey AS STRING) AS id FROM supplier) p"


def _proposed(b: Bridge) -> DataFrame:
    return b.spark.sql(_PROPOSED.replace("FROM supplier", "FROM {supplier}"), supplier=b("supplier"))


@query("merge_verdicts", f"""WITH p AS ({_PROPOSED}) SELECT source_id, target_id, CASE WHEN source_id = target_id THEN 'Cannot merge an entity into itself.' WHEN s.id IS NULL OR t.id IS NULL THEN 'Cannot merge unknown entities.' WHEN s.entity_type <> t.entity_type THEN 'Only entities with the same type can be merged.'
  WHEN EXISTS (SELECT 1 FROM g_claims c WHERE (c.subject_id = p.source_id AND c.object_id = p.target_id) OR (c.subject_id = p.target_id AND c.object_id = p.source_id)) THEN 'Cannot merge entities while claims would become self-relations.' END AS reason
FROM p LEFT JOIN g_entities s ON s.id = p.source_id LEFT JOIN g_entities t ON t.id = p.target_id""")
def merge_verdicts(b: Bridge) -> DataFrame:
    return review.merge_verdicts(_proposed(b), b("g_entities"), b("g_claims"))


@query("merge_audit", f"""WITH m AS ({_M}) SELECT e.id, 'ENTITY_MERGED' AS action, '{{"id":"' || e.id || '","entityType":"' || entity_type || '","canonicalName":"' || canonical_name || '"}}' AS old_value, '{{"id":"' || e.id || '","entityType":"' || entity_type || '","canonicalName":"' || canonical_name || '","targetEntityId":"' || target_id || '"}}' AS new_value FROM g_entities e JOIN m ON m.source_id = e.id""")
def merge_audit(b: Bridge) -> DataFrame:
    return review.mark_merged(b("g_entities"), _merges(b))


@query("superseded", "WITH l AS (SELECT lag(id) OVER (PARTITION BY orderkey ORDER BY line) AS old FROM g_claims WHERE line > 0) SELECT id, CASE WHEN id IN (SELECT old FROM l WHERE old IS NOT NULL) THEN 'OUTDATED' ELSE status END AS status FROM g_claims")
def superseded(b: Bridge) -> DataFrame:
    from pyspark.sql.window import Window

    edits = b("g_claims").where("line > 0").select("id", F.lag("id").over(Window.partitionBy("orderkey").orderBy("line")).alias("supersedes_id")).where("supersedes_id is not null")
    return review.superseding(b("g_claims"), edits)


@query("claim_lineage", "WITH RECURSIVE l AS (SELECT orderkey, line, id, CASE WHEN row_number() OVER (PARTITION BY orderkey ORDER BY line) > 1 THEN lag(id) OVER (PARTITION BY orderkey ORDER BY line) END AS prior FROM g_claims WHERE line > 0), r(id, root, depth) AS (SELECT id, id, 0 FROM l WHERE prior IS NULL UNION ALL SELECT l.id, r.root, r.depth + 1 FROM l JOIN r ON l.prior = r.id) SELECT id, root, depth FROM r")
def claim_lineage(b: Bridge) -> DataFrame:
    from pyspark.sql.window import Window

    order = Window.partitionBy("orderkey").orderBy("line")
    links = b("g_claims").where("line > 0").select("id", F.lag("id").over(order).alias("supersedes_id"))
    return review.lineage(links)


@query("dashboard", f"""SELECT (SELECT count(*) FROM g_sources) AS sources, (SELECT count(*) FROM g_documents) AS documents, (SELECT count(*) FROM g_claims) AS claims, (SELECT count(*) FROM g_claims WHERE status = 'VERIFIED') AS public_claims,
  (SELECT count(*) FROM g_queue WHERE status = 'OPEN') AS open_items, (SELECT count(*) FROM g_queue WHERE status = 'ASSIGNED') AS assigned_items, (SELECT count(*) FROM {_UNQ}) AS unqueued,
  (SELECT count(*) FROM g_jobs WHERE status = 'PENDING' AND trim(coalesce(error_message, '')) <> '' AND attempts < max_attempts) AS retryable,
  (SELECT count(*) FROM g_jobs WHERE status = 'PENDING' AND trim(coalesce(error_message, '')) <> '' AND attempts < max_attempts AND scheduled_at <= TIMESTAMP '{AS_OF}') AS due_retryable,
  (SELECT count(*) FROM g_jobs WHERE status = 'FAILED' AND attempts >= max_attempts) AS exhausted, (SELECT count(*) FROM g_jobs WHERE status = 'RUNNING') AS running""")
def dashboard(b: Bridge) -> DataFrame:
    return review.dashboard(b("g_sources"), b("g_documents"), b("g_claims"), b("g_queue"), b("g_jobs"), AS_OF)


_CARDS = ("sources", "documents", "claims", "public_claims", "unqueued")
_COUNTED = {"sources": "g_sources", "documents": "g_documents", "claims": "g_claims", "public_claims": "g_claims WHERE status = 'VERIFIED'", "unqueued": _UNQ}


@query("dashboard_cards", " UNION ALL ".join(f"SELECT '{c}' AS card, count(*) AS n, format('{{:,}}', count(*)) AS shown FROM {_COUNTED[c]}" for c in _CARDS))
def dashboard_cards(b: Bridge) -> DataFrame:
    return review.cards(review.dashboard(b("g_sources"), b("g_documents"), b("g_claims"), b("g_queue"), b("g_jobs"), AS_OF)).where(F.col("card").isin(*_CARDS))


@query("source_registry", """WITH f AS (SELECT id, trim(CASE WHEN k % 2 = 0 THEN ' ' || name || ' ' ELSE name END) AS name, lower(domain) AS domain, CASE k % 5 WHEN 0 THEN 0 WHEN 1 THEN 600 WHEN 2 THEN 12 WHEN 3 THEN 0 ELSE 0 END AS requests_per_minute, least(10, greatest(1, k - 3)) AS concurrency, k, 100 + k AS updated_at FROM g_sources WHERE enabled),
r AS (SELECT id, name, domain, requests_per_minute, concurrency::INT AS concurrency, updated_at FROM f UNION ALL SELECT id, 'old', domain, 10, 1, k FROM g_sources WHERE NOT enabled)
SELECT id, name, domain, requests_per_minute, concurrency, updated_at FROM r""")
def source_registry(b: Bridge) -> DataFrame:
    from ..operators import discovery

    s, k = b("g_sources"), F.col("k")
    old = s.select("id", F.lit("old").alias("name"), "domain", F.lit(10).alias("requests_per_minute"), F.lit(1).alias("concurrency"), k.alias("updated_at"))
    asked = F.element_at(F.array(*[F.lit(x) for x in ("-4.5", "9e9", "12.9", "many", "-0.5")]), (k % 5 + 1).cast("int"))
    form = s.where("enabled").select("id", F.when(k % 2 == 0, F.concat(F.lit(" "), "name", F.lit(" "))).otherwise(F.col("name")).alias("name"), F.concat(F.lit(" HTTPS://"), F.upper("domain"), F.lit("/a ")).alias("domain"), asked.alias("requests_per_minute"), (k - 3 + F.lit(0.7)).cast("string").alias("concurrency"), k.alias("updated_at"))
    earlier, later = form.withColumn("name", F.lit("first")), form.withColumn("updated_at", F.col("updated_at") + 100)
    return discovery.registry(old, discovery.saved_sources(earlier.unionByName(later)))


@query("referential_cascade", "SELECT e.id FROM g_evidence e WHERE e.claim_id IN (SELECT id FROM g_claims WHERE subject_id IN (SELECT id FROM g_entities) AND (object_id IS NULL OR object_id IN (SELECT id FROM g_entities))) AND e.document_id IN (SELECT id FROM g_documents WHERE source_id IN (SELECT id FROM g_sources))")
def referential_cascade(b: Bridge) -> DataFrame:
    return integrity.cascade(b("g_entities"), b("g_aliases"), b("g_sources"), b("g_documents"), b("g_claims"), b("g_evidence"))["evidence"].select("id")


@query("constraint_violations", """SELECT 'object_or_literal' AS rule, id FROM g_claims WHERE object_id IS NULL UNION ALL SELECT 'dates_ordered', id FROM g_claims WHERE valid_from > valid_to
UNION ALL SELECT 'slug_form', id FROM g_entities WHERE NOT regexp_matches(slug, '^[a-z0-9]+(-[a-z0-9]+)*$') UNION ALL SELECT 'name_not_blank', id FROM g_entities WHERE trim(canonical_name) = '' UNION ALL SELECT 'text_not_blank', id FROM g_evidence WHERE trim(evidence_text) = ''
UNION ALL SELECT 'target_given', CAST(id AS VARCHAR) FROM g_jobs UNION ALL SELECT 'ended_dated', CAST(id AS VARCHAR) FROM g_jobs WHERE status = 'FAILED'""")
def constraint_violations(b: Bridge) -> DataFrame:
    out = integrity.check(b("g_claims"), "claims")
    for name, table in (("g_entities", "entities"), ("g_evidence", "claim_evidence"), ("g_jobs", "ingestion_jobs"), ("g_aliases", "entity_aliases"), ("g_sources", "sources"), ("g_documents", "documents")):
        out = out.union(integrity.check(b(name), table))
    return out


#: Tables with the columns that rules ask for, many of them out of bounds.
_WIDE = {
    "claims": ("SELECT id, status, connection_class, object_id, subject_id, valid_from, valid_to, CASE WHEN partkey % 2 = 0 THEN '{{}}' END AS literal_value, partkey / 1000.0 AS confidence_score, CASE WHEN partkey % 3 = 0 THEN 'r' END AS reviewed_by, CASE WHEN partkey % 5 <> 0 THEN created_on END AS reviewed_at FROM {g_claims}", "g_claims"),
    "entities": ("SELECT id, entity_type, CASE WHEN slug LIKE '%3' THEN ' ' ELSE canonical_name END AS canonical_name, CASE WHEN slug LIKE '%5' THEN upper(slug) ELSE slug END AS slug, CASE WHEN slug LIKE '%7' THEN 'ch' ELSE 'CH' END AS country_code FROM {g_entities}", "g_entities"),
    "claim_evidence": ("SELECT id, evidence_text, length(id) - 4 AS start_char, length(document_id) AS end_char, length(document_id) - 2 AS page_number FROM {g_evidence}", "g_evidence"),
    "documents": ("SELECT id, original_url, CASE WHEN number % 5 = 0 THEN ' ' ELSE canonical_url END AS canonical_url, CASE WHEN number % 3 = 0 THEN 'de-CH' WHEN number % 3 = 1 THEN 'german' ELSE 'fr' END AS language, sha2(extracted_text, 256) AS content_hash, number AS http_status, CASE WHEN number % 4 = 0 THEN 'SECRET' ELSE 'PUBLIC' END AS access_status FROM {g_documents}", "g_documents"),
    "ingestion_jobs": ("SELECT id, status, job_kind, attempts - 1 AS attempts, CASE WHEN id % 9 = 0 THEN 0 ELSE 2 END AS max_attempts, CASE WHEN id % 2 = 0 THEN scheduled_at END AS finished_at, CASE WHEN id % 6 <> 0 THEN user_id END AS url_candidate_id, CASE WHEN id % 5 <> 0 THEN user_id END AS document_id FROM {g_jobs}", "g_jobs"),
}
_HELD = {
    "claims": {"status_known": "true", "class_known": "true", "confidence_bounded": "confidence_score BETWEEN 0 AND 1", "object_or_literal": "object_id IS NOT NULL OR literal_value IS NOT NULL", "no_self_relation": "object_id <> subject_id", "dates_ordered": "valid_from <= valid_to", "review_dated": "reviewed_by IS NULL OR reviewed_at IS NOT NULL"},
    "entities": {"name_not_blank": "trim(canonical_name) <> ''", "slug_form": "regexp_full_match(slug, '[a-z0-9]+(-[a-z0-9]+)*')", "country_form": "regexp_full_match(country_code, '[A-Z]{2}')", "type_known": "true"},
    "claim_evidence": {"text_not_blank": "trim(evidence_text) <> ''", "start_not_negative": "start_char >= 0", "end_not_negative": "end_char >= 0", "page_positive": "page_number > 0", "hash_form": None, "span_ordered": "start_char <= end_char"},
    "documents": {"original_url_not_blank": "trim(original_url) <> ''", "canonical_url_not_blank": "trim(canonical_url) <> ''", "language_form": "language <> 'german'", "hash_form": "true", "http_status_bounded": "http_status BETWEEN 100 AND 599", "access_known": "access_status = 'PUBLIC'", "extraction_known": None},
    "ingestion_jobs": {"attempts_not_negative": "attempts >= 0", "max_attempts_positive": "max_attempts > 0", "attempts_bounded": "attempts <= max_attempts", "ended_dated": "status <> 'FAILED' OR finished_at IS NOT NULL", "target_given": "CASE job_kind WHEN 'FETCH_URL' THEN url_candidate_id IS NOT NULL ELSE document_id IS NOT NULL END"},
}


def _rule_sql() -> str:
    duck = lambda sql: sql.replace("{{}}", "\x00").replace("{", "").replace("}", "").replace("\x00", "{}").replace("sha2(extracted_text, 256)", "sha256(extracted_text)")
    tables = ", ".join(f"w_{t} AS ({duck(sql)})" for t, (sql, _) in _WIDE.items())
    rows = [f"SELECT '{t}' AS tbl, '{n}' AS rule, '{'unchecked' if held is None else 'checked'}' AS state, " + ("NULL" if held is None else f"(SELECT count(*) FROM w_{t} WHERE NOT coalesce({held}, true))") + " AS n" for t, rules in _HELD.items() for n, held in rules.items()]
    return f"WITH {tables} {' UNION ALL '.join(rows)}"


@query("rule_report", _rule_sql())
def rule_report(b: Bridge) -> DataFrame:
    out = None
    for table, (sql, name) in _WIDE.items():
        told = integrity.report(b.spark.sql(sql, **{name: b(name)}), table)
        out = told if out is None else out.union(told)
    return out


@query("unique_partial", "SELECT CAST(user_id AS VARCHAR) || '|' || job_kind AS key, count(*) AS n FROM g_jobs WHERE user_id IS NOT NULL AND status IN ('PENDING', 'RUNNING') GROUP BY user_id, job_kind HAVING count(*) > 1")
def unique_partial(b: Bridge) -> DataFrame:
    return integrity.unique_violations(b("g_jobs").withColumnRenamed("user_id", "url_candidate_id"), "ingestion_jobs")


@query("rls_public_evidence", "SELECT id FROM g_evidence WHERE claim_id IN (SELECT id FROM g_claims WHERE status = 'VERIFIED')")
def rls_public_evidence(b: Bridge) -> DataFrame:
    return integrity.visible_evidence("PUBLIC", b("g_claims"), b("g_evidence")).select("id")


@query("verified_without_evidence", "SELECT id FROM g_claims WHERE status = 'VERIFIED' AND id NOT IN (SELECT claim_id FROM g_evidence)")
def verified_without_evidence(b: Bridge) -> DataFrame:
    return integrity.without_evidence(b("g_claims"), b("g_evidence"))


@query("duplicate_keys", "SELECT CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) AS key, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def duplicate_keys(b: Bridge) -> DataFrame:
    return integrity.duplicates(b("lineitem"), "l_orderkey", "l_linenumber")


@query("rls_public_claims", "SELECT id FROM g_claims WHERE status = 'VERIFIED' AND id IN (SELECT claim_id FROM g_evidence)")
def rls_public_claims(b: Bridge) -> DataFrame:
    return integrity.public_claims(b("g_claims"), b("g_evidence")).select("id")


@query("rls_public_entities", "WITH c AS (SELECT * FROM g_claims WHERE status = 'VERIFIED' AND id IN (SELECT claim_id FROM g_evidence)) SELECT id FROM g_entities WHERE id IN (SELECT subject_id FROM c) OR id IN (SELECT object_id FROM c WHERE object_id IS NOT NULL)")
def rls_public_entities(b: Bridge) -> DataFrame:
    return integrity.public_entities(b("g_entities"), b("g_claims"), b("g_evidence")).select("id")


@query("role_resolve", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'ADMIN' WHEN event_id % 4 = 1 AND event_id % 3 = 0 THEN 'REVIEWER' WHEN event_id % 4 = 3 AND event_id % 3 = 0 THEN 'REVIEWER' WHEN event_id % 3 = 0 THEN 'REVIEWER' ELSE 'PUBLIC' END AS role FROM events")
def role_resolve(b: Bridge) -> DataFrame:
    app, user = F.when(F.col("event_id") % 4 == 0, " admin ").when(F.col("event_id") % 4 == 1, "nobody"), F.when(F.col("event_id") % 3 == 0, "reviewer")
    return b("events").select("event_id", integrity.role(app, user).alias("role"))


_ALL_TABLES = "['sources', 'entities', 'entity_aliases', 'documents', 'claims', 'claim_evidence', 'review_queue', 'audit_log', 'llm_runs', 'crawl_runs', 'entity_resolution_tasks', 'entity_resolution_candidates', 'url_candidates', 'crawl_schedules', 'ingestion_jobs']"


#: Each event asks for a table in a role: every combination comes up.
_ASKED = "SELECT event_id AS id, roles[1 + (event_id // 60) % len(roles)] AS role, tables[1 + event_id % 15] AS tbl, ['select', 'insert', 'update', 'delete'][1 + (event_id // 15) % 4] AS action FROM events, (SELECT {} AS roles, " + _ALL_TABLES + " AS tables)"
_MATRIX = f"""t AS (SELECT unnest({_ALL_TABLES}) AS tbl), allowed AS (SELECT unnest(['ADMIN', 'RESEARCHER', 'REVIEWER']) AS role, tbl, 'select' AS action FROM t UNION SELECT 'ADMIN', tbl, unnest(['insert', 'update', 'delete']) FROM t
UNION SELECT 'PUBLIC', unnest(['entities', 'claims', 'claim_evidence']), 'select' UNION SELECT 'RESEARCHER', unnest(['entities', 'entity_aliases', 'sources', 'documents', 'claims', 'claim_evidence', 'audit_log', 'entity_resolution_tasks', 'entity_resolution_candidates', 'url_candidates', 'crawl_schedules', 'ingestion_jobs']), 'insert'
UNION SELECT 'RESEARCHER', unnest(['url_candidates', 'crawl_schedules', 'ingestion_jobs']), 'update' UNION SELECT 'RESEARCHER', unnest(['crawl_schedules', 'ingestion_jobs']), 'delete'
UNION SELECT 'REVIEWER', unnest(['claim_evidence', 'review_queue', 'audit_log']), 'insert' UNION SELECT 'REVIEWER', unnest(['claims', 'review_queue', 'entity_resolution_tasks']), 'update' UNION SELECT 'REVIEWER', 'review_queue', 'delete')"""
_ROLES, _API_ROLES = ("ADMIN", "RESEARCHER", "REVIEWER", "PUBLIC", "GUEST"), ("anon", "authenticated", "service")
_GRANTED = f"allowed AS (SELECT 'anon' AS role, unnest(['entities', 'claims', 'claim_evidence']) AS tbl, 'select' AS action UNION ALL SELECT 'authenticated', tbl, unnest(['select', 'insert', 'update', 'delete']) FROM (SELECT unnest({_ALL_TABLES}) AS tbl))"


def _asked(b: Bridge, roles: tuple[str, ...]) -> DataFrame:
    i = F.col("event_id")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (F.lit(1) + F.pmod(n.cast("int"), F.lit(len(values)))).cast("int"))
    return b("events").select(i.alias("id"), pick(roles, F.floor(i / 60)).alias("role"), pick(_ALL_TABLES.strip("[]").replace("'", "").split(", "), i).alias("tbl"), pick(("select", "insert", "update", "delete"), F.floor(i / 15)).alias("action"))


@query("role_matrix", f"WITH {_MATRIX}, asked AS ({_ASKED.format(list(_ROLES))}) SELECT id, role, tbl, action, (role, tbl, action) IN (SELECT (role, tbl, action) FROM allowed) AS allowed FROM asked")
def role_matrix(b: Bridge) -> DataFrame:
    return integrity.decided(_asked(b, _ROLES), integrity.permissions())


@query("api_grants", f"WITH {_GRANTED}, asked AS ({_ASKED.format(list(_API_ROLES))}) SELECT id, role, tbl, action, (role, tbl, action) IN (SELECT (role, tbl, action) FROM allowed) AS allowed FROM asked")
def api_grants(b: Bridge) -> DataFrame:
    return integrity.decided(_asked(b, _API_ROLES), integrity.grants())


_WRITERS = "SELECT id, CASE partkey % 5 WHEN 0 THEN 'ADMIN' WHEN 1 THEN 'RESEARCHER' WHEN 2 THEN 'REVIEWER' WHEN 3 THEN 'PUBLIC' END AS role, CASE line % 2 WHEN 0 THEN 'insert' ELSE 'update' END AS action, status FROM {g_claims}"


@query("claim_writes", f"SELECT id, CASE WHEN role = 'ADMIN' THEN true WHEN role = 'RESEARCHER' AND action = 'insert' AND status IN ('DETECTED', 'PENDING_REVIEW') THEN true WHEN role = 'REVIEWER' AND action = 'update' THEN true ELSE false END AS allowed FROM ({_WRITERS.replace('{g_claims}', 'g_claims')})")
def claim_writes(b: Bridge) -> DataFrame:
    return integrity.claim_writes(b.spark.sql(_WRITERS, g_claims=b("g_claims")))


@query("ontology_check", """SELECT 'predicate' AS kind, predicate AS value, count(*) AS n FROM g_claims WHERE predicate IN (SELECT predicate FROM g_compatible) GROUP BY predicate
UNION ALL SELECT 'connection_class', connection_class, count(*) FROM g_claims WHERE connection_class IN ('DIRECT', 'INDIRECT', 'OFFICIAL', 'HISTORICAL') GROUP BY connection_class
UNION ALL SELECT 'status', status, count(*) FROM g_claims WHERE status IN ('DETECTED', 'PENDING_REVIEW', 'VERIFIED', 'REJECTED', 'DISPUTED', 'OUTDATED') GROUP BY status
UNION ALL SELECT 'entity_type', entity_type, count(*) FROM g_entities WHERE entity_type IN ('PERSON', 'COMPANY', 'COUNTRY', 'LOCATION', 'EVENT', 'ORGANISATION') GROUP BY entity_type
UNION ALL SELECT 'source_type', source_type, count(*) FROM g_sources WHERE source_type IN ('NEWS_ARTICLE', 'PARLIAMENT', 'GOVERNMENT') GROUP BY source_type""")
def ontology_check(b: Bridge) -> DataFrame:
    from .. import ontology as o

    claims, guards = b("g_claims"), {"predicate": o.PREDICATES, "connection_class": o.CONNECTION_CLASSES, "status": o.STATUSES}
    told = claims.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value"), F.col(k).isin(*known).alias("known")) for k, known in guards.items()])).alias("g")).select("g.*")
    for name, column, known in (("g_entities", "entity_type", o.ENTITY_TYPES), ("g_sources", "source_type", o.SOURCE_TYPES)):
        told = told.union(b(name).select(F.lit(column), F.col(column), F.col(column).isin(*known)))
    return told.where("known").groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


@query("filter_validate", f"""WITH t AS (SELECT id, trim(entity_type) AS et, trim(predicate) AS p, trim(connection_class) AS cc, nullif(trim(organization), '') AS oz, nullif(trim(organisation), '') AS os, trim(date_from) AS f, trim(date_to) AS d, trim(include_historical) AS h, nullif(trim(entity_id), '') AS eid, nullif(trim(topic), '') AS topic FROM g_requests),
v AS (SELECT *, CASE WHEN regexp_full_match(f, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND TRY_CAST(f AS DATE) IS NOT NULL THEN f END AS fs, CASE WHEN regexp_full_match(d, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND TRY_CAST(d AS DATE) IS NOT NULL THEN d END AS ds FROM t),
e AS (SELECT *, list_filter([CASE WHEN et = 'HUMAN' THEN 'entity_type must be one of: {', '.join(ENTITY_TYPES)}.' END, CASE WHEN p = 'owns' THEN 'predicate must be one of: {', '.join(PREDICATES)}.' END, CASE WHEN cc = 'SECRET' THEN 'connection_class must be one of: DIRECT, INDIRECT, OFFICIAL, HISTORICAL.' END,
  CASE WHEN f IS NOT NULL AND fs IS NULL THEN 'date_from must use YYYY-MM-DD format.' END, CASE WHEN d IS NOT NULL AND ds IS NULL THEN 'date_to must use YYYY-MM-DD format.' END, CASE WHEN fs > ds THEN 'date_from must be before or equal to date_to.' END, CASE WHEN h = 'yes' THEN 'include_historical must be true or false.' END], lambda x: x IS NOT NULL) AS errors FROM v)
SELECT id, CASE WHEN len(errors) > 0 THEN 400 ELSE 200 END AS status, array_to_string(errors, ' ') AS errors, CASE WHEN len(errors) = 0 THEN coalesce(eid, '-') || '/' || coalesce(topic, '-') || '/' || coalesce(oz, os, '-') || '/' || coalesce(fs, '-') || '/' || coalesce(CASE WHEN h IN ('true', '1') THEN 'true' WHEN h IN ('false', '0') THEN 'false' END, '-') END AS filters FROM e""")
def filter_validate(b: Bridge) -> DataFrame:
    parsed = api.bad_request(api.parse_filters(b("g_requests")))
    shown = F.concat_ws("/", *[F.coalesce(F.col(f"filters.{c}").cast("string"), F.lit("-")) for c in ("entity_id", "topic", "organisation", "date_from", "include_historical")])
    return parsed.select("id", "status", F.array_join("errors", " ").alias("errors"), F.when(F.col("filters").isNotNull(), shown).alias("filters"))


@query("record_rows", """SELECT CASE WHEN doc_id % 6 = 0 THEN NULL ELSE 'd' || doc_id END AS id, CASE WHEN doc_id % 4 <> 0 THEN 't' || doc_id END AS title, CASE WHEN doc_id % 7 < 3 THEN 200 + doc_id % 7 END AS http_status, CASE WHEN doc_id % 3 = 0 THEN '{"a":1}' ELSE '{}' END AS metadata,
 CASE WHEN doc_id % 6 = 0 THEN 'Expected id to be a non-empty string.' WHEN doc_id % 5 = 0 THEN 'Expected retrieved_at to be a valid date.' END AS error FROM documents""")
def record_rows(b: Bridge) -> DataFrame:
    from ..sources.tables import records

    i = F.col("doc_id")
    raw = b("documents").select(
        F.when(i % 6 == 0, "  ").otherwise(F.concat(F.lit("d"), i.cast("string"))).alias("id"), F.col("source").alias("source_id"), F.lit("http://x").alias("original_url"), F.when(i % 4 == 0, " ").otherwise(F.concat(F.lit("t"), i.cast("string"))).alias("title"),
        F.when(i % 7 < 3, (200 + i % 7).cast("string")).otherwise("many").alias("http_status"), F.when(i % 3 == 0, '{"a":1}').when(i % 3 == 1, "[1]").alias("metadata"), F.when(i % 5 == 0, "never").otherwise("2024-01-02").alias("retrieved_at"),
        F.lit("PUBLIC").alias("access_status"), F.lit("PENDING").alias("extraction_status"), F.lit("2024-01-02").alias("created_at"), F.lit("2024-01-02").alias("updated_at"))
    return records(raw, "documents", strict=False).select("id", "title", F.col("http_status").cast("long").alias("http_status"), "metadata", "error")


@query("due_jobs", f"SELECT id, attempts FROM (SELECT * FROM g_jobs WHERE job_kind = 'FETCH_URL' AND status = 'PENDING' AND scheduled_at <= TIMESTAMP '{AS_OF}' ORDER BY scheduled_at, id LIMIT 5) WHERE attempts < max_attempts")
def due_jobs(b: Bridge) -> DataFrame:
    return jobs.due_jobs(b("g_jobs"), "FETCH_URL", AS_OF).select("id", "attempts")


@query("runs_recent", "SELECT j.id, coalesce(u.canonical_name, 'c:' || CAST(j.user_id AS STRING)) AS name FROM (SELECT * FROM g_jobs ORDER BY scheduled_at DESC, id LIMIT 50) j LEFT JOIN g_entities u ON u.id = 'c:' || CAST(j.user_id AS STRING)")
def runs_recent(b: Bridge) -> DataFrame:
    last = b("g_jobs").orderBy(F.desc("scheduled_at"), "id").limit(50).withColumn("who", F.concat(F.lit("c:"), F.col("user_id").cast("string")))
    return last.join(b("g_entities").select(F.col("id").alias("who"), "canonical_name"), "who", "left").select("id", F.coalesce("canonical_name", "who").alias("name"))


@query("retry_backoff", "SELECT id, a AS attempts, least(60, power(2, greatest(0, a - 1)))::BIGINT AS minutes FROM (SELECT id, attempts + id % 9 AS a FROM g_jobs)")
def retry_backoff(b: Bridge) -> DataFrame:
    return b("g_jobs").select("id", (F.col("attempts") + F.col("id") % 9).alias("attempts")).select("id", "attempts", jobs.backoff_minutes(F.col("attempts")).alias("minutes"))


_AT = "TIMESTAMP '2024-01-31 00:00:00'"


@query("job_transition", f"""WITH e AS (SELECT *, CASE id % 4 WHEN 0 THEN 'start' WHEN 1 THEN 'complete' WHEN 2 THEN 'fail' WHEN 3 THEN 'skip' END AS ev FROM g_jobs),
r AS (SELECT *, CASE WHEN ev = 'start' THEN CASE WHEN status <> 'PENDING' THEN 'Only pending ingestion jobs can be started.' WHEN attempts >= max_attempts THEN 'Ingestion job has no retry attempts remaining.' END WHEN ev IN ('complete', 'skip') AND status <> 'RUNNING' THEN 'Only running ingestion jobs can be completed.' WHEN ev = 'fail' AND status <> 'RUNNING' THEN 'Only running ingestion jobs can fail.' END AS error FROM e)
SELECT id, error, CASE WHEN error IS NOT NULL THEN status WHEN ev = 'start' THEN 'RUNNING' WHEN ev = 'complete' THEN 'SUCCEEDED' WHEN ev = 'skip' THEN 'SKIPPED' WHEN attempts < max_attempts THEN 'PENDING' ELSE 'FAILED' END AS status,
  attempts + CASE WHEN error IS NULL AND ev = 'start' THEN 1 ELSE 0 END AS attempts, strftime(CASE WHEN error IS NULL AND ev = 'fail' AND attempts < max_attempts THEN {_AT} + to_minutes(least(60, power(2, greatest(0, attempts - 1)))::BIGINT) ELSE scheduled_at END, '%Y-%m-%d %H:%M:%S') AS scheduled_at,
  error IS NULL AND (ev IN ('complete', 'skip') OR (ev = 'fail' AND attempts >= max_attempts)) AS finished FROM r""")
def job_transition(b: Bridge) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("start", "complete", "fail", "skip")])
    events = b("g_jobs").select("id", F.element_at(kinds, (F.col("id") % 4 + 1).cast("int")).alias("event"), F.lit("e").alias("error_message"))
    return jobs.transition(b("g_jobs"), events, "2024-01-31 00:00:00").select("id", "error", "status", "attempts", F.date_format("scheduled_at", "yyyy-MM-dd HH:mm:ss").alias("scheduled_at"), F.col("finished_at").isNotNull().alias("finished"))


@query("job_reuse", "WITH w AS (SELECT DISTINCT user_id FROM events), f AS (SELECT user_id, min(id) AS id FROM g_jobs WHERE status IN ('PENDING', 'RUNNING') AND job_kind = 'FETCH_URL' GROUP BY user_id) SELECT w.user_id, 'FETCH_URL' AS job_kind, coalesce(CAST(f.id AS VARCHAR), 'FETCH_URL:' || w.user_id) AS job_id, f.id IS NOT NULL AS reused FROM w LEFT JOIN f ON f.user_id = w.user_id")
def job_reuse(b: Bridge) -> DataFrame:
    wanted = b("events").select("user_id", F.lit("FETCH_URL").alias("job_kind"))
    return jobs.create_or_reuse(wanted, b("g_jobs"), "user_id", active_only=True)


#: Jobs in order of their time; a job's response has the text of one of three documents of its user at one of seven pages of its candidate's site.
_FETCHED = f"""j AS (SELECT id, scheduled_at, CASE WHEN id % 17 = 0 THEN NULL ELSE user_id + CASE WHEN id % 19 = 0 THEN 1000000 ELSE 0 END END AS cand, attempts, max_attempts FROM g_jobs WHERE status = 'RUNNING'),
c AS (SELECT DISTINCT user_id AS cand FROM events), r AS (SELECT id, 'u' || (id % 7) || '-' || (user_id % 97) AS url, sha256(text) AS hash, CASE WHEN id % 10 = 3 THEN 'timed out' END AS err FROM g_jobs LEFT JOIN documents ON doc_id = CASE WHEN g_jobs.id % 11 <> 4 THEN (user_id * 7 + g_jobs.id % 3) % (SELECT count(*) FROM documents) END),
s AS (SELECT DISTINCT 'u' || (doc_id % 7) || '-' || (doc_id % 97) AS url, CASE WHEN doc_id % 3 = 0 THEN sha256(text) ELSE 'old' END AS hash FROM documents),
o AS (SELECT j.*, CASE WHEN j.cand IS NULL THEN 'FETCH_URL jobs require a URL candidate.' WHEN c.cand IS NULL THEN 'FETCH_URL job references an unknown URL candidate.' WHEN err IS NOT NULL THEN err WHEN r.hash IS NULL THEN 'Unknown ingestion error.' END AS error_message, r.url, r.hash FROM j LEFT JOIN c USING (cand) LEFT JOIN r ON r.id = j.id)"""


@query("fetch_outcome", f"""WITH {_FETCHED}, ok AS (SELECT * FROM o WHERE error_message IS NULL),
fresh AS (SELECT DISTINCT ON (url, hash) url, hash, scheduled_at, id FROM ok WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.url = ok.url AND s.hash = ok.hash) ORDER BY url, hash, scheduled_at, id),
v AS (SELECT f.id, (SELECT count(*) FROM s WHERE s.url = f.url) + (SELECT count(*) FROM fresh e WHERE e.url = f.url AND (e.scheduled_at, e.id) <= (f.scheduled_at, f.id)) AS version FROM fresh f),
k AS (SELECT o.*, version, CASE WHEN error_message IS NOT NULL THEN 'FAILED' WHEN version IS NULL THEN 'UNCHANGED' WHEN version > 1 THEN 'CREATED_NEW_VERSION' ELSE 'CREATED' END AS outcome FROM o LEFT JOIN v ON v.id = o.id)
SELECT id, outcome, version, error_message, CASE outcome WHEN 'FAILED' THEN CASE WHEN attempts < max_attempts THEN 'PENDING' ELSE 'FAILED' END WHEN 'UNCHANGED' THEN 'SKIPPED' ELSE 'SUCCEEDED' END AS job_status, CASE outcome WHEN 'FAILED' THEN CASE WHEN attempts < max_attempts THEN 'PENDING' ELSE 'FAILED' END WHEN 'UNCHANGED' THEN 'SKIPPED' ELSE 'FETCHED' END AS candidate_status,
  CASE WHEN outcome IN ('CREATED', 'CREATED_NEW_VERSION') THEN 'EXTRACT_DOCUMENT,ANALYZE_DOCUMENT' ELSE '' END AS follow_up_jobs FROM k""")
def fetch_outcome(b: Bridge) -> DataFrame:
    i, d, docs = F.col("id"), F.col("doc_id"), b("documents")
    page = lambda a, z: F.concat(F.lit("u"), (a % 7).cast("string"), F.lit("-"), (z % 97).cast("string"))
    running = b("g_jobs").where("status = 'RUNNING'")
    started = running.select("id", F.when(i % 17 != 0, F.col("user_id") + F.when(i % 19 == 0, 1000000).otherwise(0)).alias("url_candidate_id"), "attempts", "max_attempts", "scheduled_at")
    candidates = b("events").select(F.col("user_id").alias("id")).distinct().select("id", (F.col("id") % 5).alias("crawl_run_id"))
    texts = docs.select(d.alias("doc"), urls.content_hash(F.col("text")).alias("content_hash"))
    n_docs = F.broadcast(docs.agg(F.count(F.lit(1)).alias("n_docs")))  # one row
    asked = running.join(n_docs).withColumn("doc", F.when(i % 11 != 4, (F.col("user_id") * 7 + i % 3) % F.col("n_docs")))
    responses = asked.join(texts, "doc", "left").select("id", page(i, F.col("user_id")).alias("canonical_url"), "content_hash", F.when(i % 10 == 3, "timed out").alias("error"))
    stored = docs.select(page(d, d).alias("canonical_url"), F.when(d % 3 == 0, urls.content_hash(F.col("text"))).otherwise("old").alias("content_hash")).distinct()
    told = jobs.fetch_outcomes(started, candidates, responses, stored, "2024-01-31 00:00:00")
    return told.select("id", "outcome", "version", "error_message", "job_status", "candidate_status", F.array_join("follow_up_jobs", ",").alias("follow_up_jobs"))


@query("write_extraction", """SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 4 = 0 THEN 'new' END ELSE 'old' END AS title, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 4 = 0 THEN 'a=2,extractedDescription=about,z=9' ELSE 'a=2,z=9' END ELSE 'a=1,z=9' END AS metadata FROM documents""")
def write_extraction(b: Bridge) -> DataFrame:
    i = F.col("doc_id")
    there = b("documents").select(i.alias("id"), F.lit("old").alias("title"), "text", F.create_map(F.lit("a"), F.lit("1"), F.lit("z"), F.lit("9")).alias("metadata"))
    drafts = b("documents").where(i % 2 == 0).select(i.alias("id"), F.when(i % 4 == 0, "new").alias("title"), F.lit("t").alias("text"), F.when(i % 4 == 0, "about").alias("description"), F.create_map(F.lit("a"), F.lit("2")).alias("metadata"))
    told = jobs.write_extraction(there, drafts)
    return told.select("id", "title", F.array_join(F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("metadata"))


def model_provider(given: dict) -> dict:
    """A stand-in for a provider: entities for odd items, an answer that breaks the contract for every fifth, an error for every seventh."""
    number = int(given["document"]["id"][1:])
    if number % 7 == 0:
        raise RuntimeError("no answer")
    found = {"local_id": "m1", "type": "PERSON", "name": "A", "evidence": given["document"]["extractedText"][:5] or "x"}
    return {"entities": [found] * (number % 3)} if number % 5 else {"entities": [found | {"type": "HUMAN", "age": 3}]}


@query("llm_run_summary", f"""WITH t AS (SELECT item_id AS k, regexp_replace(text, '[^A-Za-z ]', '', 'g') AS x FROM benchmark)
SELECT 'r' || k AS request_id, CASE WHEN k % 7 = 0 OR k % 5 = 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status, sha256('{{"document":{{"id":"b' || k || '","extractedText":"' || x || '"}}}}') AS input_hash, '{{"documentId": "b' || k || '", "textLength": ' || length(x) || '}}' AS input_summary,
  CASE WHEN k % 7 <> 0 AND k % 5 <> 0 THEN '{{"entityCount": ' || (k % 3) || '}}' END AS output_summary, CASE WHEN k % 7 = 0 THEN 'no answer' WHEN k % 5 = 0 THEN 'entities.0.type: expected one of {', '.join(ENTITY_TYPES)}; entities.0: unknown key age' END AS error_message, 'entity-extraction.v1' AS schema_version FROM t""")
def llm_run_summary(b: Bridge) -> DataFrame:
    document = F.struct(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), F.regexp_replace("text", "[^A-Za-z ]", "").alias("extractedText"))
    asked = b("benchmark").select(F.concat(F.lit("r"), F.col("item_id").cast("string")).alias("request_id"), F.to_json(F.struct(document.alias("document"))).alias("input"))
    told = contracts.run(asked, "extractEntities", model_provider, "none", "none", "p1")
    return told.select("request_id", "status", "input_hash", "input_summary", "output_summary", "error_message", "schema_version")


@query("next_run", """SELECT event_id, strftime(CASE event_id % 4 WHEN 0 THEN ts + INTERVAL 1 HOUR WHEN 1 THEN ts + INTERVAL 1 DAY WHEN 2 THEN ts + INTERVAL 7 DAY
  ELSE date_trunc('month', ts) + INTERVAL 1 MONTH + to_days((day(ts) - 1)::INT) + (ts - date_trunc('day', ts)) END, '%Y-%m-%d %H:%M:%S') AS next_at FROM events""")
def next_run(b: Bridge) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in ("HOURLY", "DAILY", "WEEKLY", "MONTHLY")]), (F.col("event_id") % 4 + 1).cast("int"))
    return b("events").select("event_id", F.date_format(jobs.next_run(F.col("ts"), kind), "yyyy-MM-dd HH:mm:ss").alias("next_at"))


_DUE = "2024-01-30 12:00:00"


@query("due_schedules", f"""SELECT user_id, strftime(next_run_at, '%Y-%m-%d %H:%M:%S') AS next_run_at, CASE user_id % 4 WHEN 0 THEN '2024-01-30 13:00:00' WHEN 1 THEN '2024-01-31 12:00:00' WHEN 2 THEN '2024-02-06 12:00:00' ELSE '2024-03-01 12:00:00' END AS following_run_at
FROM (SELECT user_id, max(ts) AS next_run_at FROM events GROUP BY user_id) WHERE user_id % 5 <> 0 AND next_run_at <= TIMESTAMP '{_DUE}'""")
def due_schedules(b: Bridge) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("HOURLY", "DAILY", "WEEKLY", "MONTHLY")])
    schedules = b("events").groupBy("user_id").agg(F.max("ts").alias("next_run_at")).select("*", F.when(F.col("user_id") % 5 == 0, "PAUSED").otherwise("ACTIVE").alias("status"), F.element_at(kinds, (F.col("user_id") % 4 + 1).cast("int")).alias("frequency"))
    due = jobs.due_schedules(schedules, _DUE)
    return due.select("user_id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("next_run_at", "following_run_at")])


@query("crawl_run_stats", """WITH o AS (SELECT user_id, count(*) FILTER (event_type <> 'error') AS fetched, count(*) FILTER (event_type IN ('click', 'view')) AS changed, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY user_id)
SELECT user_id AS run_id, fetched, changed, failed, CASE WHEN user_id % 9 = 0 THEN 'FAILED' WHEN failed > 0 THEN 'PARTIAL' ELSE 'RUNNING' END AS status FROM o""")
def crawl_run_stats(b: Bridge) -> DataFrame:
    kind = F.col("event_type")
    runs = b("events").select(F.col("user_id").alias("run_id")).distinct().withColumn("status", F.when(F.col("run_id") % 9 == 0, "FAILED").otherwise("RUNNING"))
    outcomes = b("events").select(F.col("user_id").alias("run_id"), F.when(kind == "error", "FAILED").when(kind == "click", "CREATED").when(kind == "view", "CREATED_NEW_VERSION").otherwise("UNCHANGED").alias("outcome"))
    return jobs.crawl_run_stats(runs, outcomes)


@query("doc_versions", """WITH f AS (SELECT doc_id AS id, 'u' || CAST(doc_id % 97 AS VARCHAR) AS url, sha256(text) AS hash FROM documents),
m AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY url, hash ORDER BY id) = 1 THEN 1 ELSE 0 END AS fresh FROM f), v AS (SELECT *, sum(fresh) OVER (PARTITION BY url ORDER BY id) AS version FROM m)
SELECT id, url, hash, CASE WHEN fresh = 0 THEN 'UNCHANGED' WHEN version = 1 THEN 'CREATED' ELSE 'CREATED_NEW_VERSION' END AS outcome, version::BIGINT AS version FROM v""")
def doc_versions(b: Bridge) -> DataFrame:
    fetched = b("documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("u"), (F.col("doc_id") % 97).cast("string")).alias("url"), urls.content_hash(F.col("text")).alias("hash"), F.col("doc_id").alias("at"))
    return jobs.document_versions(fetched)


@query("latest_version", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def latest_version(b: Bridge) -> DataFrame:
    return jobs.latest(b("events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")


@query("host_schedule", """WITH RECURSIVE o AS (SELECT user_id AS host, event_id AS id, epoch_us(ts) // 1000 AS at_ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events),
s(host, id, at_ms, i, start_ms) AS (SELECT host, id, at_ms, i, at_ms FROM o WHERE i = 1 UNION ALL SELECT o.host, o.id, o.at_ms, o.i, greatest(o.at_ms, s.start_ms + 6000) FROM s JOIN o ON o.host = s.host AND o.i = s.i + 1)
SELECT host, id, at_ms, start_ms FROM s""")
def host_schedule(b: Bridge) -> DataFrame:
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    return jobs.host_slots(b("events").select(F.col("user_id").alias("host"), F.col("event_id").alias("id"), millis.alias("at_ms")))
