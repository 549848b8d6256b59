"""Constraints as violation reports, referential cascade, and role-dependent views."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ontology import ACCESS_STATUSES, CONNECTION_CLASSES, ENTITY_TYPES, EXTRACTION_STATUSES, ROLES, SOURCE_QUALITIES, SOURCE_TYPES, STATUSES


def violations(df: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """(rule, id) of each row that breaks a rule; a rule is a condition that has to hold, null counting as holding."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(rule), F.lit(True)), F.lit(name)) for name, rule in rules.items()]))
    return df.select(F.explode(broken).alias("rule"), F.col(key).cast("string").alias("id"))


_LANGUAGE = "language RLIKE '^[a-z]{2}(-[A-Z]{2})?$'"
_HASH = "{} RLIKE '^[a-f0-9]{{64}}$'"
#: Conditions in SQL by table, so that they can be stated without a session; a null counts as holding.
RULES = {
    "sources": {
        "name_not_blank": "length(trim(name)) > 0", "requests_not_negative": "requests_per_minute >= 0", "concurrency_bounded": "concurrency BETWEEN 1 AND 10",
        "type_known": f"source_type IN ({', '.join(map(repr, SOURCE_TYPES))})", "quality_known": f"source_quality IN ({', '.join(map(repr, SOURCE_QUALITIES))})",
    },
    "entities": {
        "name_not_blank": "length(trim(canonical_name)) > 0", "slug_form": "slug = lower(slug) AND slug RLIKE '^[a-z0-9]+(-[a-z0-9]+)*$'", "country_form": "country_code RLIKE '^[A-Z]{2}$'",
        "type_known": f"entity_type IN ({', '.join(map(repr, ENTITY_TYPES))})",
    },
    "entity_aliases": {"alias_not_blank": "length(trim(alias)) > 0", "language_form": _LANGUAGE, "dates_ordered": "valid_from <= valid_to"},
    "documents": {
        "original_url_not_blank": "length(trim(original_url)) > 0", "canonical_url_not_blank": "length(trim(canonical_url)) > 0", "language_form": _LANGUAGE, "hash_form": _HASH.format("content_hash"),
        "http_status_bounded": "http_status BETWEEN 100 AND 599", "access_known": f"access_status IN ({', '.join(map(repr, ACCESS_STATUSES))})", "extraction_known": f"extraction_status IN ({', '.join(map(repr, EXTRACTION_STATUSES))})",
    },
    "claims": {
        "status_known": f"status IN ({', '.join(map(repr, STATUSES))})", "class_known": f"connection_class IN ({', '.join(map(repr, CONNECTION_CLASSES))})", "confidence_bounded": "confidence_score BETWEEN 0 AND 1",
        "object_or_literal": "object_id IS NOT NULL OR literal_value IS NOT NULL", "no_self_relation": "object_id <> subject_id", "dates_ordered": "valid_from <= valid_to", "review_dated": "reviewed_by IS NULL OR reviewed_at IS NOT NULL",
    },
    "claim_evidence": {"text_not_blank": "length(trim(evidence_text)) > 0", "start_not_negative": "start_char >= 0", "end_not_negative": "end_char >= 0", "page_positive": "page_number > 0", "hash_form": _HASH.format("evidence_hash"), "span_ordered": "start_char <= end_char"},
    "audit_log": {"action_not_blank": "length(trim(action)) > 0", "type_not_blank": "length(trim(entity_type)) > 0"},
    "llm_runs": {"model_not_blank": "length(trim(model)) > 0", "prompt_not_blank": "length(trim(prompt_version)) > 0", "schema_not_blank": "length(trim(schema_version)) > 0", "temperature_bounded": "temperature BETWEEN 0 AND 2"},
    "crawl_runs": {f"{c}_not_negative": f"{c} >= 0" for c in ("urls_discovered", "documents_fetched", "documents_changed", "documents_failed")} | {"times_ordered": "finished_at >= started_at"},
    "ingestion_jobs": {
        "attempts_not_negative": "attempts >= 0", "max_attempts_positive": "max_attempts > 0", "attempts_bounded": "attempts <= max_attempts", "ended_dated": "status NOT IN ('SUCCEEDED', 'FAILED', 'SKIPPED') OR finished_at IS NOT NULL",
        "target_given": "CASE job_kind WHEN 'FETCH_URL' THEN url_candidate_id IS NOT NULL WHEN 'DISCOVER_URLS' THEN true ELSE document_id IS NOT NULL END",
    },
}

#: Unique indexes: table, key expressions, and the condition of a partial one.
UNIQUE = (
    ("sources", ("domain",), "domain IS NOT NULL"),
    ("entities", ("slug",), "true"),
    ("entity_aliases", ("entity_id", "lower(alias)", "coalesce(language, '')"), "true"),
    ("documents", ("canonical_url", "content_hash"), "canonical_url IS NOT NULL AND content_hash IS NOT NULL"),
    ("claim_evidence", ("claim_id", "document_id", "evidence_hash"), "true"),
    ("url_candidates", ("source_id", "canonical_url"), "true"),
    ("ingestion_jobs", ("url_candidate_id", "job_kind"), "url_candidate_id IS NOT NULL AND status IN ('PENDING', 'RUNNING')"),
    ("ingestion_jobs", ("document_id", "job_kind"), "document_id IS NOT NULL AND job_kind IN ('EXTRACT_DOCUMENT', 'ANALYZE_DOCUMENT')"),
)


def _columns(rule: str) -> set[str]:
    return set(re.findall(r"[a-z_]+", re.sub(r"'[^']*'", "", rule))) - _SQL_WORDS


def check(df: DataFrame, table: str, key: str = "id") -> DataFrame:
    """(rule, id) of the rows of ``df`` that break a rule of ``table``; columns that ``df`` lacks are null, and ``unchecked`` tells the rules that ask for nothing else."""
    columns = {f.lower() for f in df.columns}
    missing = {c for rule in RULES[table].values() for c in _columns(rule) - columns}
    whole = df.withColumns({c: F.lit(None).cast("string") for c in missing}) if missing else df
    return violations(whole, key, {n: r for n, r in RULES[table].items() if _columns(r) & columns})


def unchecked(df: DataFrame, table: str) -> list[str]:
    """The rules of ``table`` that say nothing of ``df``, since it has none of their columns."""
    columns = {f.lower() for f in df.columns}
    return [n for n, r in RULES[table].items() if not _columns(r) & columns]


def report(df: DataFrame, table: str, key: str = "id") -> DataFrame:
    """(tbl, rule, state, n) of every rule of ``table``: how many rows break it, or that it was not checked."""
    silent = unchecked(df, table)
    told = df.sparkSession.createDataFrame([(table, n, "unchecked" if n in silent else "checked") for n in RULES[table]], "tbl string, rule string, state string")
    broken = check(df, table, key).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    return told.join(broken, "rule", "left").select("tbl", "rule", "state", F.when(F.col("state") == "checked", F.coalesce("n", F.lit(0).cast("long"))).alias("n"))


_SQL_WORDS = {"length", "trim", "lower"}


def unique_violations(df: DataFrame, table: str, number: int = 0) -> DataFrame:
    """(key, n) of the key values that break the ``number``-th unique index of ``table``; rows outside a partial index do not count."""
    _, keys, condition = [u for u in UNIQUE if u[0] == table][number]
    return duplicates(df.where(condition), *[F.expr(k) for k in keys])


def duplicates(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Key values that occur more than once, as one string, with their number."""
    text = F.concat_ws("|", *[F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys])
    return df.select(text.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def without_evidence(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Verified claims that lack evidence."""
    return claims.where(F.col("status") == "VERIFIED").join(evidence.select(F.col("claim_id").alias("id")), "id", "left_anti").select("id")


def cascade(entities: DataFrame, aliases: DataFrame, sources: DataFrame, documents: DataFrame, claims: DataFrame, evidence: DataFrame) -> dict[str, DataFrame]:
    """Rows whose references resolve: semi joins from parents to children."""
    entity = entities.select(F.col("id").alias("entity_id"))
    docs = documents.join(sources.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    sound = claims.join(entity, claims.subject_id == entity.entity_id, "left_semi")
    with_object = sound.where("object_id is not null").join(entity, F.col("object_id") == F.col("entity_id"), "left_semi").unionByName(sound.where("object_id is null"))
    kept = evidence.join(with_object.select(F.col("id").alias("claim_id")), "claim_id", "left_semi").join(docs.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    return {"aliases": aliases.join(entity, "entity_id", "left_semi"), "documents": docs, "claims": with_object, "evidence": kept}


def public_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Row-level rule: verified claims with evidence.  Literal-only ones count."""
    return claims.where(F.col("status") == "VERIFIED").join(evidence.select(F.col("claim_id").alias("id")), "id", "left_semi")


def public_entities(entities: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    shown = public_claims(claims, evidence)
    ends = shown.select(F.explode(F.array("subject_id", "object_id")).alias("id")).where("id is not null")
    return entities.join(ends, "id", "left_semi")


def role(app_role: Column, user_role: Column) -> Column:
    """The application's role before the user's; unknown ones are no roles; else PUBLIC."""
    known = lambda c: F.when(F.upper(F.trim(c)).isin(*ROLES), F.upper(F.trim(c)))
    return F.coalesce(known(app_role), known(user_role), F.lit("PUBLIC"))


#: Tables that internal roles read, and those that the anonymous role may select from at all.
TABLES = ("sources", "entities", "entity_aliases", "documents", "claims", "claim_evidence", "review_queue", "audit_log", "llm_runs", "crawl_runs", "entity_resolution_tasks", "entity_resolution_candidates", "url_candidates", "crawl_schedules", "ingestion_jobs")
ANONYMOUS = ("entities", "claims", "claim_evidence")
INTERNAL = ("ADMIN", "RESEARCHER", "REVIEWER")
_ALL = ("insert", "update", "delete")
#: Tables, roles and actions of the write policies.
WRITES = (
    (TABLES, ("ADMIN",), _ALL),
    (("entities", "entity_aliases", "sources", "documents", "claims"), ("RESEARCHER",), ("insert",)),
    (("claim_evidence",), ("RESEARCHER", "REVIEWER"), ("insert",)),
    (("claims",), ("REVIEWER",), ("update",)),
    (("review_queue",), ("REVIEWER",), _ALL),
    (("audit_log",), ("RESEARCHER", "REVIEWER"), ("insert",)),
    (("entity_resolution_tasks", "entity_resolution_candidates"), ("RESEARCHER",), ("insert",)),
    (("entity_resolution_tasks",), ("REVIEWER",), ("update",)),
    (("url_candidates",), ("RESEARCHER",), ("insert", "update")),
    (("crawl_schedules", "ingestion_jobs"), ("RESEARCHER",), _ALL),
)


def permissions() -> list[tuple[str, str, str]]:
    """(role, table, action): what the policies allow.  PUBLIC selects only rows of public claims; see ``public_claims``."""
    reads = [(r, t, "select") for r in INTERNAL for t in TABLES] + [("PUBLIC", t, "select") for t in ANONYMOUS]
    return sorted({*reads, *((r, t, a) for tables, roles, actions in WRITES for t in tables for r in roles for a in actions)})


def grants() -> list[tuple[str, str, str]]:
    """(api role, table, privilege), which come before any policy."""
    return sorted([("anon", t, "select") for t in ANONYMOUS] + [("authenticated", t, a) for t in TABLES for a in ("select", *_ALL)])


def decided(requests: DataFrame, allowed: list[tuple[str, str, str]]) -> DataFrame:
    """``requests`` (role, tbl, action) with allowed: whether ``permissions`` or ``grants`` have them; unknown or null ones are not."""
    rules = requests.sparkSession.createDataFrame(allowed, "role string, tbl string, action string").withColumn("allowed", F.lit(True))  # some hundred rows, fixed
    return requests.join(F.broadcast(rules), ["role", "tbl", "action"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def claim_writes(writes: DataFrame) -> DataFrame:
    """(id, allowed) of writes to claims (id, role, action, status): researchers only propose, reviewers only update, admins do all."""
    proposed = (F.col("action") == "insert") & (F.col("role") == "RESEARCHER") & F.col("status").isin("DETECTED", "PENDING_REVIEW")
    reviewed = (F.col("action") == "update") & (F.col("role") == "REVIEWER")
    return writes.select("id", F.coalesce((F.col("role") == "ADMIN") | proposed | reviewed, F.lit(False)).alias("allowed"))


def visible_evidence(role_name: str, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence that a role reads: internal roles all, others that of public claims."""
    if role_name in INTERNAL:
        return evidence
    return evidence.join(public_claims(claims, evidence).select(F.col("id").alias("claim_id")), "claim_id", "left_semi")


def touched(before: DataFrame, after: DataFrame, key: str, at: Column) -> DataFrame:
    """``after`` with updated_at set to ``at`` where a row was there before, as a trigger on updates does."""
    old = before.select(key, F.lit(True).alias("__old"))
    return after.drop("updated_at").join(old, key, "left").withColumn("updated_at", F.when(F.col("__old"), at)).drop("__old")
