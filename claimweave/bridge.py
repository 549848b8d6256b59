"""The domain tables, derived from the driver's tables by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .written import dealt, kept

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark")

_PREDICATE = "CASE l.l_orderkey % 8 WHEN 0 THEN 'BOARD_MEMBER_OF' WHEN 1 THEN 'EMPLOYED_BY' WHEN 2 THEN 'OWNS' WHEN 3 THEN 'SHAREHOLDER_OF' WHEN 4 THEN 'HAS_MANDATE_AT' WHEN 5 THEN 'MEMBER_OF' WHEN 6 THEN 'ADVISOR_TO' ELSE 'SPOKE_AT' END"
_LINES = """SELECT l.l_orderkey, l.l_linenumber, min(l.l_suppkey) AS suppkey, min(l.l_partkey) AS partkey, min(l.l_quantity) AS quantity, min(l.l_linestatus) AS linestatus,
    min(CAST(l.l_shipdate AS DATE)) AS ship, min(o.o_custkey) AS custkey, min(CAST(o.o_orderdate AS DATE)) AS ordered, min(o.o_orderpriority) AS priority, min(o.o_orderstatus) AS orderstatus
  FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey GROUP BY l.l_orderkey, l.l_linenumber"""

# JSON texts; braces are written as characters, since those of a template name tables.
_NOTES = """chr(123) || '"reasons": ["' || coalesce(topic, 'none') || '", 7], "deep": ' || chr(123) || '"list": [' || chr(123) || '"leaf": "' || connection_class || '"' || chr(125) || ']' || chr(125) || ', "official": 1' || chr(125)"""
_METADATA = """chr(123) || '"party": "P' || right(slug, 1) || '", "office": "O' || right(slug, 2) || '", "validFrom": "201' || right(slug, 1) || '", "relatedEntityIds": ["s:' || right(slug, 1) || '"], "home": [' || chr(123) || '"canton": "' || coalesce(canton, '') || '"' || chr(125) || '], "country": ' || coalesce(country, 'null') || chr(125)"""

TABLES: dict[str, str] = {
    "g_sources": """SELECT source AS id, upper(source) AS name, source || '.example.org' AS domain, substr('ABCDEX', CAST(k % 6 + 1 AS INT), 1) AS source_quality,
    CASE WHEN k % 13 < 4 THEN 'NEWS_ARTICLE' WHEN k % 13 < 8 THEN 'PARLIAMENT' ELSE 'GOVERNMENT' END AS source_type, k % 7 <> 0 AS enabled, CAST(k AS INT) AS k
  FROM (SELECT DISTINCT source, CAST(substr(source, 4) AS INT) AS k FROM {documents} WHERE source IS NOT NULL) s""",
    "g_documents": """SELECT 'd' || CAST(doc_id AS STRING) AS id, source AS source_id, 'https://' || source || '.example.org/doc/' || CAST(doc_id AS STRING) || '?utm_source=feed' AS original_url,
    CASE WHEN doc_id % 5 <> 0 THEN 'https://' || source || '.example.org/doc/' || CAST(doc_id AS STRING) END AS canonical_url, doc_id % 3 <> 0 AS is_published, doc_id AS number, text AS extracted_text, CASE WHEN doc_id % 4 <> 0 THEN upper(source) || ' Press' END AS publisher
  FROM {documents} WHERE doc_id IS NOT NULL""",
    "g_entities": f"""SELECT *, {_METADATA} AS metadata, CASE WHEN canton IS NOT NULL THEN 'Lives in ' || canton END AS description FROM (SELECT 'c:' || CAST(c_custkey AS STRING) AS id, 'PERSON' AS entity_type, c_name AS canonical_name, lower(replace(replace(c_name, '#', '-'), ' ', '-')) AS slug, c_mktsegment AS canton, CAST(c_nationkey AS STRING) AS country FROM {{customer}}
  UNION ALL SELECT 's:' || CAST(s_suppkey AS STRING), 'COMPANY', s_name, lower(replace(replace(s_name, '#', '-'), ' ', '-')), CAST(NULL AS STRING), CAST(s_nationkey AS STRING) FROM {{supplier}}
  UNION ALL SELECT 'n:' || CAST(n_nationkey AS STRING), 'COUNTRY', n_name, lower(replace(n_name, ' ', '-')), CAST(NULL AS STRING), CAST(NULL AS STRING) FROM {{nation}}
  UNION ALL SELECT 'r:' || CAST(r_regionkey AS STRING), 'LOCATION', r_name, lower(replace(r_name, ' ', '-')), CAST(NULL AS STRING), CAST(NULL AS STRING) FROM {{region}}
  UNION ALL SELECT 'e:' || event_type, 'EVENT', event_type, lower(event_type), CAST(NULL AS STRING), CAST(NULL AS STRING) FROM (SELECT DISTINCT event_type FROM {{events}}) e
  UNION ALL SELECT 'b:' || p_brand, 'ORGANISATION', p_brand, lower(replace(p_brand, '#', '-')), CAST(NULL AS STRING), CAST(NULL AS STRING) FROM (SELECT DISTINCT p_brand FROM {{part}}) b) e""",
    "g_aliases": """SELECT id || ':a' AS id, id AS entity_id, lower(canonical_name) AS alias, 'en' AS language FROM {g_entities} WHERE entity_type IN ('PERSON', 'COMPANY')
  UNION ALL SELECT id || ':b', id, 'The ' || canonical_name, 'de' FROM {g_entities} WHERE entity_type = 'COMPANY'""",
    "g_claims": f"""SELECT *, {_NOTES} AS notes FROM (SELECT CAST(l.l_orderkey AS STRING) || '-' || CAST(l.l_linenumber AS STRING) AS id, 'c:' || CAST(custkey AS STRING) AS subject_id, {_PREDICATE} AS predicate,
    CASE WHEN l.l_orderkey % 50 = 49 THEN CAST(NULL AS STRING) ELSE 's:' || CAST(suppkey AS STRING) END AS object_id,
    CASE substr(priority, 1, 1) WHEN '1' THEN 'OFFICIAL' WHEN '2' THEN 'INDIRECT' WHEN '3' THEN 'HISTORICAL' ELSE 'DIRECT' END AS connection_class,
    CASE linestatus WHEN 'F' THEN 'VERIFIED' ELSE CASE WHEN l.l_orderkey % 4 = 0 THEN 'DISPUTED' ELSE 'PENDING_REVIEW' END END AS status,
    CASE WHEN partkey % 5 <> 0 THEN least(ordered, ship) END AS valid_from, CASE WHEN partkey % 3 <> 0 THEN greatest(ordered, ship) END AS valid_to,
    CASE WHEN partkey % 10 = 0 THEN 'energy' WHEN partkey % 10 = 1 THEN 'Health' END AS topic, partkey, quantity, l.l_orderkey AS orderkey, l.l_linenumber AS line, ordered AS created_on
  FROM ({_LINES}) l
  UNION ALL SELECT 'n-' || CAST(c_custkey AS STRING), 'c:' || CAST(c_custkey AS STRING), 'HAS_BUSINESS_ACTIVITY_IN', 'n:' || CAST(c_nationkey AS STRING), 'DIRECT', 'VERIFIED', CAST(NULL AS DATE), CAST(NULL AS DATE), CAST(NULL AS STRING), c_custkey, 10, c_custkey, CAST(0 AS INT), DATE '1995-01-01' FROM {{customer}}
  UNION ALL SELECT 'p-' || CAST(user_id AS STRING) || '-' || event_type, 'c:' || CAST(user_id AS STRING), 'PARTICIPATED_IN', 'e:' || event_type, 'OFFICIAL', 'VERIFIED', day, CAST(NULL AS DATE), CAST(NULL AS STRING), user_id, 10, user_id, CAST(0 AS INT), day
    FROM (SELECT user_id, event_type, min(CAST(ts AS DATE)) AS day FROM {{events}} GROUP BY user_id, event_type) u) c""",
    "g_evidence": """SELECT c.id || ':1' AS id, c.id AS claim_id, 'd' || CAST(c.partkey % n.n AS STRING) AS document_id, CASE WHEN c.partkey % 11 = 0 THEN ' ' ELSE 'Part ' || CAST(c.partkey AS STRING) || ' of ' || lower(c.predicate) END AS evidence_text FROM {g_claims} c, (SELECT count(*) AS n FROM {documents}) n WHERE c.quantity >= 5
  UNION ALL SELECT c.id || ':2', c.id, 'd' || CAST((c.partkey + 1) % n.n AS STRING), 'Second part ' || CAST(c.partkey AS STRING) FROM {g_claims} c, (SELECT count(*) AS n FROM {documents}) n WHERE c.quantity >= 5 AND c.partkey % 4 = 0""",
    "g_queue": """SELECT id || ':q' AS id, id AS claim_id, CASE partkey % 4 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'ASSIGNED' WHEN 2 THEN 'RESOLVED' ELSE 'OPEN' END AS status, created_on FROM {g_claims} WHERE status <> 'VERIFIED' AND orderkey % 3 = 0""",
    "g_jobs": """SELECT event_id AS id, CASE WHEN event_type IN ('click', 'view') THEN 'FETCH_URL' ELSE 'EXTRACT_DOCUMENT' END AS job_kind, event_type, user_id, CAST(floor(abs(value)) AS BIGINT) % 4 AS attempts, 3 AS max_attempts,
    CASE CAST(floor(abs(value)) AS BIGINT) % 4 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'PENDING' WHEN 2 THEN 'RUNNING' ELSE 'FAILED' END AS status, ts AS scheduled_at, CASE WHEN event_id % 3 = 0 THEN 'timeout' WHEN event_id % 3 = 1 THEN ' ' END AS error_message FROM {events}""",
    "g_tasks": """SELECT 't' || CAST(number AS STRING) AS id, id AS document_id, CASE WHEN number % 3 = 0 THEN 'RESOLVED' ELSE 'OPEN' END AS status, number FROM {g_documents}""",
    "g_task_candidates": """SELECT id AS task_id, 'c:' || CAST(number % 700 + 1 AS STRING) AS entity_id, CAST(0.5 AS DOUBLE) AS score FROM {g_tasks} WHERE status = 'OPEN'
  UNION ALL SELECT id, 's:' || CAST(number % 9 + 1 AS STRING), CAST(0.75 AS DOUBLE) FROM {g_tasks}""",
    "g_requests": """SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN ' c:7 ' WHEN 1 THEN ' ' END AS entity_id, CASE event_id % 4 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'HUMAN' END AS entity_type, CASE event_id % 5 WHEN 0 THEN 'OWNS' WHEN 1 THEN 'owns' END AS predicate,
    CASE event_id % 7 WHEN 0 THEN 'OFFICIAL' WHEN 1 THEN 'SECRET' END AS connection_class, CASE WHEN event_id % 2 = 0 THEN ' energy' END AS topic, CAST(NULL AS STRING) AS person, CASE event_id % 6 WHEN 0 THEN 'a' WHEN 1 THEN '' END AS organization, CASE event_id % 9 WHEN 1 THEN 'b' END AS organisation,
    CASE event_id % 8 WHEN 0 THEN '2024-02-29' WHEN 1 THEN '2023-02-29' WHEN 2 THEN '2024-2-3' WHEN 3 THEN '2025-01-01' END AS date_from, CASE event_id % 11 WHEN 0 THEN '2024-06-30' WHEN 1 THEN 'June' END AS date_to,
    CASE event_id % 13 WHEN 0 THEN 'true' WHEN 1 THEN '0' WHEN 2 THEN 'yes' WHEN 3 THEN 'false' WHEN 4 THEN '1' END AS include_historical FROM {events}""",
    "g_compatible": "__compatible__",
}


def _compatible_sql() -> str:
    from .ontology import compatible_rows

    return "SELECT * FROM (VALUES " + ", ".join(str(r) for r in compatible_rows()) + ") AS t(predicate, subject_type, object_type)"


def sql_of(name: str) -> str:
    return _compatible_sql() if name == "g_compatible" else TABLES[name]


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def _raw(name: str) -> list[str]:
    """The driver's tables that a domain table comes from, directly or not."""
    return [name] if name not in TABLES else list(dict.fromkeys(r for n in _needs(sql_of(name)) for r in _raw(n)))


#: Domain tables that many queries name more than once and that need a shuffle: written once, so that plans read them instead of deriving them anew.
#: Evidence comes row by row from the written claims, so a copy of it would save nothing.
WRITTEN = ("g_claims",)


class Bridge:
    """Domain tables as DataFrames, made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in TABLES:
                sql = sql_of(name)
                make = lambda: self.spark.sql(sql, **self._inputs(name, sql))
                self.made[name] = kept(self.spark, name, [f"{self.sf_dir}/{r}.parquet" for r in _raw(name)], make) if name in WRITTEN else make()
            else:
                self.made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.made[name]

    def once(self, name: str) -> DataFrame:
        """A domain table for a plan that names it once: derived in it, with the columns that it needs alone, and never written."""
        sql = sql_of(name)
        return self.spark.sql(sql, **self._inputs(name, sql))

    def _inputs(self, name: str, sql: str) -> dict[str, DataFrame]:
        """The tables that ``sql`` names; lines and orders, which meet by a shuffle, are dealt out by their order as the lines are many."""
        made = {n: self(n) for n in _needs(sql)}
        if name == "g_claims":
            lines = made["lineitem"].count()  # from the footers of its files
            made |= {"lineitem": dealt(made["lineitem"], lines, "l_orderkey"), "orders": dealt(made["orders"], lines, "o_orderkey")}
        return made


def with_tables(sql: str) -> str:
    """``sql`` for DuckDB, with the domain tables that it names as common table expressions."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES and name not in order:
            for n in _needs(sql_of(name)):
                visit(n)
            order.append(name)

    for n in re.findall(r"\bg_\w+", sql):
        visit(n)
    ctes = [f"{n} AS ({re.sub(r'\{(\w+)\}', r'\1', sql_of(n))})" for n in order]
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(ctes)}, {body[len('WITH RECURSIVE '):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(ctes)}, {body[len('WITH '):]}"
    return f"WITH {', '.join(ctes)} {body}"
