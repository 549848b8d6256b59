"""Queries of the public graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..bridge import Bridge
from ..operators import api, graph
from ..operators.graph import Filters
from .registry import query

_FULL = "SELECT ev.id AS evidence_id, ev.claim_id, ev.document_id, d.source_id, coalesce(d.canonical_url, d.original_url) AS url, s.name AS source_name, s.source_quality, d.publisher, ev.evidence_text FROM g_evidence ev JOIN g_documents d ON d.id = ev.document_id JOIN g_sources s ON s.id = d.source_id"
_EDGES = f"""full_ev AS ({_FULL}), ev AS (SELECT claim_id, count(*) AS n_evidence, string_agg(DISTINCT source_quality, ',' ORDER BY source_quality) AS qualities, string_agg(evidence_id, ',' ORDER BY evidence_id) AS evidence_ids,
    min({{'i': evidence_id, 'u': url, 's': source_name, 'p': publisher, 't': evidence_text}}) FILTER (source_name <> '' AND url <> '' AND evidence_text <> '') AS main FROM full_ev GROUP BY claim_id),
edges AS (SELECT c.*, s.entity_type AS subject_type, s.canonical_name AS subject_name, s.slug AS subject_slug, s.canton AS subject_canton, o.entity_type AS object_type, o.canonical_name AS object_name, o.slug AS object_slug, o.canton AS object_canton,
    n_evidence, qualities, evidence_ids, main.u AS url, main.s AS source_name, main.p AS publisher, main.t AS evidence_text
  FROM g_claims c JOIN g_entities s ON s.id = c.subject_id JOIN g_entities o ON o.id = c.object_id JOIN g_compatible k ON k.predicate = c.predicate AND k.subject_type = s.entity_type AND k.object_type = o.entity_type
  JOIN ev ON ev.claim_id = c.id WHERE c.status = 'VERIFIED')"""
_OUT = "id, subject_id, predicate, object_id, connection_class, CAST(valid_from AS VARCHAR) AS valid_from, CAST(valid_to AS VARCHAR) AS valid_to, n_evidence, qualities, evidence_ids"
_ENDS = "ends AS (SELECT id, subject_id AS entity_id, object_id AS other_id FROM edges UNION ALL SELECT id, object_id, subject_id FROM edges)"


def edges(b: Bridge, filters: Filters = Filters()) -> DataFrame:
    full = graph.evidence_full(b("g_evidence"), b("g_documents"), b("g_sources"))
    return graph.edges(b("g_claims"), b("g_entities"), full, b("g_compatible"), filters)


def shown(edge: DataFrame) -> DataFrame:
    return edge.select("id", "subject_id", "predicate", "object_id", "connection_class", F.col("valid_from").cast("string"), F.col("valid_to").cast("string"), "n_evidence", "qualities", "evidence_ids")


def _filtered(name: str, filters: Filters, where: str, *more: str) -> None:
    query(name, f"WITH {', '.join([_EDGES, *more])} SELECT {_OUT} FROM edges WHERE {where}")(lambda b: shown(edges(b, filters)))


_filtered("graph_edges", Filters(), "true")
_filtered("graph_by_predicate", Filters(predicate="EMPLOYED_BY"), "predicate = 'EMPLOYED_BY'")
_filtered("graph_by_class", Filters(connection_class="OFFICIAL"), "connection_class = 'OFFICIAL'")
_filtered("graph_current_only", Filters(historical=False), "connection_class <> 'HISTORICAL'")
_filtered("graph_date_range", Filters(date_from="1996-01-01", date_to="1996-12-31"), "(valid_from IS NOT NULL OR valid_to IS NOT NULL) AND coalesce(valid_from, valid_to) <= DATE '1996-12-31' AND coalesce(valid_to, valid_from) >= DATE '1996-01-01'")
_filtered("graph_by_entity", Filters(entity_id="s:1"), "subject_id = 's:1' OR object_id = 's:1'")
_filtered("graph_by_entity_type", Filters(entity_type="EVENT"), "subject_type = 'EVENT' OR object_type = 'EVENT'")
_filtered("graph_topic", Filters(topic=" health "), "id IN (SELECT g.id FROM g_claims g, json_tree(g.notes) t WHERE t.type = 'VARCHAR' AND lower(t.atom->>'$') = 'health') OR subject_id IN (SELECT id FROM about) OR object_id IN (SELECT id FROM about)", "about AS (SELECT g.id FROM g_entities g, json_tree(g.metadata) t WHERE t.type = 'VARCHAR' AND lower(t.atom->>'$') = 'health')")
_filtered("graph_person", Filters(person="C:7"), "(subject_type = 'PERSON' AND (lower(subject_id) = 'c:7' OR lower(subject_slug) = 'c:7' OR lower(subject_name) = 'c:7')) OR (object_type = 'PERSON' AND (lower(object_id) = 'c:7' OR lower(object_slug) = 'c:7' OR lower(object_name) = 'c:7'))")
_filtered("graph_organization", Filters(organisation="s:2"), "object_type = 'COMPANY' AND lower(object_id) = 's:2'")


@query("graph_nodes", f"WITH {_EDGES}, {_ENDS} SELECT id, entity_type, canonical_name, slug, description, country AS country_code FROM g_entities WHERE id IN (SELECT entity_id FROM ends)")
def graph_nodes(b: Bridge) -> DataFrame:
    return graph.nodes(edges(b), b("g_entities"))


@query("claim_evidence_full", f"SELECT evidence_id, claim_id, document_id, source_id, url, source_name, source_quality, publisher, evidence_text FROM ({_FULL})")
def claim_evidence_full(b: Bridge) -> DataFrame:
    return graph.evidence_full(b("g_evidence"), b("g_documents"), b("g_sources"))


@query("person_degree", f"WITH {_EDGES}, {_ENDS} SELECT entity_id, count(*) AS degree, count(DISTINCT other_id) AS neighbours FROM ends GROUP BY entity_id")
def person_degree(b: Bridge) -> DataFrame:
    return graph.degrees(edges(b))


@query("neighbors", f"WITH {_EDGES}, {_ENDS} SELECT DISTINCT entity_id, other_id FROM ends")
def neighbors(b: Bridge) -> DataFrame:
    return graph.neighbours(edges(b))


def _timeline_sql(undated: str) -> str:
    return f"""WITH {_EDGES}, {_ENDS} SELECT entity_id, ends.id AS id, n.canonical_name AS other_name,
  array_to_string(list_transform(string_split(lower(predicate), '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS label, coalesce(CAST(valid_from AS VARCHAR), CAST(valid_to AS VARCHAR), '{undated}') AS day,
  CAST(row_number() OVER (PARTITION BY entity_id ORDER BY coalesce(CAST(valid_from AS VARCHAR), CAST(valid_to AS VARCHAR), '{undated}'), n.canonical_name, ends.id) AS INT) AS position
  FROM ends JOIN edges USING (id) JOIN g_entities n ON n.id = ends.other_id"""


@query("entity_timeline", _timeline_sql(""))
def entity_timeline(b: Bridge) -> DataFrame:
    return graph.timeline(edges(b), b("g_entities"))


@query("timeline", _timeline_sql("Undated"))
def timeline(b: Bridge) -> DataFrame:
    return graph.timeline(edges(b), b("g_entities"), undated_last=True)


@query("research_view", f"WITH {_EDGES} SELECT id, subject_name, object_name, url, source_name FROM edges WHERE url IS NOT NULL")
def research_view(b: Bridge) -> DataFrame:
    return edges(b).where("url is not null").select("id", "subject_name", "object_name", "url", "source_name")


@query("research_filter", f"WITH {_EDGES} SELECT id, qualities FROM edges WHERE list_contains(string_split(qualities, ','), 'A') AND connection_class = 'DIRECT' AND predicate = 'EMPLOYED_BY' AND subject_type = 'PERSON'")
def research_filter(b: Bridge) -> DataFrame:
    found = edges(b, Filters(historical=False, entity_type="PERSON", predicate="EMPLOYED_BY", connection_class="DIRECT"))
    return found.where(F.array_contains(F.split("qualities", ","), "A")).select("id", "qualities")


@query("research_search", f"""WITH {_EDGES} SELECT id, source_name FROM edges WHERE contains(lower(subject_name), 'src1') OR contains(lower(object_name), 'src1') OR contains(lower(predicate), 'src1') OR contains(lower(connection_class), 'src1')
  OR contains(lower(source_name), 'src1') OR contains(lower(publisher), 'src1') OR contains(lower(evidence_text), 'src1')""")
def research_search(b: Bridge) -> DataFrame:
    return graph.search(edges(b), " SRC1 ").select("id", "source_name")


_SORTS = " UNION ALL ".join(f"SELECT '{k}' AS sort_key, id, {v} AS value FROM edges" for k, v in (
    ("person", "subject_name"), ("predicate", "predicate"), ("object", "object_name"), ("connectionClass", "connection_class"),
    ("validFrom", "coalesce(CAST(valid_from AS VARCHAR), CAST(valid_to AS VARCHAR), '')"), ("source", "coalesce(source_name, '')")))


@query("research_sorted", f"WITH {_EDGES} SELECT sort_key, id, row_number() OVER (PARTITION BY sort_key ORDER BY value, id)::INT AS position FROM ({_SORTS})")
def research_sorted(b: Bridge) -> DataFrame:
    return graph.sorted_edges(edges(b))


@query("graph_nested", f"WITH {_EDGES}, f AS (SELECT claim_id, min({{'i': evidence_id, 'u': url, 'q': source_quality}}) AS first FROM full_ev GROUP BY claim_id) SELECT id, n_evidence::INT AS n_evidence, evidence_ids, first.u AS first_url, first.q AS first_quality FROM edges JOIN f ON f.claim_id = edges.id")
def graph_nested(b: Bridge) -> DataFrame:
    full = graph.evidence_full(b("g_evidence"), b("g_documents"), b("g_sources"))
    e = graph.nested(edges(b), full)
    return e.select("id", F.size("evidence").alias("n_evidence"), F.array_join(F.col("evidence.id"), ",").alias("evidence_ids"), F.col("evidence")[0]["document"]["url"].alias("first_url"), F.col("evidence")[0]["source"]["sourceQuality"].alias("first_quality"))


@query("topic_leaves", "SELECT DISTINCT g.id FROM g_claims g, json_tree(g.notes) t WHERE t.type = 'VARCHAR' AND lower(t.atom->>'$') = 'official'")
def topic_leaves(b: Bridge) -> DataFrame:
    return graph.with_leaf(b.once("g_claims").select("id", F.col("notes").alias("text")), " OFFICIAL ")


@query("public_base", """SELECT 'aliases' AS name, count(*) AS n FROM g_aliases WHERE entity_id IN (SELECT id FROM g_entities) UNION ALL SELECT 'documents', count(*) FROM g_documents WHERE source_id IN (SELECT id FROM g_sources)
UNION ALL SELECT 'claims', count(*) FROM g_claims WHERE subject_id IN (SELECT id FROM g_entities) AND (object_id IS NULL OR object_id IN (SELECT id FROM g_entities)) UNION ALL SELECT 'sources', count(*) FROM g_sources UNION ALL SELECT 'entities', count(*) FROM g_entities
UNION ALL SELECT 'evidence', count(*) FROM g_evidence WHERE claim_id IN (SELECT id FROM g_claims WHERE subject_id IN (SELECT id FROM g_entities) AND (object_id IS NULL OR object_id IN (SELECT id FROM g_entities))) AND document_id IN (SELECT id FROM g_documents WHERE source_id IN (SELECT id FROM g_sources))""")
def public_base(b: Bridge) -> DataFrame:
    from ..sources.tables import public_base as base

    tables = base({t: b(f"g_{t}") for t in ("entities", "aliases", "sources", "documents", "claims", "evidence")})
    counts = [df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out


@query("entity_detail", f"""WITH {_EDGES}, {_ENDS}, known AS (SELECT DISTINCT entity_id FROM ends), asked AS (SELECT id FROM g_entities UNION ALL SELECT 'x:' || id FROM g_sources)
SELECT asked.id, CASE WHEN entity_id IS NULL THEN 404 ELSE 200 END AS status, CASE WHEN entity_id IS NULL THEN '{{"error":"Public entity not found."}}' ELSE '{{"entityType":"' || e.entity_type || '","slug":"' || e.slug || '"}}' END AS body
FROM asked LEFT JOIN known ON known.entity_id = asked.id LEFT JOIN g_entities e ON e.id = asked.id""")
def entity_detail(b: Bridge) -> DataFrame:
    asked = b("g_entities").select("id").union(b("g_sources").select(F.concat(F.lit("x:"), "id")))
    found = graph.nodes(edges(b), b("g_entities")).select("id", F.struct(F.col("entity_type").alias("entityType"), "slug").alias("body"))
    return api.detail(asked, found, "entity")


@query("type_clusters", f"WITH {_EDGES}, {_ENDS} SELECT entity_type, count(*) AS n FROM g_entities WHERE id IN (SELECT entity_id FROM ends) GROUP BY entity_type")
def type_clusters(b: Bridge) -> DataFrame:
    return graph.clusters(graph.nodes(edges(b), b("g_entities")))


@query("node_layout", f"""WITH {_EDGES}, {_ENDS}, n AS (SELECT id, entity_type, (row_number() OVER (PARTITION BY entity_type ORDER BY id) - 1)::INT AS index, count(*) OVER (PARTITION BY entity_type) AS c FROM g_entities WHERE id IN (SELECT entity_id FROM ends))
SELECT id, entity_type, index, round(100.0 * cos(2 * pi() * index / c), 6) + 0.0 AS x, round(100.0 * sin(2 * pi() * index / c), 6) + 0.0 AS y FROM n""")
def node_layout(b: Bridge) -> DataFrame:
    return graph.layout(graph.nodes(edges(b), b("g_entities")))


@query("entity_sources", f"WITH {_EDGES}, {_ENDS}, full2 AS (SELECT * FROM full_ev) SELECT entity_id, string_agg(DISTINCT source_name, ',' ORDER BY source_name) AS sources, count(DISTINCT document_id) AS n_documents FROM ends JOIN full2 ON full2.claim_id = ends.id GROUP BY entity_id")
def entity_sources(b: Bridge) -> DataFrame:
    full = graph.evidence_full(b("g_evidence"), b("g_documents"), b("g_sources"))
    named = graph.endpoints(edges(b)).join(full.select(F.col("claim_id").alias("id"), "source_name", "document_id"), "id")
    return named.groupBy("entity_id").agg(F.array_join(F.sort_array(F.collect_set("source_name")), ",").alias("sources"), F.countDistinct("document_id").alias("n_documents"))


@query("entity_aliases", "SELECT id, entity_id, alias, language FROM g_aliases")
def entity_aliases(b: Bridge) -> DataFrame:
    return b("g_aliases").select("id", "entity_id", "alias", "language").orderBy("entity_id", F.expr("alias COLLATE UNICODE"), "id")


@query("connected_entities", f"WITH {_EDGES}, {_ENDS} SELECT DISTINCT e.id, e.canonical_name FROM ends JOIN g_entities e ON e.id = ends.other_id WHERE ends.entity_id = 'c:7'")
def connected_entities(b: Bridge) -> DataFrame:
    ends = graph.endpoints(edges(b, Filters(entity_id="c:7"))).where("entity_id = 'c:7'").select(F.col("other_id").alias("id")).distinct()
    return b("g_entities").join(ends, "id").select("id", "canonical_name").orderBy(F.expr("canonical_name COLLATE UNICODE"), "id")


@query("predicate_compat", "SELECT c.id FROM g_claims c JOIN g_entities s ON s.id = c.subject_id JOIN g_entities o ON o.id = c.object_id WHERE (c.predicate, s.entity_type, o.entity_type) NOT IN (SELECT (predicate, subject_type, object_type) FROM g_compatible)")
def predicate_compat(b: Bridge) -> DataFrame:
    e = b("g_entities")
    typed = b.once("g_claims").join(e.select(F.col("id").alias("subject_id"), F.col("entity_type").alias("subject_type")), "subject_id").join(e.select(F.col("id").alias("object_id"), F.col("entity_type").alias("object_type")), "object_id")
    return typed.join(F.broadcast(b("g_compatible")), ["predicate", "subject_type", "object_type"], "left_anti").select("id")
