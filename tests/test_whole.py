"""Queries against brute force or whole-table SQL: no row, test or signal of theirs is left out."""

import re
import unicodedata

import duckdb

import __spark_entry__ as entry
from claimweave import ontology
from claimweave.bridge import RAW, with_tables
from claimweave.operators import graph

SF = "/root/testdata/sf0.001"


def duck(sql):
    with duckdb.connect() as con:
        for name in RAW:
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
        return con.execute(sql if sql.startswith("WITH ") else with_tables(sql)).fetchall()


def rows(spark, name):
    return entry.queries()[name](spark, SF).collect()


def plain(x):
    x = "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower().replace("'", "")
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in x).split())


def judged(claim, marked, subject_type, object_type, evidence, text, unclear, quality, dated, names):
    """(status, evidence_score, reasons, warnings) by the rule, one claim at a time."""
    _, predicate, subject, obj = claim
    at = -1 if not text or not evidence else text.find(evidence) if evidence in text else text.lower().find(evidence.lower())
    context = evidence or ""
    if at >= 0:
        last = max(at, at + len(evidence) - 1)
        context = (re.search(r"[^.!?]*\Z", text[:at])[0] + text[at:last] + re.match(r"[^.!?]*[.!?]?", text[last:])[0]).strip(" ")
    n = plain(context)
    some = lambda terms: any(f" {t} " in f" {n} " for t in terms)
    cued = some(ontology.CUES[predicate])
    known, has = [x in names for x in (subject, obj)], [x in names and plain(names[x]) in n for x in (subject, obj)]
    quoted = some(ontology.ATTRIBUTIONS) or bool(re.search('["«»]', context))
    tests = [
        (text is None, "document is unknown"), (not (text or "").strip(" "), "document has no extracted text"), (not known[0], "subject entity is unknown"),
        (obj is None, "object entity is missing"), (obj is not None and not known[1], "object entity is unknown"),
        (all(known) and object_type not in ontology.COMPATIBLE[predicate][1] or all(known) and subject_type not in ontology.COMPATIBLE[predicate][0], "predicate is incompatible with entity types"),
        (at < 0, "evidence text is not present in the document"), (not cued, "evidence does not express the proposed relation"),
        (known[0] and not has[0], "subject entity is not explicit in the evidence context"), (known[1] and not has[1], "object entity is not explicit in the evidence context"),
        (some(ontology.NEGATIONS), "evidence contains likely negation"), (some(ontology.CONTRADICTIONS), "evidence appears contradicted or disputed"),
    ]
    reasons = [r for test, r in tests if test]
    score = (3 if cued else -3) - sum(k and not h for k, h in zip(known, has, strict=True)) + 2 * all(has) + 2 * (quality in ("A", "B")) + dated - 4 * some(ontology.NEGATIONS) - 4 * some(ontology.CONTRADICTIONS) - 3 * quoted - 3 * unclear
    warnings = [(marked, "LLM marked the relation for review"), (quoted, "evidence appears to rely on a third-party quote or attribution"), (unclear, "entity resolution is ambiguous"), (some(ontology.SENSITIVE), "sensitive topic requires human verification")]
    return ("REJECTED" if reasons else "PENDING_REVIEW", score, "; ".join(reasons), "; ".join(w for test, w in warnings if test))


def test_claims_are_all_validated(spark):
    names = dict(duck("SELECT id, canonical_name FROM g_entities"))
    types = dict(duck("SELECT id, entity_type FROM g_entities"))
    items = dict(duck("SELECT item_id, text FROM benchmark"))
    found = duck("""SELECT c.id, c.predicate, c.subject_id, c.object_id, c.partkey, d.extracted_text, s.source_quality, c.valid_from IS NOT NULL OR c.valid_to IS NOT NULL OR coalesce(d.is_published, false), ev.id IS NOT NULL
      FROM g_claims c LEFT JOIN g_evidence ev ON ev.claim_id = c.id LEFT JOIN g_documents d ON d.id = ev.document_id LEFT JOIN g_sources s ON s.id = d.source_id""")
    # Mentions of two surnames mean either person.
    people = {i for (i,) in duck("SELECT c_custkey FROM customer")}
    unclear = {f"c:{j}" for i in people if i % 3 == 1 and i + 1 in people for j in (i, i + 1)}
    expected = []
    for i, predicate, subject, obj, part, text, quality, dated, evident in found:
        evidence = None if not evident else items.get(part % len(items)) if part % 2 else text and text[9:89]
        expected.append((i, *judged((i, predicate, subject, obj), part % 29 == 0, types.get(subject), types.get(obj), evidence, text, bool({subject, obj} & unclear), quality, dated, names)))
    got = [tuple(r) for r in rows(spark, "claim_validate")]
    assert sorted(got) == sorted(expected)
    for reason in ("document is unknown", "predicate is incompatible", "evidence text is not present", "object entity is missing"):
        assert any(reason in r[3] for r in got)
    assert any("evidence text is not present" not in r[3] for r in got) and {w for r in got for w in r[4].split("; ")} >= {"LLM marked the relation for review", "entity resolution is ambiguous"}


def test_unclear_entities(spark):
    from claimweave.operators import resolution

    scored = spark.createDataFrame([("a", "1", 0.86, 1), ("a", "2", 0.82, 2), ("a", "3", 0.42, 3), ("b", "4", 0.98, 1), ("b", "5", 0.86, 2), ("c", "6", 0.9, 1)], "mention_id string, entity_id string, score double, rank int")
    assert {r.id for r in resolution.unclear(scored).collect()} == {"1", "2"}


def test_every_customer_is_resolved(spark):
    for name in ("resolve_candidates", "resolve_mentions"):
        whole = duck(entry.oracle_sql()[name])
        assert sorted(map(tuple, rows(spark, name)), key=str) == sorted(whole, key=str)
    got = rows(spark, "resolve_mentions")
    assert {r.status for r in got} == {"AUTO_RESOLVED", "MANUAL_REVIEW", "NO_MATCH"} and len({r.reason for r in got}) == 4
    people = {r.mention_id for r in got if r.mention_id.startswith("m:")}
    assert people == {f"m:{i}" for (i,) in duck("SELECT c_custkey FROM customer")}


def test_versions_of_whole_texts(spark):
    assert sorted(tuple(r) for r in rows(spark, "doc_versions")) == sorted(duck(entry.oracle_sql()["doc_versions"]))


def test_a_change_after_the_sixth_character_is_a_version(spark, tmp_path):
    spark.createDataFrame([(1, "same start, one end"), (98, "same start, other end"), (195, "same start, one end")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["doc_versions"](spark, str(tmp_path)).orderBy("id").collect()
    assert [(r.outcome, r.version) for r in got] == [("CREATED", 1), ("CREATED_NEW_VERSION", 2), ("UNCHANGED", 2)]


def test_all_edges_are_sorted(spark):
    whole = duck(entry.oracle_sql()["research_sorted"])
    assert len(whole) > 100 and sorted(tuple(r) for r in rows(spark, "research_sorted")) == sorted(whole)


def test_positions(spark):
    values = [(f"n{i % 7}", str(i)) for i in range(500)]
    got = graph.positions(spark.createDataFrame(values, "name string, id string"), ["name", "id"]).collect()
    assert [(r.name, r.id) for r in sorted(got, key=lambda r: r.position)] == sorted(values) and {r.position for r in got} == set(range(1, 501))
    assert graph.positions(spark.createDataFrame([], "id string"), ["id"]).count() == 0


def test_walk_from_every_root(spark):
    whole = duck(entry.oracle_sql()["sitemap_walk"])
    got = [tuple(r) for r in rows(spark, "sitemap_walk")]
    assert sorted(got, key=str) == sorted(whole, key=str) and {r[1] for r in got} == {i for (i,) in duck("SELECT p_partkey FROM part")}


def test_metadata_signals(spark):
    """Candidates that reach the threshold by metadata alone, and scores that need every signal."""
    from claimweave.operators import resolution

    kind = "id string, entity_type string, canonical_name string, metadata map<string,string>"
    entities = spark.createDataFrame([
        ("1", "PERSON", "Anna Muster", {"political_party": "Grüne", "office": "Rat", "company": "Eins", "valid_from": "2020", "relatedEntityIds": '["x"]'}),
        ("2", "PERSON", "Beat Beispiel", {"party": "Mitte", "canton": "ZH"}), ("3", "PERSON", "Carl Muster", {}),
    ], kind)
    aliases = spark.createDataFrame([], "entity_id string, alias string")
    mentions = spark.createDataFrame([
        ("a", "PERSON", "Nobody", None, {"party": "grune", "role": "RAT", "organisation": "eins"}, None), ("b", "PERSON", "Nobody", None, {"party": "mitte", "canton": "zh"}, None),
        ("c", "PERSON", "Nobody", ["Anna Muster"], {"party": " ", "to": "2021"}, ["x"]), ("d", "PERSON", "Frau Muster", None, {"party": "Grüne", "position": "rat"}, None),
        ("e", "PERSON", "Nobody", None, {"party": "Grüne", "office": "rat", "to": "2019"}, None), ("f", "PERSON", "Nobody", None, {"party": "Grüne", "office": "rat", "to": "2020"}, None),
    ], "mention_id string, entity_type string, name string, aliases array<string>, metadata map<string,string>, co_mentioned array<string>")
    scored = resolution.candidates(mentions, entities, aliases)
    got = {(r.mention_id, r.entity_id): (r.score, r.signals) for r in scored.collect()}
    assert got == {
        ("a", "1"): (0.21, "same party+same position+same organisation"), ("b", "2"): (0.2, "same party+same canton"), ("c", "1"): (0.96, "exact canonical name+overlapping time period+co-mentioned entity"), ("c", "3"): (0.34, "same surname"),
        ("d", "1"): (0.49, "same surname+same party+same position"), ("d", "3"): (0.34, "same surname"), ("f", "1"): (0.2, "same party+same position+overlapping time period"),
    }
    told = {r.mention_id: (r.status, (r.reason or "-")[:3]) for r in resolution.resolve(mentions, scored).collect()}
    weak = ("MANUAL_REVIEW", "Top")
    assert told == {"a": weak, "b": weak, "c": ("AUTO_RESOLVED", "-"), "d": ("MANUAL_REVIEW", "Amb"), "e": ("NO_MATCH", "No "), "f": weak}
