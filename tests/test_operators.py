import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from claimweave import ontology
from claimweave.operators import contracts, discovery, graph, integrity, jobs, resolution, review, validation
from claimweave.sources import tables
from claimweave.streaming import ingest


def relation(spark, evidence, text, predicate="EMPLOYED_BY", quality="A", dated=True, ambiguous=False):
    row = ("1", predicate, evidence, text, "Anna Muster", "Firma Eins", True, quality, dated, False, ambiguous)
    return validation.validate(spark.createDataFrame([row], "id string, predicate string, evidence_text string, text string, subject_name string, object_name string, compatible boolean, source_quality string, dated boolean, requires_review boolean, ambiguous boolean")).first()


def test_validation_scores(spark):
    good = "Anna Muster is employed by Firma Eins."
    assert (lambda r: (r.status, r.evidence_score))(relation(spark, good, good)) == ("PENDING_REVIEW", 8)
    quoted = "Peter said Anna Muster is employed by Firma Eins."
    assert (lambda r: (r.status, r.evidence_score, len(r.warnings)))(relation(spark, quoted, quoted)) == ("PENDING_REVIEW", 5, 1)
    assert relation(spark, good, good, quality="D", ambiguous=True).evidence_score == 3
    negated = "Anna Muster is not employed by Firma Eins."
    assert relation(spark, negated, negated).status == "REJECTED"
    assert "evidence text is not present in the document" in relation(spark, good, "Another text.").reasons


def test_resolution_rule(spark):
    entities = spark.createDataFrame([("1", "PERSON", "Anna Muster", "ZH", None), ("2", "PERSON", "Anna Muster", "BE", None), ("3", "COMPANY", "Firma Eins AG", None, None)], "id string, entity_type string, canonical_name string, canton string, country string")
    aliases = spark.createDataFrame([("3", "F1")], "entity_id string, alias string")
    mentions = spark.createDataFrame([("a", "PERSON", "anna muster", "ZH", None), ("b", "PERSON", "Anna Muster", None, None), ("c", "COMPANY", "Firma Eins", None, None), ("d", "COMPANY", "F1", None, None), ("e", "COMPANY", "Nobody", None, None)], "mention_id string, entity_type string, name string, canton string, country string")
    scored = resolution.candidates(mentions, entities, aliases)
    got = {r.mention_id: (r.status, (r.reason or "")[:3], r.entity_id, r.top) for r in resolution.resolve(mentions, scored).collect()}
    assert got == {"a": ("AUTO_RESOLVED", "", "1", 0.98), "b": ("MANUAL_REVIEW", "Amb", None, 0.86), "c": ("MANUAL_REVIEW", "Top", None, 0.42), "d": ("AUTO_RESOLVED", "", "3", 0.9), "e": ("NO_MATCH", "No ", None, None)}
    with pytest.raises(ValueError):
        resolution.candidates(mentions, entities, aliases, least=0.1)


def test_feeds(spark):
    atom = "<feed><entry><title>A &amp; B</title><link href='http://e.org/x' rel='self'/><link rel=\"alternate\" href=\"http://e.org/y\"/><updated>2024-01-02T03:04:05Z</updated></entry></feed>"
    blank = "<rss><channel><item><link> </link><guid>http://e.org/g</guid></item><item><guid>http://e.org/h</guid></item></channel></rss>"
    docs = spark.createDataFrame([(1, atom), (2, blank), (3, "<other/>"), (4, None)], "source_id int, xml string")
    assert {(r.source_id, r.url, r.title) for r in discovery.items(docs).collect()} == {(1, "http://e.org/y", "A & B"), (2, "http://e.org/h", None)}


def test_versions_and_lineage(spark):
    f = spark.createDataFrame([(1, "u", "h1", 1), (2, "u", "h1", 2), (3, "u", "h2", 3), (4, "v", "h1", 1)], "id int, url string, hash string, at int")
    assert [(r.outcome, r.version) for r in jobs.document_versions(f).orderBy("id").collect()] == [("CREATED", 1), ("UNCHANGED", 1), ("CREATED_NEW_VERSION", 2), ("CREATED", 1)]
    links = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c")], "id string, supersedes_id string")
    assert {(r.id, r.root, r.depth) for r in review.lineage(links).collect()} == {("a", "a", 0), ("b", "a", 1), ("c", "a", 2), ("d", "a", 3)}


def test_long_and_circular_lineage(spark):
    links = [("0", None)] + [(str(i), str(i - 1)) for i in range(1, 300)]
    got = {r.id: (r.root, r.depth) for r in review.lineage(spark.createDataFrame(links, "id string, supersedes_id string")).collect()}
    assert got == {str(i): ("0", i) for i in range(300)}
    with pytest.raises(ValueError, match="circle"):
        review.lineage(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", None)], "id string, supersedes_id string"))


def test_records(spark):
    row = {"id": " x ", "entity_id": "e", "alias": "a", "language": " ", "created_at": "2024-01-01"}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    got = tables.records(df, "entity_aliases").first()
    assert (got.id, got.language, got.source_id) == (" x ", None, None)
    with pytest.raises(Exception, match="Expected alias to be a non-empty string"):
        tables.records(df.withColumn("alias", F.lit(" ")), "entity_aliases").collect()
    assert tables.records(df.withColumn("created_at", F.lit("x")), "entity_aliases", strict=False).first().error == "Expected created_at to be a valid date."
    texts = spark.createDataFrame([('{"a":1}',), ("[1]",), ("3",), (None,), ("no",)], "t string")
    assert [r[0] for r in texts.select(tables.json_record(F.col("t"))).collect()] == ['{"a":1}', "{}", "{}", "{}", "{}"]


def test_changes_and_lookups(spark, tmp_path):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    changes = spark.createDataFrame([(2, "c", 1), (2, None, 2)], "id int, v string, change int")
    assert {tuple(r) for r in tables.apply_changes(base, changes).collect()} == {(1, "a"), (2, None)}
    new = spark.createDataFrame([(3, "n", 1)], "id int, v string, change int")
    with pytest.raises(ValueError):
        tables.apply_changes(base, new)
    assert tables.apply_changes(base, new, upsert=True).count() == 3
    assert tables.at_most_one(tables.lookup(base, 2)).first().v == "b"
    with pytest.raises(ValueError):
        tables.at_most_one(base)
    bodies = spark.createDataFrame([("raw-documents/t/1.html", b"x")], "path string, body binary")
    tables.write_bodies(bodies, f"{tmp_path}/bodies")
    with pytest.raises(ValueError, match="exists"):
        tables.write_bodies(bodies, f"{tmp_path}/bodies")


def test_contracts(spark):
    def read(operation, *answers):
        rows = spark.createDataFrame([(i, a if isinstance(a, str) else json.dumps(a)) for i, a in enumerate(answers)], "i int, answer string")
        told = contracts.parsed(rows, operation).select("i", "errors", F.to_json("output").alias("output")).orderBy("i").collect()
        return [(r.errors, r.output and json.loads(r.output)) for r in told]

    entity = {"local_id": " e ", "type": "PERSON", "name": "A", "evidence": "x"}
    whole = {"local_id": "e", "type": "PERSON", "name": "A", "evidence": "x", "aliases": [], "metadata": {}}
    told = read("extractEntities", {"entities": [entity, entity | {"aliases": [" b", "c"], "metadata": {"k": [1, None]}}]}, {"entities": []}, {"entities": {}}, {}, {"entities": [entity | {"type": "HUMAN", "age": 3, "aliases": ["a", " ", 7]}, 5]}, [], "no json", {"entities": [], "more": 1}, {"entities": [{k: v for k, v in entity.items() if k != "name"} | {"metadata": []}]})
    assert told[0] == ([], {"entities": [whole, whole | {"aliases": ["b", "c"], "metadata": {"k": [1, None]}}]}) and told[1] == ([], {"entities": []})
    assert [e for e, _ in told[2:]] == [
        ["entities: expected an array"], ["entities: required"],
        ["entities.0.type: expected one of " + ", ".join(ontology.ENTITY_TYPES), "entities.0.aliases.1: expected a non-empty string", "entities.0.aliases.2: expected a non-empty string", "entities.0: unknown key age", "entities.1: expected an object"],
        ["<root>: expected an object"], ["<root>: expected an object"], ["<root>: unknown key more"], ["entities.0.metadata: expected an object", "entities.0.name: required"]]
    assert all(o is None for _, o in told[2:])
    relation = {"subject_entity_id": "s", "predicate": "OWNS", "connection_class": "DIRECT", "evidence_text": "t", "confidence": 0.5, "requires_review": False}
    told = read("extractClaims", *[{"relations": [r]} for r in (relation, relation | {"literal_value": None, "valid_from": "2024-02-31"}, relation | {"confidence": 2, "object_entity_id": "o"}, relation | {"object_entity_id": "o", "more": 1}, relation | {"object_entity_id": "o", "valid_to": "2024"}, relation | {"object_entity_id": "o", "requires_review": "no", "confidence": True})])
    assert [e for e, _ in told] == [["relations.0: A relation needs either object_entity_id or literal_value."], [], ["relations.0.confidence: expected a number from 0 to 1"], ["relations.0: unknown key more"], ["relations.0.valid_to: Expected YYYY-MM-DD date."], ["relations.0.confidence: expected a number from 0 to 1", "relations.0.requires_review: expected a boolean"]]
    assert told[1][1]["relations"][0]["valid_from"] == "2024-02-31" and told[1][1]["relations"][0]["confidence"] == 0.5
    resolution_ = {"local_id": "m", "candidates": [{"entity_id": "e", "score": 1}], "manual_review_required": True}
    told = read("resolveEntityCandidates", {"resolutions": [resolution_]}, {"resolutions": [resolution_ | {"candidates": [{"score": -1}]}]})
    assert told[0][1] == {"resolutions": [{"local_id": "m", "candidates": [{"entity_id": "e", "score": 1, "signals": []}], "manual_review_required": True}]}
    assert told[1][0] == ["resolutions.0.candidates.0.score: expected a number from 0 to 1", "resolutions.0.candidates.0.entity_id: required"]
    assert [e for e, _ in read("validateClaim", {"result": "SUPPORTED"}, {"result": "MAYBE"}, {"result": None})] == [[], ["result: expected one of SUPPORTED, CONTRADICTED, INSUFFICIENT"], ["result: expected one of SUPPORTED, CONTRADICTED, INSUFFICIENT"]]


def test_runs_of_a_provider(spark):
    def provider(given):
        if given.get("fail"):
            raise RuntimeError("no answer")
        return {"result": "INSUFFICIENT" if "document" in given else "NONE"}

    inputs = [("1", '{"document":{"id":"d","extractedText":"abc"},"claim":{"id":"c"}}'), ("2", "no json"), ("3", '{"documentId":"d \\"x\\""}'), ("4", '{"fail":true}'), ("5", None)]
    got = {r.request_id: r for r in contracts.run(spark.createDataFrame(inputs, "request_id string, input string"), "validateClaim", provider, "p", "m", "v", 0.5).collect()}
    assert {i: (r.status, r.error_message) for i, r in got.items()} == {"1": ("SUCCEEDED", None), "2": ("FAILED", "The input is no JSON."), "3": ("FAILED", "result: expected one of SUPPORTED, CONTRADICTED, INSUFFICIENT"), "4": ("FAILED", "no answer"), "5": ("FAILED", "The input is no JSON.")}
    assert json.loads(got["1"].input_summary) == {"documentId": "d", "claimId": "c", "textLength": 3} and json.loads(got["3"].input_summary) == {"documentId": 'd "x"'} and got["2"].input_summary is None
    assert (got["1"].output_summary, got["1"].temperature, got["1"].schema_version, got["1"].input_hash) == ('{"result": "INSUFFICIENT"}', 0.5, "claim-validation.v1", hashlib.sha256(inputs[0][1].encode()).hexdigest())
    assert got["1"].__fields__ == list(contracts.RUN)


def test_substring_names_meet(spark):
    entities = spark.createDataFrame([("1", "COMPANY", "Acmecorp Holding"), ("2", "COMPANY", "me"), ("3", "COMPANY", "")], "id string, entity_type string, canonical_name string")
    mentions = spark.createDataFrame([("a", "COMPANY", "acme"), ("b", "COMPANY", "The Acmecorp Holding AG"), ("c", "COMPANY", "zz")], "mention_id string, entity_type string, name string")
    got = {(r.mention_id, r.entity_id, r.score) for r in resolution.candidates(mentions, entities, spark.createDataFrame([], "entity_id string, alias string")).collect()}
    assert got == {("a", "1", 0.42), ("a", "2", 0.42), ("b", "1", 0.42), ("b", "2", 0.42)}


def test_json_leaves(spark):
    deep = '{"a": ' * 40 + '["Energy"]' + "}" * 40
    rows = spark.createDataFrame([(1, '{"a": ["Energy", {"b": "x"}]}'), (2, '{"energy": 1}'), (3, '["energy"]'), (4, None), (5, '{"a": "ener\\u0067y"}'), (6, "no"), (7, deep), (8, '"energy"'), (9, '{"a": 7, "b": null, "c": [[], {}]}'), (10, '{"a": "energy x"}')], "id int, text string")
    assert sorted(r.id for r in graph.with_leaf(rows, " ENERGY ").collect()) == [1, 5, 7]
    assert graph.with_leaf(rows, " ").count() == 0


def test_keys_alone_start_no_parse(spark):
    """A token that is only a key is told from the text; one that is a value too, or may be one by an escape, is parsed."""
    texts = ['{"energy": 1}', '{"energy" : "x", "a": "Energy" }', '{"a": "energy"', '{"a": "\\u0065nergy"}', '{"a": ["ENERGY"]}', '{"a": "energy x"}', '{"\\\\E": "energy"}', None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    assert [r.id for r in rows.where(graph.may_hold("text", "energy")).orderBy("id").collect()] == [1, 2, 3, 4, 6]
    assert sorted(r.id for r in graph.with_leaf(rows, "energy").collect()) == [1, 3, 4, 6]


def test_batch_limits():
    assert [jobs.batch_limit(x) for x in (None, "x", 0, 5, "7.9", 99, float("nan"))] == [1, 1, 1, 5, 7, 10, 1]


def test_updates_are_dated(spark):
    old, new = spark.createDataFrame([(1, "a")], "id int, v string"), spark.createDataFrame([(1, "b"), (2, "c")], "id int, v string")
    got = {r.id: r.updated_at for r in integrity.touched(old, new, "id", F.lit("now")).collect()}
    assert got == {1: "now", 2: None}


def test_optional_and_typed_tables(spark, tmp_path):
    schema = StructType.fromDDL("id string, n int")
    assert tables.optional(spark, f"file://{tmp_path}/none", schema).count() == 0
    rows, rejected = tables.typed(spark.createDataFrame([(" a ", "1"), ("", "2"), ("b", "x")], "id string, n string"), schema, ("id",))
    assert {tuple(r) for r in rows.collect()} == {("a", 1), ("b", None)} and rejected.count() == 1


def test_new_candidates_stream(spark, tmp_path):
    spark.sql("SELECT 1 source_id, 'u' canonical_url, timestamp'2024-01-01 00:00:00' at UNION ALL SELECT 1, 'u', timestamp'2024-01-01 00:01:00' UNION ALL SELECT 2, 'u', timestamp'2024-01-01 00:01:00'").write.parquet(f"{tmp_path}/c")
    found = spark.readStream.schema("source_id int, canonical_url string, at timestamp").parquet(f"{tmp_path}/c")
    ingest.new_candidates(found).writeStream.format("memory").queryName("fresh").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.source_id for r in spark.table("fresh").collect()) == [1, 2]


def test_queries_have_names_without_session_state():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_unavailable_tables(spark, tmp_path):
    from claimweave.operators import api

    asked = spark.createDataFrame([("a",), ("b",)], "id string")
    gone = {r.id: (r.status, json.loads(r.body)["error"]) for r in api.answered(asked, lambda: spark.read.parquet(f"{tmp_path}/none"), "entity").collect()}
    assert gone == dict.fromkeys("ab", (503, "Public entity API is unavailable."))
    there = spark.createDataFrame([("a", 1)], "id string, n int").select("id", F.struct("n").alias("body"))
    assert {(r.id, r.status) for r in api.answered(asked, lambda: there, "entity").collect()} == {("a", 200), ("b", 404)}


def test_unchecked_rules(spark):
    df = spark.createDataFrame([("1", " "), ("2", "x")], "id string, alias string")
    told = {r.rule: (r.state, r.n) for r in integrity.report(df, "entity_aliases").collect()}
    assert told == {"alias_not_blank": ("checked", 1), "language_form": ("unchecked", None), "dates_ordered": ("unchecked", None)}


def test_unclear_entities_without_a_row_of_each_pair(spark):
    """The same as from all candidates, also where names and metadata meet; nothing is made of each pair of a large block."""
    people = [(f"p{i}", "PERSON", f"Vor{i} Nach{i % 40}", f"k{i % 3}" if i % 7 else None, str(i % 4)) for i in range(120)]
    firms = [(f"f{i}", "COMPANY", f"Firma {'Nord ' * (i % 3)}Nr{i % 5}", None, str(i % 2)) for i in range(20)]
    kind = "string, entity_type string, canonical_name string, canton string, country string"
    entities = spark.createDataFrame(people + firms, f"id {kind}")
    aliases = spark.createDataFrame([("p1", "Anna"), ("p2", "Anna"), ("f3", "F3")], "entity_id string, alias string")
    mentions = spark.createDataFrame(
        [(f"a{i}", "PERSON", f"Vor{i} Nach{i % 50}", f"k{i % 4}", str(i % 5)) for i in range(60)] + [("b", "PERSON", "Anna", "k9", None), ("c", "PERSON", "Nobody", "k1", "9"), ("d", "PERSON", "Nobody", "k1", "1"), ("e", "COMPANY", "Nord", None, "1"), ("g", "COMPANY", "f3", None, None)],
        "mention_id string, entity_type string, name string, canton string, country string")
    whole = {r.id for r in resolution.unclear(resolution.candidates(mentions, entities, aliases)).collect()}
    assert 20 < len(whole) < 140 and {r.id for r in resolution.unclear_entities(mentions, entities, aliases).collect()} == whole
    hot = spark.range(20_000).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("id"), F.lit("PERSON").alias("entity_type"), F.concat(F.lit("Name"), F.col("id").cast("string")).alias("canonical_name"), F.lit("ZH").alias("canton"), F.lit("1").alias("country"))
    asked = spark.range(20_000).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("mention_id"), F.lit("PERSON").alias("entity_type"), F.lit("Nobody").alias("name"), F.lit("ZH").alias("canton"), F.lit("1").alias("country"))
    assert resolution.unclear_entities(asked, hot, aliases.limit(0)).count() == 20_000  # of 400 million pairs


def test_candidates_are_ranked_once_for_each_profile(spark):
    """Lists of profiles, cut into chunks, with the changes that names make: the same rows as from a sort of each mention's pairs."""
    people = [(f"p{i}", "PERSON", f"Vor{i % 9} Nach{i % 40}", f"k{i % 3}" if i % 7 else None, str(i % 2)) for i in range(90)]
    firms = [(f"f{i}", "COMPANY", f"Firma {'Nord ' * (i % 3)}Nr{i % 5}", "k1", str(i % 2)) for i in range(20)]
    kind = "string, entity_type string, canonical_name string, canton string, country string"
    entities = spark.createDataFrame(people + firms, f"id {kind}")
    aliases = spark.createDataFrame([("p1", "Anna"), ("p2", "Anna"), ("f3", "F3")], "entity_id string, alias string")
    asked = [(f"a{i}", "PERSON", f"Vor{i % 9} Nach{i % 50}", f"k{i % 4}", str(i % 3)) for i in range(60)] + [("b", "PERSON", "Anna", "k9", None), ("c", "PERSON", "Nobody", "k1", "9"), ("d", "PERSON", "Nobody", "k1", "1"), ("e", "COMPANY", "Nord", "k1", "1"), ("g", "COMPANY", "f3", None, None)]
    mentions = spark.createDataFrame(asked, "mention_id string, entity_type string, name string, canton string, country string")
    rows = lambda df: sorted(tuple(r) for r in df.select("mention_id", "entity_id", "score", "rank", "signals", F.coalesce("surname", F.lit("-"))).collect())
    expected = rows(resolution.candidates(mentions, entities, aliases, best=1000))
    assert len(expected) > 400 and rows(resolution.candidates(mentions, entities, aliases)) == expected
    assert rows(resolution._ranked(resolution._sides(mentions, entities, aliases, 0.2), 0.2, chunk=3)) == expected


def test_candidates_are_made_in_as_many_tasks_as_their_rows_ask_for(spark, monkeypatch):
    """What meets is small, what comes of it is not: 60 mentions of one kind with 50 candidates each, and two runs where a name moves one."""
    entities = spark.createDataFrame([(f"p{i:02}", "PERSON", f"Vor Nach{i:02}", "k", "1") for i in range(50)], "id string, entity_type string, canonical_name string, canton string, country string")
    mentions = spark.createDataFrame([(f"a{i}", "PERSON", f"Vor Nach{i:02}" if i < 40 else "Nobody", "k", "1") for i in range(60)], "mention_id string, entity_type string, name string, canton string, country string")
    monkeypatch.setattr(resolution, "MADE", 100)
    df = resolution.candidates(mentions, entities, spark.createDataFrame([], "entity_id string, alias string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 30), REPARTITION_BY_NUM") == 2, plan
    got = {}
    for r in df.collect():
        got.setdefault(r.mention_id, {})[r["rank"]] = r.entity_id
    names = [f"p{i:02}" for i in range(50)]
    for i in range(60):
        first = [f"p{i:02}"] if i < 40 else []
        assert [got[f"a{i}"][k] for k in range(1, 51)] == first + [n for n in names if n not in first]


def test_sides_that_grow_are_not_sent_through_the_driver(spark, monkeypatch):
    """Written tables look small by their files: mentions, entities and names meet by a sort, however few they are."""
    entities = spark.createDataFrame([(f"p{i}", "PERSON" if i % 2 else "COMPANY", f"Vor Nach{i}", "k", "1") for i in range(9)], "id string, entity_type string, canonical_name string, canton string, country string")
    mentions = entities.select(F.col("id").alias("mention_id"), "entity_type", F.col("canonical_name").alias("name"), "canton", "country")
    plans, write = [], resolution.written
    told = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(resolution, "written", lambda df: write(told(df)))
    aliases = spark.createDataFrame([("p1", "Anna")], "entity_id string, alias string")
    told(resolution.candidates(mentions, entities, aliases)), told(resolution.unclear_entities(mentions, entities, aliases))
    assert "SortMergeJoin [mention_id" in (text := "\n".join(plans)) and not re.findall(r"BroadcastHashJoin \[(?:mention_id|entity_id|id|block|gram)#.*", text)


def test_many_rows_are_dealt_to_more_tasks(spark, monkeypatch):
    """Beyond what the session's partitions read in bounded tasks, there are more of them; lines meet their orders in those, too."""
    from claimweave import written
    from claimweave.bridge import Bridge

    monkeypatch.setattr(written, "DEALT", 100)
    df = spark.range(1000)
    assert written.dealt(df, 1000, "id").rdd.getNumPartitions() == 10 and written.dealt(df, 400, "id") is df
    b = Bridge(spark, "/root/testdata/sf0.001")
    parts = -(-b("lineitem").count() // 100)
    plan = b.once("g_claims").where("line > 0")._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f", {parts}), REPARTITION_BY_NUM") == 2
