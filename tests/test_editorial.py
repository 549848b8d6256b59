"""Batches that fold in order, transitions at their place in the log, merges of merges, drafts of drafts, edits of several tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from claimweave import written
from claimweave.operators import admission, graph, jobs, resolution, review
from claimweave.sources.changesets import ChangeSets, Conflict, put_if_absent

JOBS = "id int, url_candidate_id int, attempts int, max_attempts int, scheduled_at timestamp_ntz"
NOW = "2026-08-18 10:00:00"


def outcomes(spark, started, responses, stored=(), candidates=((1, 7), (2, 7))):
    from datetime import datetime, timedelta

    at = datetime(2026, 8, 18, 9)
    rows = [(i, c, a, m, at + timedelta(minutes=minute)) for i, c, a, m, minute in started]
    told = jobs.fetch_outcomes(
        spark.createDataFrame(rows, JOBS), spark.createDataFrame(list(candidates), "id int, crawl_run_id int"),
        spark.createDataFrame(list(responses), "id int, canonical_url string, content_hash string, error string"), spark.createDataFrame(list(stored), "canonical_url string, content_hash string"), NOW)
    return {r.id: r for r in told.collect()}


def test_jobs_of_a_batch_see_each_other(spark):
    """By time, not by id: the later job of a url and hash is unchanged, other content is the next version."""
    got = outcomes(spark, [(3, 1, 1, 3, 0), (1, 2, 1, 3, 5), (2, 1, 1, 3, 9), (4, 1, 1, 3, 9), (5, 1, 1, 3, 10)],
                   [(3, "u", "a", None), (1, "u", "a", None), (2, "u", "b", None), (4, "v", "a", None), (5, "u", "a", None)])
    assert {i: (r.outcome, r.version, r.job_status) for i, r in got.items()} == {3: ("CREATED", 1, "SUCCEEDED"), 1: ("UNCHANGED", None, "SKIPPED"), 2: ("CREATED_NEW_VERSION", 2, "SUCCEEDED"), 4: ("CREATED", 1, "SUCCEEDED"), 5: ("UNCHANGED", None, "SKIPPED")}
    assert got[1].follow_up_jobs == [] and got[2].follow_up_jobs == ["EXTRACT_DOCUMENT", "ANALYZE_DOCUMENT"]


def test_stored_documents_count(spark):
    stored = [("u", "a"), ("u", "old")]
    got = outcomes(spark, [(1, 1, 1, 3, 0), (2, 1, 1, 3, 1)], [(1, "u", "a", None), (2, "u", "b", None)], stored)
    assert (got[1].outcome, got[1].candidate_status) == ("UNCHANGED", "SKIPPED") and (got[2].outcome, got[2].version, got[2].candidate_status) == ("CREATED_NEW_VERSION", 3, "FETCHED")


def test_failures_store_nothing_and_retry(spark):
    got = outcomes(spark, [(1, 1, 1, 2, 0), (2, 1, 2, 2, 1), (3, 1, 1, 3, 2), (4, None, 3, 3, 3), (5, 9, 1, 3, 4), (6, 1, 1, 3, 5)],
                   [(1, "u", "a", "network unavailable"), (2, "u", "a", "network unavailable"), (3, "u", "a", None), (4, "u", "z", None), (5, "u", "z", None), (3, "u", "b", None)])
    assert {i: r.outcome for i, r in got.items()} == {1: "FAILED", 2: "FAILED", 3: "CREATED", 4: "FAILED", 5: "FAILED", 6: "FAILED"}
    assert (got[1].job_status, str(got[1].retry_at), got[1].candidate_status) == ("PENDING", "2026-08-18 10:01:00", "PENDING")
    assert (got[2].job_status, got[2].retry_at, got[2].candidate_status, got[2].error_message) == ("FAILED", None, "FAILED", "network unavailable")
    assert [got[i].error_message for i in (4, 5, 6)] == ["FETCH_URL jobs require a URL candidate.", "FETCH_URL job references an unknown URL candidate.", "Unknown ingestion error."]


def test_folds_equal_one_job_at_a_time(spark):
    rng = random.Random(4)
    started = [(i, 1, 1, 3, rng.randint(0, 30)) for i in range(200)]
    responses = [(i, f"u{rng.randint(0, 5)}", f"h{rng.randint(0, 9)}", "bad" if rng.random() < 0.1 else None) for i in range(200)]
    stored = list({(f"u{rng.randint(0, 5)}", f"h{rng.randint(0, 9)}") for _ in range(8)})
    known, expected = list(stored), {}
    by_job = {r[0]: r for r in responses}
    for i, *_ in sorted(started, key=lambda s: (s[4], s[0])):
        _, u, h, error = by_job[i]
        if error:
            expected[i] = ("FAILED", None)
        elif (u, h) in known:
            expected[i] = ("UNCHANGED", None)
        else:
            n = sum(k[0] == u for k in known) + 1
            expected[i] = ("CREATED_NEW_VERSION" if n > 1 else "CREATED", n)
            known.append((u, h))
    assert {i: (r.outcome, r.version) for i, r in outcomes(spark, started, responses, stored).items()} == expected


# ---------------------------------------------------------------- transitions
CLAIMS = "id string, subject_id string, predicate string, object_id string, connection_class string, status string, valid_from string, valid_to string, literal_value string"


def people(spark):
    entities = spark.createDataFrame([("p", "PERSON", "Jane Example", "jane"), ("o", "PARTY", "Example Party", "party"), ("l", "LOCATION", "Bern", "bern")], "id string, entity_type string, canonical_name string, slug string")
    return entities, spark.createDataFrame([("MEMBER_OF", "PERSON", "PARTY"), ("PRESIDENT_OF", "PERSON", "PARTY")], "predicate string, subject_type string, object_type string")


def claim(i, subject="p", predicate="MEMBER_OF", obj="o", status="PENDING_REVIEW", start=None, end=None, literal=None):
    return (i, subject, predicate, obj, "DIRECT", status, start, end, literal)


def test_transitions_are_judged_at_their_place(spark):
    entities, compatible = people(spark)
    claims = spark.createDataFrame([claim("good"), claim("bare"), claim("late"), claim("unfit", subject="l"), claim("self", obj="p"), claim("dates", start="2021-01-01", end="2020-01-01"), claim("literal", obj=None, literal="{}"), claim("noshape", obj=None), claim("none", subject="x")], CLAIMS)
    evidence = spark.createDataFrame([(i, 0) for i in ("good", "unfit", "self", "dates", "literal", "noshape", "none")] + [("late", 5), ("late", 7)], "claim_id string, seq int")
    log = [(i, 1, "VERIFIED", "r1") for i in ("good", "bare", "late", "unfit", "self", "dates", "literal", "noshape", "none", "missing")]
    log += [("late", 4, "REJECTED", "r2"), ("late", 5, "VERIFIED", "r3"), ("good", 2, "DISPUTED", "r2"), ("good", 3, "OUTDATED", "r2"), ("bare", 2, "REJECTED", "r1"), ("bare", 3, "VERIFIED", "r1")]
    judged = review.transitions(claims, spark.createDataFrame(log, "claim_id string, seq int, to_status string, actor_id string"), entities, compatible, evidence)
    refused = {(r.claim_id, r.seq): r.reason for r in judged.where("reason is not null").collect()}
    assert refused == {
        ("bare", 1): "A claim cannot be verified without evidence.", ("bare", 3): "A claim cannot be verified without evidence.", ("late", 1): "A claim cannot be verified without evidence.",
        ("unfit", 1): "Claim predicate is incompatible with the subject or object entity type.", ("self", 1): "A claim cannot relate an entity to itself.", ("dates", 1): "Date range must start before it ends.",
        ("literal", 1): "Literal claims are not publishable graph relationships yet.", ("noshape", 1): "A claim needs either an object entity or a literal value.", ("none", 1): "Claim subject entity does not exist.", ("missing", 1): "Claim does not exist."}
    state = {r.id: (r.status, r.reviewed_by, r.n_transitions) for r in review.current_state(claims, judged).collect()}
    untouched = ("PENDING_REVIEW", None, 0)
    assert state == {"good": ("OUTDATED", "r2", 3), "bare": ("REJECTED", "r1", 1), "late": ("VERIFIED", "r3", 2)} | dict.fromkeys(("unfit", "self", "dates", "literal", "noshape", "none"), untouched)
    audit = [(r.claim_id, r.action, json.loads(r.old_value)["verificationStatus"], json.loads(r.new_value)["verificationStatus"]) for r in review.audit(judged).orderBy("claim_id", "seq").collect()]
    assert audit == [("bare", "CLAIM_REJECTED", "PENDING_REVIEW", "REJECTED"), ("good", "CLAIM_VERIFIED", "PENDING_REVIEW", "VERIFIED"), ("good", "CLAIM_DISPUTED", "VERIFIED", "DISPUTED"), ("good", "CLAIM_OUTDATED", "DISPUTED", "OUTDATED"), ("late", "CLAIM_REJECTED", "PENDING_REVIEW", "REJECTED"), ("late", "CLAIM_VERIFIED", "REJECTED", "VERIFIED")]
    value = json.loads(review.audit(judged).where("claim_id = 'good' and seq = 1").first().new_value)
    assert value == {"predicate": "MEMBER_OF", "connectionClass": "DIRECT", "verificationStatus": "VERIFIED", "subjectEntityId": "p", "objectEntityId": "o"}


def test_folded_logs_give_the_same_state(spark):
    """Sound and unsound claims, with late, early and no evidence, in any order of their log; unknown claims, null steps and evidence of no claim."""
    rng = random.Random(3)
    entities, compatible = people(spark)
    made = [claim(f"c{i}", rng.choice(("p", "p", "p", "l", "x", None)), rng.choice(("MEMBER_OF", "OWNS")) if i % 5 == 0 else "MEMBER_OF", rng.choice(("o", "o", "o", "p", None)), start=rng.choice((None, "2020-06-01", "2021-01-01")), end=rng.choice((None, "2020-12-31")), literal=rng.choice((None, "{}"))) for i in range(120)]
    claims = spark.createDataFrame(made, CLAIMS)
    evidence = spark.createDataFrame([(f"c{rng.randrange(140)}", rng.randrange(9)) for _ in range(150)] + [(None, 1), ("c1", None)], "claim_id string, seq int")
    log = [(f"c{rng.randrange(130)}", s, rng.choice(("VERIFIED", "VERIFIED", "REJECTED", "OUTDATED", None)), f"r{s % 3}") for s in range(300)] + [(None, 1, "VERIFIED", "r"), ("c2", None, "VERIFIED", "r")]
    events = spark.createDataFrame([(c, s if s is None else s % 10, t, a) for c, s, t, a in dict.fromkeys(log)], "claim_id string, seq int, to_status string, actor_id string")
    key = lambda r: (r.id, r.status, r.reviewed_by or "", r.n_transitions)
    for proof in (evidence, evidence.drop("seq")):
        expected = review.current_state(claims, review.transitions(claims, events, entities, compatible, proof))
        got = review.reviewed(claims, events, entities, compatible, proof)
        assert sorted(map(key, got.collect())) == sorted(map(key, expected.collect())) and got.columns == expected.columns
        assert got.where("status = 'VERIFIED'").count() > 1


def test_cited_documents_are_told_apart_in_small_parts(spark, monkeypatch):
    """A task that reads evidence keeps no table of its pairs: they are told apart in parts by claim, more of them for more evidence."""
    monkeypatch.setattr(written, "DEALT", 20)
    df = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    evidence = df([(f"c{i % 30}", f"d{i % 7}" if i % 11 else None) for i in range(100)] * 2 + [(None, "d1")], "claim_id string, document_id string")
    documents, tasks = df([(f"d{i}",) for i in range(5)] + [(None,)], "id string"), df([("t1", "d1", "OPEN"), ("t2", "d1", "RESOLVED"), ("t3", "d4", "OPEN"), ("t9", "d6", "OPEN")], "id string, document_id string, status string")
    candidates, entities = df([("t1", "a", 0.5), ("t1", "b", 0.75)], "task_id string, entity_id string, score double"), df([("a", "Anna")], "id string, canonical_name string")
    got = review.review_resolution(evidence, documents, tasks, candidates, entities)
    lists = {"t1": [("b", None, 0.75), ("a", "Anna", 0.5)], "t2": [], "t3": []}
    cited = {(f"c{i % 30}", i % 7) for i in range(100) if i % 11} | {(None, 1)}
    expected = [(c, t, s, lists[t]) for c, d in cited for t, at, s in (("t1", 1, "OPEN"), ("t2", 1, "RESOLVED"), ("t3", 4, "OPEN")) if d == at]
    key = lambda r: (r[0] or "", r[1])
    assert sorted([(r.claim_id, r.task_id, r.status, [tuple(c) for c in r.candidates]) for r in got.collect()], key=key) == sorted(expected, key=key)
    assert written.parted(evidence, "claim_id").rdd.getNumPartitions() == 21
    plan = got._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(claim_id" in plan and not [x for x in plan.splitlines() if "Exchange hashpartitioning(claim_id" in x and "document_id" in x and "REPARTITION" not in x]


# --------------------------------------------------------------------- merges
def test_merges_go_on(spark):
    """A into B into C; a merge of the target that came before takes nothing along; a second merge of a source moves what came later only."""
    rng = random.Random(7)
    for _ in range(3):
        names = [f"e{i}" for i in range(12)]
        merges = [(rng.choice(names), rng.choice(names), s) for s in rng.sample(range(100), 14)]
        ends = [(f"c{i}", rng.choice(names), rng.choice(names)) for i in range(20)]
        now = {c: [s, o] for c, s, o in ends}
        for source, target, _ in sorted(merges, key=lambda m: m[2]):
            for pair in now.values():
                pair[:] = [target if x == source else x for x in pair]
        claims = spark.createDataFrame([(c, s, "OWNS", o) for c, s, o in ends], "id string, subject_id string, predicate string, object_id string")
        got = review.merge_entities(claims, spark.createDataFrame(merges, "source_id string, target_id string, seq int"))
        assert {r.id: [r.subject_id, r.object_id] for r in got.collect()} == now
    chain = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("x", "y", 9), ("y", "z", 8)], "source_id string, target_id string, seq int")
    assert {(r.id, r.target_id) for r in review.final_targets(chain).collect()} == {("a", "c"), ("b", "c"), ("x", "y"), ("y", "z")}


# --------------------------------------------------------------------- drafts
def test_drafts_of_drafts(spark):
    df = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    drafts = {
        "sources": df([("s1", "One"), ("s2", " ")], "id string, name string"),
        "documents": df([("d1", "s1", "http://a"), ("d2", "s2", "http://b"), ("d3", "s0", ""), ("d4", None, "http://c"), ("d5", "s0", "http://d")], "id string, source_id string, original_url string"),
        "crawl_runs": df([("r1", "s1", "2024-01-02", "2024-01-01"), ("r2", "s1", "2024-01-02", None), ("r3", "no", "2024-01-02", "2024-01-01")], "id string, source_id string, started_at string, finished_at string"),
        "crawl_schedules": df([("h1", "s1", ["http://a"]), ("h2", "s1", []), ("h3", "s1", ["http://a", " "]), ("h4", "s2", [])], "id string, source_id string, discovery_urls array<string>"),
        "url_candidates": df([("u1", "s1", "r2", "http://a", "http://a"), ("u2", "s1", "r1", "http://a", "http://a"), ("u3", "s1", None, "http://a", ""), ("u4", "s1", "", "x", "y")], "id string, source_id string, crawl_run_id string, original_url string, canonical_url string"),
        "ingestion_jobs": df([("j1", "s1", "u1", None, 0, 3), ("j2", "s1", "u2", None, 0, 3), ("j3", "s1", None, "d2", 0, 3), ("j4", "s1", None, "d1", -1, 0), ("j5", "s1", None, "d5", 0, 0)], "id string, source_id string, url_candidate_id string, document_id string, attempts int, max_attempts int"),
    }
    told = admission.admit(drafts, {"sources": df([("s0",)], "id string")})
    reasons = {r.id: r.reason for r in told.collect()}
    assert reasons == {
        "s1": None, "s2": "name must not be empty.", "d1": None, "d2": "Cannot create a document for an unknown source.", "d3": "originalUrl must not be empty.", "d4": "Cannot create a document for an unknown source.", "d5": None,
        "r1": "crawl run finishedAt must be after startedAt.", "r2": None, "r3": "Cannot create a crawl run for an unknown source.",
        "h1": None, "h2": "Crawl schedules require at least one discovery URL.", "h3": "discoveryUrl must not be empty.", "h4": "Cannot create a crawl schedule for an unknown source.",
        "u1": None, "u2": "Cannot create a URL candidate for an unknown crawl run.", "u3": "canonicalUrl must not be empty.", "u4": None,
        "j1": None, "j2": "Cannot create an ingestion job for an unknown URL candidate.", "j3": "Cannot create an ingestion job for an unknown document.", "j4": "Ingestion job attempts cannot be negative.", "j5": "Ingestion jobs require at least one allowed attempt."}
    assert all(r.accepted == (r.reason is None) for r in told.collect())


def test_circles_and_chains_of_drafts(spark):
    """What waits for itself is never made, nor what refers to it; a chain is made in any order of its rows."""
    chain = [(f"c{i}", "p", f"c{i - 1}" if i else None) for i in range(6)]
    odd = [("x", "p", "y"), ("y", "p", "x"), ("z", "p", "x"), ("own", "p", "own"), ("gone", "p", "nowhere"), ("after", "p", "gone"), ("old", "p", "stored")]
    claims = spark.createDataFrame(chain[::-1] + odd, "id string, subject_id string, supersedes_id string")
    stored = {"entities": spark.createDataFrame([("p",)], "id string"), "claims": spark.createDataFrame([("stored",)], "id string")}
    got = {r.id: r.accepted for r in admission.admit({"claims": claims}, stored).collect()}
    assert got == {c: True for c, *_ in chain} | dict.fromkeys(("x", "y", "z", "own", "gone", "after"), False) | {"old": True}
    assert admission.admit({"claims": claims.limit(0)}, stored).count() == 0


def test_drafts_are_met_once(spark, monkeypatch):
    """Only ids, places and references of drafts that others ask for are written, however many checks they have; rounds write what waits alone."""
    kept = []
    monkeypatch.setattr(admission, "written", lambda df: kept.append(df.localCheckpoint()) or kept[-1])
    chain = [(f"c{i}", "p" if i % 4 else "q", f"c{i - 1}" if i else None) for i in range(1, 9)] + [("c0", "p", ""), (None, "p", None), ("twice", "p", "no"), ("twice", "p", None), ("of", "p", "twice")]
    claims = spark.createDataFrame(chain, "id string, subject_id string, supersedes_id string")
    entities = spark.createDataFrame([("p", "P", "p"), ("q", "Q", " ")], "id string, canonical_name string, slug string")
    got = sorted((r.table, r.id or "", r.reason or "") for r in admission.admit({"claims": claims, "entities": entities}, {}).collect())
    unknown, before = "Claim subject entity does not exist.", "Claim does not exist."
    assert got == sorted(
        [("entities", "p", ""), ("entities", "q", "slug must not be empty."), ("claims", "", ""), ("claims", "twice", ""), ("claims", "twice", before), ("claims", "of", "")]
        + [("claims", f"c{i}", "" if i < 4 else before if i % 4 else unknown) for i in range(9)])
    assert [(df.columns, df.count()) for df in kept] == [(["id", "place", "up"], 2), (["id"], 1), (["id", "place", "up"], 13), (["up", "id", "met"], 8), (["up", "id", "met"], 6), (["up", "id", "met"], 5), (["up", "id", "met"], 4)]


# ---------------------------------------------------------------------- edits
TABLES = {
    "claims": "id string, status string, supersedes_id string, reviewed_by string, subject_id string, predicate string, object_id string, connection_class string, valid_from string, valid_to string",
    "evidence": "id string, claim_id string, document_id string, evidence_text string", "audit": "id string, seq long, step int, action string, entity_id string, actor_id string", "queue": "id string, claim_id string, status string",
}
EDITS = "id string, claim_id string, seq int, actor_id string, subject_id string, predicate string, object_id string, connection_class string, valid_from string, valid_to string, literal_value string"
PROOF = "claim_id string, document_id string, evidence_text string, start_char int, end_char int"


def edited(spark, store, edits, proof):
    entities, compatible = people(spark)
    documents = spark.createDataFrame([("d",)], "id string")
    drafts = spark.createDataFrame(proof, PROOF)
    judged = review.edit_verdicts(spark.createDataFrame(edits, EDITS), drafts, store.snapshot("claims"), entities, compatible, documents)
    return judged, review.edit_changes(judged, drafts, store.snapshot("claims"), store.snapshot("queue"))


def test_an_edit_changes_all_tables_at_once(spark, tmp_path):
    entities, compatible = people(spark)
    store = ChangeSets(spark, f"file://{tmp_path}/store", TABLES)
    first = spark.createDataFrame([("old", "VERIFIED", None, "reviewer-1", "p", "MEMBER_OF", "o", "DIRECT", None, None), ("open", "PENDING_REVIEW", None, None, "p", "MEMBER_OF", "o", "DIRECT", None, None)], TABLES["claims"])
    store.commit({"claims": first, "evidence": spark.createDataFrame([("e", "old", "d", "Jane is a member.")], TABLES["evidence"]), "queue": spark.createDataFrame([("q", "old", "ASSIGNED"), ("r", "open", "OPEN")], TABLES["queue"])})
    edit = lambda i, of, seq=1, obj="o", predicate="PRESIDENT_OF", end="2024-12-31": (i, of, seq, "reviewer-2", "p", predicate, obj, "HISTORICAL", "2020-01-01", end, "{}")
    proof = lambda i, text=" Jane Example was president. ", document="d", start=None, end=None: (i, document, text, start, end)
    edits = [edit("new", "old"), edit("second", "old", 2), edit("bare", "old", 0), edit("lost", "none"), edit("early", "open"), edit("unfit", "old", 0, predicate="LOCATED_IN"), edit("dates", "old", 0, end="2019-01-01"), edit("literal", "old", 0, obj=None), edit("blank", "old", 0), edit("nodoc", "old", 0), edit("span", "old", 0)]
    proofs = [proof(i) for i in ("new", "second", "lost", "early", "unfit", "dates", "literal")] + [proof("blank", "  "), proof("nodoc", document="x"), proof("span", start=5, end=4)]
    judged, rows = edited(spark, store, edits, proofs)
    assert {r.id: r.reason for r in judged.collect()} == {
        "new": None, "second": "Only verified claims can be superseded.", "bare": "Edited verified claims require replacement evidence.", "lost": "Claim does not exist.", "early": "Only verified claims can be superseded.",
        "unfit": "Claim predicate is incompatible with the subject or object entity type.", "dates": "Date range must start before it ends.", "literal": "Literal claims are not publishable graph relationships yet.",
        "blank": "evidenceText must not be empty.", "nodoc": "Cannot add evidence from an unknown document.", "span": "startChar must be before or equal to endChar."}
    # A writer that dies after staging leaves nothing that readers see.
    store.stage(rows)
    assert store.version() == 1 and store.snapshot("claims").where("id = 'new'").isEmpty() and store.snapshot("audit").isEmpty()
    store.commit(rows, base=1)
    claims = {r.id: r for r in store.snapshot("claims").collect()}
    assert (claims["old"].status, claims["old"].predicate, claims["open"].status) == ("OUTDATED", "MEMBER_OF", "PENDING_REVIEW")
    assert (claims["new"].status, claims["new"].supersedes_id, claims["new"].predicate, claims["new"].connection_class, claims["new"].reviewed_by) == ("VERIFIED", "old", "PRESIDENT_OF", "HISTORICAL", "reviewer-2") and len(claims) == 3
    assert [(r.action, r.entity_id) for r in store.snapshot("audit").orderBy("seq", "step").collect()] == [("CLAIM_OUTDATED", "old"), ("CLAIM_SUPERSEDED", "new"), ("CLAIM_VERIFIED", "new")]
    assert {(r.id, r.status) for r in store.snapshot("queue").collect()} == {("q", "RESOLVED"), ("r", "OPEN")}
    assert {(r.claim_id, r.evidence_text) for r in store.snapshot("evidence").collect()} == {("old", "Jane is a member."), ("new", "Jane Example was president.")}
    shown = graph.publishable(store.snapshot("claims"), entities.withColumn("canton", F.lit("x")), compatible)
    assert [r.id for r in shown.collect()] == ["new"]
    assert {r.id for r in store.snapshot("claims", 1).collect()} == {"old", "open"}
    # The second of two writers that read one version has to read again.
    with pytest.raises(Conflict):
        store.commit({"queue": store.snapshot("queue")}, base=1)
    assert store.compact() == 3 and {r.id for r in store.snapshot("claims").collect()} == {"old", "open", "new"}
    assert store.commit({"queue": spark.createDataFrame([("r", "open", "RESOLVED")], TABLES["queue"])}) == 4
    assert {(r.id, r.status) for r in store.snapshot("queue").collect()} == {("q", "RESOLVED"), ("r", "RESOLVED")}


def test_edits_made_are_those_without_a_reason(spark):
    """Any mixture of refusals; rows of the changes are the same, too."""
    entities, compatible = people(spark)
    draw = random.Random(4)
    claims = spark.createDataFrame([(f"c{i}", draw.choice(["VERIFIED", "VERIFIED", "OUTDATED"])) for i in range(40)], "id string, status string")
    some = lambda *values: draw.choice(values)
    edits = spark.createDataFrame([(f"x{i}", some(f"c{i % 50}", f"c{i % 7}", None), draw.randrange(9), "a", some("p", "p", "p", "gone", None, "o"), some("MEMBER_OF", "MEMBER_OF", "LOCATED_IN"), some("o", "o", "o", "p", None, "gone"), "DIRECT", some("2020", None), some("2021", None, "2019"), some("{}", None)) for i in range(400)], EDITS)
    drafts = spark.createDataFrame([(some(f"x{i % 420}", f"x{i % 420}", None), some("d", "d", "d", "d", "none"), some("Text", "Text", "Text", " ", None), some(1, None), some(2, 2, None, 0)) for i in range(500)], PROOF)
    rest = (drafts, claims, entities, compatible, spark.createDataFrame([("d",)], "id string"))
    expected = review.edit_verdicts(edits, *rest).where("reason is null").drop("reason")
    made = review.edits_made(edits, *rest)
    assert sorted(map(str, made.collect())) == sorted(map(str, expected.collect())) and made.count() > 3
    changes = [review.edit_changes(j, drafts, claims.withColumns({c: F.lit(None).cast("string") for c in ("subject_id", "predicate", "object_id", "connection_class", "valid_from", "valid_to")}), spark.createDataFrame([("q", "c1", "OPEN")], "id string, claim_id string, status string")) for j in (made, review.edit_verdicts(edits, *rest))]
    assert all(sorted(map(str, changes[0][t].collect())) == sorted(map(str, changes[1][t].collect())) for t in ("claims", "evidence", "audit", "queue"))


def test_a_path_is_put_once(spark, tmp_path):
    path = f"file://{tmp_path}/a/m.json"
    assert put_if_absent(spark, path, "one") and not put_if_absent(spark, path, "two")
    assert open(f"{tmp_path}/a/m.json").read() == "one" and [p.name for p in (tmp_path / "a").iterdir() if not p.name.endswith(".crc")] == ["m.json"]


# ---------------------------------------------------------------- containment
def test_contained_names_by_brute_force(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice("ab c") for _ in range(rng.randint(0, 9))) for _ in range(120)]
    asked = spark.createDataFrame([("x" if i % 2 else "y", i, n) for i, n in enumerate(names)], "block string, asked_id int, inner string")
    held = asked.toDF("block", "held_id", "outer")
    got = sorted(tuple(r) for r in resolution.contained(asked, held).collect())
    assert got == sorted((i, j) for i, a in enumerate(names) for j, b in enumerate(names) if a and a in b and i % 2 == j % 2)


def test_hot_blocks_are_parted_and_best_suffice(spark):
    """Blocks of more entities than a part holds lose no pair; the two best candidates are there without all of a block."""
    rng = random.Random(6)
    entities = [(f"e{i:02}", "PERSON", f"{rng.choice('ABC')} {rng.choice('XYZ')}{i % 4}", rng.choice(("ZH", "BE")), "CH", rng.choice(("p", "q", None))) for i in range(60)]
    mentions = [(f"m{i}", "PERSON", f"{rng.choice('ABC')} {rng.choice('XYZ')}{i % 4}", rng.choice(("ZH", None)), "CH", rng.choice(("p", None))) for i in range(40)]
    e = spark.createDataFrame(entities, "id string, entity_type string, canonical_name string, canton string, country string, party string")
    m = spark.createDataFrame(mentions, "mention_id string, entity_type string, name string, canton string, country string, party string")
    aliases = spark.createDataFrame([("e01", "A X1")], "entity_id string, alias string")
    key = lambda df: {(r.mention_id, r.entity_id, r.score, r.rank) for r in df.collect()}
    whole = key(resolution.candidates(m, e, aliases))
    assert {x for x in key(resolution.candidates(m, e, aliases, best=2)) if x[3] <= 2} == {x for x in whole if x[3] <= 2}
    keyed = lambda df, i: df.select("entity_type", i, F.col("country").alias("key"))
    met = resolution._met(keyed(m, "mention_id"), keyed(e.withColumnRenamed("id", "entity_id"), "entity_id"), part=7)
    assert met.count() == met.distinct().count() == 60 * 40


# --------------------------------------------------------------------- pacing
def test_slots_by_brute_force(spark):
    """One host holds most requests, so its ranges carry on; null hosts are a host."""
    rng = random.Random(9)
    rows = [(rng.choice(("hot",) * 8 + ("a", "b", None)), i, rng.choice((rng.randint(0, 400_000), 5000))) for i in range(600)]
    expected, free = [], {}
    for host, i, at in sorted(rows, key=lambda r: (r[2], r[1])):
        start = max(at, free.get(host, 0))
        free[host] = start + 6000
        expected.append((host, i, at, start))
    got = jobs.host_slots(spark.createDataFrame(rows, "host string, id int, at_ms long"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
    assert jobs.host_slots(spark.createDataFrame([], "host string, id int, at_ms long")).count() == 0
