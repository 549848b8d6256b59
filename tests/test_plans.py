"""Plans that read and join a table once, and that write nothing that one query alone would read."""

import __spark_entry__ as entry
from claimweave.operators import graph, validation

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def uses(spark, name, word):
    return plan(entry.queries()[name](spark, SF)).count(word)


def test_edges_meet_their_entities_once(spark):
    # Both entities, compatible types, documents, their sources and evidence; before, the joins with entities were done twice, and timelines did all twice.
    for name in ("graph_edges", "research_view", "timeline", "entity_timeline"):
        assert uses(spark, name, "Join ") - uses(spark, "claim_evidence_full", "Join ") == 4


def test_edits_are_judged_once(spark):
    # Both entities, compatible types, evidence and its documents, and the claim, beside four in the given evidence; before, twice and joined with themselves.
    assert uses(spark, "edit_verdicts", "Join ") == 6 + 4


def test_what_is_named_once_is_not_written(spark):
    for name in ("predicate_compat", "claim_admission"):
        assert uses(spark, name, "l_orderkey") > 0


def test_documents_are_sent_only_if_counted_and_few(spark, monkeypatch):
    docs = spark.createDataFrame([("d1", "s1")], "id string, source_id string")
    drafts = spark.createDataFrame([("d1", "x", 1, 2, True), ("d2", "x", 1, 2, True)], "document_id string, evidence_text string, start_char int, end_char int, c boolean")
    few = validation.evidence_refusals(drafts, docs)
    monkeypatch.setattr(graph, "SENT", 0)
    many = validation.evidence_refusals(drafts, docs)
    assert "strategy=broadcast" in plan(few) and "strategy=broadcast" not in plan(many)
    assert sorted(few.collect()) == sorted(many.collect()) and many.where("reason is null").count() == 1


def test_entities_of_relations_are_not_sent_through_the_driver(spark):
    plan = entry.queries()["claim_validate"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [subject_id" in plan and "SortMergeJoin [object_id" in plan
