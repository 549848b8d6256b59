"""Admission of drafts that refer to stored records and to one another: own checks, and reference checks table by table, those of a table to itself in rounds."""

from __future__ import annotations

from dataclasses import dataclass
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..written import written


@dataclass(frozen=True)
class Own:
    """A check of a draft alone: ``failed`` is SQL over its columns."""

    failed: str
    reason: str


@dataclass(frozen=True)
class Refers:
    """A check that the record named in ``column`` is there; null or empty names none, which only ``needed`` refuses."""

    column: str
    table: str
    reason: str
    needed: bool = True


def _blank(column: str) -> Own:
    name = "".join(w.title() if i else w for i, w in enumerate(column.split("_")))
    return Own(f"coalesce(trim({column}), '') = ''", f"{name} must not be empty.")


#: What is asked of a draft of each table, in this order; the wording is fixed.
RULES: dict[str, tuple[Own | Refers, ...]] = {
    "sources": (_blank("name"),),
    "entities": (_blank("canonical_name"), _blank("slug")),
    "entity_aliases": (
        _blank("alias"), Own("valid_from > valid_to", "validFrom must be before or equal to validTo."),
        Refers("entity_id", "entities", "Cannot create an alias for an unknown entity."), Refers("source_id", "sources", "Cannot create an alias from an unknown source.", needed=False),
    ),
    "documents": (_blank("original_url"), Refers("source_id", "sources", "Cannot create a document for an unknown source.")),
    "crawl_runs": (Refers("source_id", "sources", "Cannot create a crawl run for an unknown source."), Own("finished_at < started_at", "crawl run finishedAt must be after startedAt.")),
    "crawl_schedules": (
        Refers("source_id", "sources", "Cannot create a crawl schedule for an unknown source."), Own("coalesce(size(discovery_urls), 0) < 1", "Crawl schedules require at least one discovery URL."),
        Own("exists(discovery_urls, u -> coalesce(trim(u), '') = '')", "discoveryUrl must not be empty."),
    ),
    "url_candidates": (
        _blank("original_url"), _blank("canonical_url"), Refers("source_id", "sources", "Cannot create a URL candidate for an unknown source."),
        Refers("crawl_run_id", "crawl_runs", "Cannot create a URL candidate for an unknown crawl run.", needed=False),
    ),
    "ingestion_jobs": (
        Refers("source_id", "sources", "Cannot create an ingestion job for an unknown source."), Refers("crawl_run_id", "crawl_runs", "Cannot create an ingestion job for an unknown crawl run.", needed=False),
        Refers("url_candidate_id", "url_candidates", "Cannot create an ingestion job for an unknown URL candidate.", needed=False), Refers("document_id", "documents", "Cannot create an ingestion job for an unknown document.", needed=False),
        Own("attempts < 0", "Ingestion job attempts cannot be negative."), Own("max_attempts < 1", "Ingestion jobs require at least one allowed attempt."),
    ),
    "claims": (Refers("subject_id", "entities", "Claim subject entity does not exist."), Refers("object_id", "entities", "Claim object entity does not exist.", needed=False), Refers("supersedes_id", "claims", "Claim does not exist.", needed=False)),
}


def _order() -> list[str]:
    """The tables of RULES, each after those that it refers to; one that refers to itself does so by its last check alone."""
    for table, rules in RULES.items():
        if any(isinstance(r, Refers) and r.table == table for r in rules[:-1]):
            raise ValueError(f"{table} refers to itself before its last check")
    return list(TopologicalSorter({t: {r.table for r in rules if isinstance(r, Refers)} - {t} for t, rules in RULES.items()}).static_order())


def _checked(table: str, drafts: DataFrame, there: dict[str, DataFrame]) -> DataFrame:
    """(id, place, up) of the drafts of a table: the place of the first check that fails (null: none), and the record of the own table that is asked for.

    References that a rule names and ``drafts`` lacks are null.  ``there`` has the ids of other tables' records, each once.
    """
    rules = list(enumerate(RULES[table]))
    refs = {i: r for i, r in rules if isinstance(r, Refers)}
    full = drafts.select("*", *[F.lit(None).cast("string").alias(c) for c in sorted({r.column for r in refs.values()} - set(drafts.columns))])
    ref = {i: F.nullif(F.col(r.column).cast("string"), F.lit("")) for i, r in refs.items()}
    alone = [F.when(F.coalesce(F.expr(r.failed), F.lit(False)) if isinstance(r, Own) else ref[i].isNull() & F.lit(r.needed), i) for i, r in rules]
    told = full.select(F.col("id").cast("string").alias("id"), F.coalesce(*alone).alias("place"), *[c.alias(f"ref{i}") for i, c in ref.items()])
    up = F.lit(None).cast("string")
    for i, r in refs.items():
        if r.table == table:
            up = F.col(f"ref{i}")
            continue
        known = F.lit(None)
        if r.table in there:
            told = told.join(there[r.table].select(F.col("id").alias(f"ref{i}"), F.lit(True).alias(f"there{i}")), f"ref{i}", "left")
            known = F.col(f"there{i}")
        told = told.withColumn("place", F.least("place", F.when(F.col(f"ref{i}").isNotNull() & known.isNull(), i)))
    return told.select("id", "place", up.alias("up"))


def _along(checked: DataFrame, place: int, stored: DataFrame | None) -> DataFrame:
    """(id, place) of drafts that may wait for one of their own table: ``place`` is that check's.

    Each round meets what still waits with the ids that the round before accepted, and writes it with what it met, so rounds are as
    many as references are deep.  Drafts that wait for each other in a circle can never be made, nor can what refers to them.
    """
    told = checked.where("place is not null or up is null").select("id", "place")
    waiting = checked.where("place is null and up is not null").select("id", "up")
    ready = checked.where("place is null and up is null").select("id")
    ids = ready if stored is None else ready.unionByName(stored)
    while True:
        met = written(waiting.join(ids.distinct().select(F.col("id").alias("up"), F.lit(True).alias("met")), "up", "left"))
        ids, waiting = met.where("met").select("id"), met.where("met is null").select("id", "up")
        told = told.unionByName(ids.withColumn("place", F.lit(None).cast("int")))
        if ids.isEmpty() or waiting.isEmpty():
            return told.unionByName(waiting.select("id", F.lit(place).alias("place")))


def admit(drafts: dict[str, DataFrame], stored: dict[str, DataFrame]) -> DataFrame:
    """(table, id, accepted, reason) of ``drafts`` beside ``stored`` records, both by table; stored ones need an id alone.

    A draft is accepted once its own checks hold and all that it refers to is stored or accepted; the rest is refused, with the first
    check of its order that fails.  Tables are judged after those that they refer to, so a reference is met once, with final ids.
    A draft with the id of a stored record changes nothing for others; of several with one id any accepted one counts.
    """
    there = {t: df.select(F.col("id").cast("string").alias("id")) for t, df in stored.items()}
    asked = {r.table for t in drafts for r in RULES[t] if isinstance(r, Refers) and r.table != t}
    known = {t: written(df.distinct()) for t, df in there.items() if t in asked - set(drafts)}
    out = None
    for table in (t for t in _order() if t in drafts):
        checked = _checked(table, drafts[table], known)
        last = RULES[table][-1]
        if isinstance(last, Refers) and last.table == table:
            checked = _along(written(checked), len(RULES[table]) - 1, there.get(table))
        elif table in asked:
            checked = written(checked)
        if table in asked:
            ids = checked.where("place is null").select("id")
            known[table] = written((ids.unionByName(there[table]) if table in there else ids).distinct())
        reason = F.coalesce(*[F.when(F.col("place") == i, r.reason) for i, r in enumerate(RULES[table])])
        told = checked.select(F.lit(table).alias("table"), "id", F.col("place").isNull().alias("accepted"), reason.alias("reason"))
        out = told if out is None else out.unionByName(told)
    return out
