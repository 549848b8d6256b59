"""Schedules, jobs, candidates, document versions and crawl runs as projections and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..written import written


def backoff_minutes(attempts: Column) -> Column:
    """Doubling from one minute, an hour at most."""
    return F.least(F.lit(60), F.pow(F.lit(2.0), F.greatest(F.lit(0), attempts - 1)).cast("long")).cast("long")


def next_run(at: Column, frequency: Column) -> Column:
    """The next run in UTC.  A month later overflows: January 31 leads into March, time of day kept."""
    month = F.add_months(F.trunc(at.cast("date"), "MM"), 1)
    monthly = (F.date_add(month, F.day(at) - 1).cast("timestamp_ntz") + (at - F.date_trunc("DAY", at).cast("timestamp_ntz")))
    return (
        F.when(frequency == "HOURLY", at + F.expr("INTERVAL 1 HOUR"))
        .when(frequency == "DAILY", at + F.expr("INTERVAL 1 DAY"))
        .when(frequency == "WEEKLY", at + F.expr("INTERVAL 7 DAY"))
        .when(frequency == "MONTHLY", monthly)
    )


def due_jobs(jobs: DataFrame, kind: str, as_of: str, limit: int = 5) -> DataFrame:
    """The oldest PENDING jobs of a kind; the limit comes before the test of attempts, as it must."""
    due = jobs.where((F.col("job_kind") == kind) & (F.col("status") == "PENDING") & (F.col("scheduled_at") <= F.lit(as_of).cast("timestamp_ntz")))
    return due.orderBy("scheduled_at", "id").limit(limit).where("attempts < max_attempts")


def batch_limit(asked: object) -> int:
    """The limit of a batch that a caller asks for: a whole number from 1 to 10, 1 if it is none."""
    try:
        return max(1, min(10, int(float(asked))))
    except (TypeError, ValueError, OverflowError):
        return 1


def due_schedules(schedules: DataFrame, as_of: str) -> DataFrame:
    """ACTIVE schedules (id, status, frequency, next_run_at) due at ``as_of``, with their run and the next one after it."""
    at = F.lit(as_of).cast("timestamp_ntz")
    due = schedules.where((F.col("status") == "ACTIVE") & (F.col("next_run_at") <= at))
    return due.select("*", at.alias("last_run_at"), next_run(at, F.col("frequency")).alias("following_run_at")).orderBy("next_run_at")


def transition(jobs: DataFrame, events: DataFrame, as_of: str) -> DataFrame:
    """Jobs after one event each (id, event: start, complete, skip or fail; error_message), with error where it is refused.

    Starting needs a PENDING job with attempts left, and uses one; the other events need a RUNNING job.  A failed job waits
    for its backoff, or is FAILED after the last attempt.  A refused event leaves the job as it was.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    e = events.select("id", "event", F.col("error_message").alias("told"))
    j = jobs.join(e, "id", "left")
    running, event = F.col("status") == "RUNNING", F.col("event")
    refused = (  # fixed values
        F.when((event == "start") & (F.col("status") != "PENDING"), "Only pending ingestion jobs can be started.")
        .when((event == "start") & (F.col("attempts") >= F.col("max_attempts")), "Ingestion job has no retry attempts remaining.")
        .when(event.isin("complete", "skip") & ~running, "Only running ingestion jobs can be completed.")
        .when((event == "fail") & ~running, "Only running ingestion jobs can fail.")
    )
    again = F.col("attempts") < F.col("max_attempts")
    wait = now + F.make_dt_interval(F.lit(0), F.lit(0), backoff_minutes(F.col("attempts")).cast("int"))
    acted = event.isNotNull() & refused.isNull()

    def after(column: str, changed: Column) -> Column:
        return F.when(acted, changed).otherwise(F.col(column)).alias(column)

    status = F.when(event == "start", "RUNNING").when(event == "complete", "SUCCEEDED").when(event == "skip", "SKIPPED").otherwise(F.when(again, "PENDING").otherwise("FAILED"))
    ended = event.isin("complete", "skip") | ((event == "fail") & ~again)
    return j.select(
        "id", after("status", status), after("attempts", F.col("attempts") + F.when(event == "start", 1).otherwise(0)), after("scheduled_at", F.when((event == "fail") & again, wait).otherwise(F.col("scheduled_at"))),
        F.when(acted & ended, now).alias("finished_at"), F.when(acted & (event == "start"), now).alias("locked_at"),
        after("error_message", F.when(event == "fail", F.col("told")).when(event == "start", F.lit(None)).otherwise(F.col("error_message"))), refused.alias("error"),
    )


def failed(jobs: DataFrame, as_of: str) -> DataFrame:
    """RUNNING ``jobs`` after a failing attempt."""
    events = jobs.select("id", F.lit("fail").alias("event"), F.lit("failed").alias("error_message"))
    return transition(jobs, events, as_of).select("id", "attempts", "status", "scheduled_at")


def create_or_reuse(wanted: DataFrame, jobs: DataFrame, key: str, active_only: bool) -> DataFrame:
    """(key, job_kind, job_id, reused) of wanted jobs (key, job_kind): one that is there, or a new one with a derived id.

    A fetch job is reused while it is active; a document's job whatever its status.  The least id counts.
    """
    there = jobs.where(F.col("status").isin("PENDING", "RUNNING")) if active_only else jobs
    first = there.where(F.col(key).isNotNull()).groupBy(key, "job_kind").agg(F.min("id").alias("found"))
    joined = wanted.select(key, "job_kind").distinct().join(first, [key, "job_kind"], "left")
    return joined.select(key, "job_kind", F.coalesce(F.col("found").cast("string"), F.concat_ws(":", "job_kind", F.col(key).cast("string"))).alias("job_id"), F.col("found").isNotNull().alias("reused"))


def fetch_outcomes(jobs: DataFrame, candidates: DataFrame, responses: DataFrame, stored: DataFrame, as_of: str) -> DataFrame:
    """What becomes of a batch of started fetch jobs (id, url_candidate_id, attempts, max_attempts, scheduled_at), one row each.

    candidates: id, crawl_run_id; responses: id of the job, canonical_url after redirects, content_hash, error (the least of several
    counts); stored: canonical_url, content_hash of documents.  The batch is worked through by scheduled_at and id, and each job sees what
    the jobs before it stored: a hash of the url that is known by then is UNCHANGED and skips the rest; else the document is CREATED, or a
    CREATED_NEW_VERSION of the url, with its number, and extraction and analysis jobs follow.  A failing item fails alone, and its
    candidate only after the last attempt; so does a job without a candidate or without a response.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    c = candidates.select(F.col("id").alias("url_candidate_id"), "crawl_run_id", F.lit(True).alias("has_candidate"))
    r = responses.groupBy("id").agg(F.min(F.struct("canonical_url", "content_hash", "error")).alias("r")).select("id", "r.*")
    j = jobs.join(c, "url_candidate_id", "left").join(r, "id", "left")
    error = (  # fixed values
        F.when(F.col("url_candidate_id").isNull(), "FETCH_URL jobs require a URL candidate.")
        .when(F.col("has_candidate").isNull(), "FETCH_URL job references an unknown URL candidate.")
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("content_hash").isNull() | F.col("canonical_url").isNull(), "Unknown ingestion error.")
    )
    told = j.withColumn("error_message", error).withColumn("turn", F.struct("scheduled_at", "id"))
    # A url's new hashes in the order of their first jobs: one row for each, before any window, however many jobs a url has.
    known = stored.select("canonical_url", "content_hash").distinct()
    first = told.where("error_message is null").groupBy("canonical_url", "content_hash").agg(F.min("turn").alias("first")).join(known, ["canonical_url", "content_hash"], "left_anti")
    before = stored.groupBy("canonical_url").agg(F.count(F.lit(1)).alias("n_stored"))
    number = F.row_number().over(Window.partitionBy("canonical_url").orderBy("first")) + F.coalesce("n_stored", F.lit(0))
    made = first.join(before, "canonical_url", "left").select("canonical_url", "content_hash", "first", number.cast("long").alias("made"))
    told = told.join(made, ["canonical_url", "content_hash"], "left")
    makes = F.col("turn") == F.col("first")
    outcome = F.when(F.col("error_message").isNotNull(), "FAILED").when(makes & (F.col("made") == 1), "CREATED").when(makes, "CREATED_NEW_VERSION").otherwise("UNCHANGED")
    told = told.withColumn("outcome", outcome)
    retry = F.col("attempts") < F.col("max_attempts")
    bad, changed = F.col("outcome") == "FAILED", F.col("outcome").isin("CREATED", "CREATED_NEW_VERSION")
    wait = now + F.make_dt_interval(F.lit(0), F.lit(0), backoff_minutes(F.col("attempts")).cast("int"))
    return told.select(
        "id", "url_candidate_id", "crawl_run_id", "outcome", F.when(changed, F.col("made")).alias("version"), "error_message",
        F.when(bad & retry, "PENDING").when(bad, "FAILED").when(changed, "SUCCEEDED").otherwise("SKIPPED").alias("job_status"),
        F.when(bad & retry, wait).alias("retry_at"),
        F.when(bad & retry, "PENDING").when(bad, "FAILED").when(changed, "FETCHED").otherwise("SKIPPED").alias("candidate_status"),
        F.when(changed, F.array(F.lit("EXTRACT_DOCUMENT"), F.lit("ANALYZE_DOCUMENT"))).otherwise(F.array().cast("array<string>")).alias("follow_up_jobs"),
    )


def latest(changes: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The latest row of each key among appended changes."""
    return changes.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def document_versions(fetched: DataFrame) -> DataFrame:
    """(id, url, hash, outcome, version) of fetches (id, url, hash, at).

    A known hash of the url: UNCHANGED.  Else a known url: CREATED_NEW_VERSION.  Else CREATED.
    """
    seen = Window.partitionBy("url", "hash").orderBy("at", "id")
    fresh = (F.row_number().over(seen) == 1).cast("long")
    marked = fetched.withColumn("fresh", fresh)
    run = Window.partitionBy("url").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = marked.withColumn("version", F.sum("fresh").over(run))
    outcome = F.when(F.col("fresh") == 0, "UNCHANGED").when(F.col("version") == 1, "CREATED").otherwise("CREATED_NEW_VERSION")
    return marked.select("id", "url", "hash", outcome.alias("outcome"), "version")


def url_candidates(found: DataFrame) -> DataFrame:
    """One candidate of each (source_id, canonical_url), the latest details, and how often it was discovered if repeated."""
    return found.groupBy("source_id", "canonical_url").agg(
        F.max_by("title", F.struct("at", "id")).alias("title"),
        F.when(F.count(F.lit(1)) > 1, F.count(F.lit(1))).alias("discovery_count"),
        F.lit("PENDING").alias("status"),
    )


def crawl_run_stats(runs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Runs (run_id, status) with the counters of their items (run_id, outcome) and the status after them.

    An item that failed for good counts as failed, any other as fetched; changed ones are those that gave a document.  FAILED stays,
    then any failure is PARTIAL, else the status is as it was.
    """
    bad, changed = F.col("outcome") == "FAILED", F.col("outcome").isin("CREATED", "CREATED_NEW_VERSION")
    counted = outcomes.groupBy("run_id").agg(F.count_if(~bad).alias("fetched"), F.count_if(changed).alias("changed"), F.count_if(bad).alias("failed"))
    n = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    status = F.when(F.col("status") == "FAILED", "FAILED").when(F.col("failed") > 0, "PARTIAL").otherwise(F.col("status"))
    return runs.join(counted, "run_id", "left").select("run_id", n("fetched"), n("changed"), n("failed"), status.alias("status"))


def write_extraction(documents: DataFrame, drafts: DataFrame) -> DataFrame:
    """Documents (id, title, text, metadata map) after extraction drafts (id, title, text, description, metadata): drafts overwrite,
    with nothing clearing what was there; metadata is merged, later keys winning, with the description among it."""
    d = drafts.select("id", F.struct("title", "text", "description", "metadata").alias("draft"))
    joined = documents.join(d, "id", "left")
    none = F.create_map().cast("map<string,string>")
    described = F.when(F.col("draft.description") != "", F.create_map(F.lit("extractedDescription"), F.col("draft.description"))).otherwise(none)

    def over(base: Column, more: Column) -> Column:
        return F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(more), k)), more)

    merged = over(over(F.coalesce("metadata", none), described), F.coalesce("draft.metadata", none))
    drafted = F.col("draft").isNotNull()
    return joined.select("id", F.when(drafted, F.col("draft.title")).otherwise(F.col("title")).alias("title"), F.when(drafted, F.col("draft.text")).otherwise(F.col("text")).alias("text"), F.when(drafted, merged).otherwise(F.col("metadata")).alias("metadata"))


def host_slots(requests: DataFrame, per_minute: int = 10) -> DataFrame:
    """When each request (host, id, at_ms) may start: hosts are paced at equal intervals.

    slot_i = max(at_i, slot_(i-1) + gap) unrolls to gap * i + max over j <= i of (at_j - gap * j), which is a running count and a running
    maximum.  Requests are dealt into ranges by host and time, so that a hot host is several ranges; each range tells its count and
    maximum of each of its hosts, and takes those of the ranges before it as a carry.
    """
    gap = 60_000 // per_minute
    parts = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(requests.select("host", "id", "at_ms").repartitionByRange(parts, "host", "at_ms", "id").withColumn("range", F.spark_partition_id()))
    inside = Window.partitionBy("range", "host").orderBy("at_ms", "id")
    here = ranged.withColumn("i", F.row_number().over(inside)).withColumn("lead", F.max(F.col("at_ms") - gap * F.col("i")).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    told = here.groupBy("range", "host").agg(F.max("i").alias("n"), F.max("lead").alias("most"))
    earlier = Window.partitionBy("host").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = told.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    carried = before.select(F.col("range").alias("r"), F.col("host").alias("h"), "before", F.max(F.col("most") - gap * F.col("before")).over(earlier).alias("carry"))
    joined = here.join(carried, (F.col("range") == F.col("r")) & F.col("host").eqNullSafe(F.col("h")))
    start = gap * (F.col("before") + F.col("i")) + F.greatest(F.col("lead") - gap * F.col("before"), "carry")
    return joined.select("host", "id", "at_ms", start.cast("long").alias("start_ms"))
