"""Requests and responses of the public interface: filters as text, results as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ontology import CONNECTION_CLASSES, ENTITY_TYPES, PREDICATES

#: Parameters of a request for the graph.
PARAMETERS = ("entity_id", "entity_type", "predicate", "connection_class", "topic", "person", "organization", "organisation", "date_from", "date_to", "include_historical")
_CHOICES = {"entity_type": ENTITY_TYPES, "predicate": PREDICATES, "connection_class": CONNECTION_CLASSES}


def is_iso_date(text: Column) -> Column:
    """Whether ``text`` is a day of the calendar as YYYY-MM-DD."""
    return F.coalesce(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & text.try_cast("date").isNotNull(), F.lit(False))


def parse_filters(requests: DataFrame) -> DataFrame:
    """``requests`` (PARAMETERS, as strings; others are kept) with filters, a struct of read values, and errors, an array in order.

    Blank parameters count as absent; organization is read before its other spelling.  With any error, filters is null.
    """
    given = {p: F.when(F.trim(p) != "", F.trim(p)) for p in PARAMETERS}
    errors, read = [], {"entity_id": given["entity_id"]}
    for name, choices in _CHOICES.items():
        read[name] = given[name]
        errors.append(F.when(~given[name].isin(*choices), f"{name} must be one of: {', '.join(choices)}."))
    read |= {"topic": given["topic"], "person": given["person"], "organisation": F.coalesce(given["organization"], given["organisation"])}
    sound = {}
    for name in ("date_from", "date_to"):
        sound[name] = F.when(is_iso_date(given[name]), given[name])
        read[name] = sound[name]
        errors.append(F.when(given[name].isNotNull() & sound[name].isNull(), f"{name} must use YYYY-MM-DD format."))
    errors.append(F.when(sound["date_from"] > sound["date_to"], "date_from must be before or equal to date_to."))
    flag = given["include_historical"]
    read["include_historical"] = F.when(flag.isin("true", "1"), True).when(flag.isin("false", "0"), False)
    errors.append(F.when(flag.isNotNull() & read["include_historical"].isNull(), "include_historical must be true or false."))
    told = requests.withColumn("errors", F.array_compact(F.array(*errors)))
    return told.withColumn("filters", F.when(F.size("errors") == 0, F.struct(*[v.alias(n) for n, v in read.items()])))


def bad_request(parsed: DataFrame) -> DataFrame:
    """``parsed`` with the status, 200 or 400, and the body of a refusal."""
    body = F.to_json(F.struct(F.lit("Invalid public graph filters.").alias("error"), F.col("errors").alias("details")))
    refused = F.size("errors") > 0
    return parsed.withColumn("status", F.when(refused, 400).otherwise(200)).withColumn("body", F.when(refused, body))


def detail(asked: DataFrame, found: DataFrame, what: str) -> DataFrame:
    """(id, status, body) of asked ids: the found row (id, body as a struct) as JSON, or 404."""
    missing = F.to_json(F.struct(F.lit(f"Public {what} not found.").alias("error")))
    joined = asked.select("id").join(found.select("id", F.to_json("body").alias("body")), "id", "left")
    return joined.select("id", F.when(F.col("body").isNull(), 404).otherwise(200).alias("status"), F.coalesce("body", missing).alias("body"))


def answered(asked: DataFrame, load, what: str) -> DataFrame:
    """``detail`` of what ``load()`` finds (id, body); 503 with the reason for every asked id if it cannot be read.

    What is missing or unreadable shows when its schema is asked for; a job that fails later fails as any other.
    """
    try:
        found = load()
        found.schema  # noqa: B018
    except Exception as e:  # whatever the store says
        body = F.to_json(F.struct(F.lit(f"Public {what} API is unavailable.").alias("error"), F.lit(str(e).split("\n")[0]).alias("details")))  # fixed value
        return asked.select("id", F.lit(503).alias("status"), body.alias("body"))
    return detail(asked, found, what)
