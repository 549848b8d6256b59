"""Calls of language-model providers: strict output contracts, the run wrapper, and the log of runs.

Only the call itself is Python.  Answers are VARIANT values; contracts are expressions over them, put together from checks that
each give the places that break them and the value as it is read.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ontology import CONNECTION_CLASSES, ENTITY_TYPES, PREDICATES


@dataclass(frozen=True)
class Check:
    """``errors(value, path)``: an array of texts, each a place and what is wrong there; ``read(value)``: what is kept of a sound value."""

    errors: Callable[[Column, Column], Column]
    read: Callable[[Column], Column]


_NONE = "array<string>"


def _kind(value: Column) -> Column:
    """The first character of a value's JSON: it tells strings, numbers, objects, arrays, flags and null apart."""
    return F.left(F.to_json(value), F.lit(1))


def _as(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def _at(path: Column, name: Column) -> Column:
    return F.when(path == "", name).otherwise(F.concat(path, F.lit("."), name))


def _complain(path: Column, what: str | Column) -> Column:
    return F.array(F.concat(F.when(path == "", "<root>").otherwise(path), F.lit(": "), F.lit(what) if isinstance(what, str) else what))


def _unless(sound: Column, path: Column, what: str) -> Column:
    return F.when(F.coalesce(sound, F.lit(False)), F.array().cast(_NONE)).otherwise(_complain(path, what))


def _simple(sound: Callable[[Column], Column], what: str, read: Callable[[Column], Column]) -> Check:
    return Check(lambda v, path: _unless(sound(v), path, what), read)


def _is_number(v: Column) -> Column:
    return _kind(v).rlike("[-0-9]")


text = _simple(lambda v: (_kind(v) == '"') & F.regexp_like(_as(v, "string"), F.lit(r"\S")), "expected a non-empty string", lambda v: F.regexp_replace(_as(v, "string"), r"^\s+|\s+$", ""))
flag = _simple(lambda v: _kind(v).isin("t", "f"), "expected a boolean", lambda v: _as(v, "boolean"))
share = _simple(lambda v: _is_number(v) & _as(v, "double").between(0, 1), "expected a number from 0 to 1", lambda v: v)
#: By form alone: no calendar is asked.
day = _simple(lambda v: (_kind(v) == '"') & _as(v, "string").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "Expected YYYY-MM-DD date.", lambda v: _as(v, "string"))
anything = Check(lambda v, path: F.array().cast(_NONE), lambda v: v)
mapping = _simple(lambda v: _kind(v) == "{", "expected an object", lambda v: v)


def one_of(*choices: str) -> Check:
    return _simple(lambda v: (_kind(v) == '"') & _as(v, "string").isin(*choices), "expected one of " + ", ".join(choices), lambda v: _as(v, "string"))


def many(of: Check) -> Check:
    items = lambda v: _as(v, "array<variant>")

    def errors(v: Column, path: Column) -> Column:
        return F.when(F.coalesce(_kind(v) == "[", F.lit(False)), F.flatten(F.transform(items(v), lambda x, i: of.errors(x, _at(path, i.cast("string")))))).otherwise(_complain(path, "expected an array"))

    return Check(errors, lambda v: F.transform(items(v), of.read))


def record(needed: dict[str, Check], optional: dict[str, Check] | None = None, defaults: dict[str, str] | None = None, rule: tuple[Callable[[Column], Column], str] | None = None) -> Check:
    """An object of exactly these keys: unknown ones are refused; ``defaults`` are JSON texts."""
    fields = needed | (optional or {})
    field = lambda v, name: F.try_variant_get(v, f"$.{name}", "variant")

    def errors(v: Column, path: Column) -> Column:
        keys = F.coalesce(F.json_object_keys(F.to_json(v)), F.array().cast(_NONE))
        told = [F.when(F.array_contains(keys, n), c.errors(field(v, n), _at(path, F.lit(n)))).otherwise(F.array().cast(_NONE)) for n, c in fields.items()]
        unknown = F.flatten(F.transform(F.array_except(keys, F.array(*[F.lit(n) for n in fields])), lambda k: _complain(path, F.concat(F.lit("unknown key "), k))))
        absent = [F.when(F.array_contains(keys, n), F.array().cast(_NONE)).otherwise(_complain(_at(path, F.lit(n)), "required")) for n in needed]
        whole = F.concat(*told, unknown, *absent)
        if rule:
            whole = F.transform(F.array(whole), lambda e: F.when((F.size(e) > 0) | rule[0](v), e).otherwise(_complain(path, rule[1])))[0]
        return F.when(F.coalesce(_kind(v) == "{", F.lit(False)), whole).otherwise(_complain(path, "expected an object"))

    def read(v: Column) -> Column:
        def one(n: str, c: Check) -> Column:
            found = c.read(field(v, n))
            if n in (defaults or {}):
                found = F.when(field(v, n).isNull(), c.read(F.parse_json(F.lit(defaults[n])))).otherwise(found)
            return found.alias(n)

        return F.struct(*[one(n, c) for n, c in fields.items()])

    return Check(errors, read)


_ENTITY = record({"local_id": text, "type": one_of(*ENTITY_TYPES), "name": text, "evidence": text}, {"aliases": many(text), "metadata": mapping}, {"aliases": "[]", "metadata": "{}"})
_CANDIDATE = record({"entity_id": text, "score": share}, {"signals": many(text)}, {"signals": "[]"})
_RESOLUTION = record({"local_id": text, "candidates": many(_CANDIDATE), "manual_review_required": flag}, {"reason": text})
_RELATION = record(
    {"subject_entity_id": text, "predicate": one_of(*PREDICATES), "connection_class": one_of(*CONNECTION_CLASSES), "evidence_text": text, "confidence": share, "requires_review": flag},
    {"object_entity_id": text, "literal_value": anything, "valid_from": day, "valid_to": day},
    rule=(lambda v: F.coalesce(F.array_size(F.array_intersect(F.json_object_keys(F.to_json(v)), F.array(F.lit("object_entity_id"), F.lit("literal_value")))) > 0, F.lit(False)), "A relation needs either object_entity_id or literal_value."),
)
#: Operation: schema version (a fixed value), contract, and the key that its summary counts.
CONTRACTS: dict[str, tuple[str, Check, str | None]] = {
    "extractEntities": ("entity-extraction.v1", record({"entities": many(_ENTITY)}), "entities"),
    "resolveEntityCandidates": ("entity-resolution.v1", record({"resolutions": many(_RESOLUTION)}), "resolutions"),
    "extractClaims": ("claim-extraction.v1", record({"relations": many(_RELATION)}), "relations"),
    "validateClaim": ("claim-validation.v1", record({"result": one_of("SUPPORTED", "CONTRADICTED", "INSUFFICIENT")}, {"rationale": text}), None),
}
_COUNTS = {"entities": "entityCount", "resolutions": "resolutionCount", "relations": "relationCount"}


def parsed(answers: DataFrame, operation: str) -> DataFrame:
    """``answers`` (answer: JSON text) with errors, an array of what breaks the operation's contract, and output, what the contract reads
    (a struct, with defaults filled in; null with any error).  What is no JSON breaks it at its root."""
    check = CONTRACTS[operation][1]
    told = answers.withColumn("value", F.try_parse_json("answer"))
    told = told.withColumn("errors", check.errors(F.col("value"), F.lit("")))
    return told.withColumn("output", F.when(F.size("errors") == 0, check.read(F.col("value")))).drop("value")


def _summary(operation: str) -> Column:
    """What the log keeps of an output: a count or the result, never text."""
    key = CONTRACTS[operation][2]
    if key:
        return F.concat(F.lit(f'{{"{_COUNTS[key]}": '), F.size(f"output.{key}").cast("string"), F.lit("}"))
    return F.concat(F.lit('{"result": "'), F.col("output.result"), F.lit('"}'))


def _input_summary(given: Column) -> Column:
    """What the log keeps of an input: ids and the text's length."""
    def string(path: str) -> Column:
        v = F.try_variant_get(given, path, "variant")
        return F.when(_kind(v) == '"', _as(v, "string"))

    inner = F.coalesce(_kind(F.try_variant_get(given, "$.document", "variant")) == "{", F.lit(False))
    quoted = lambda name, value: F.concat(F.lit(f'"{name}": "'), F.regexp_replace(value, r'(["\\])', r"\\$1"), F.lit('"'))
    found = [quoted("documentId", F.when(inner, string("$.document.id")).otherwise(string("$.documentId"))), quoted("claimId", F.when(inner, string("$.claim.id"))), F.concat(F.lit('"textLength": '), F.length(F.when(inner, string("$.document.extractedText"))).cast("string"))]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*found)), ", "), F.lit("}"))


RUN = ("request_id", "operation", "provider", "model", "prompt_version", "schema_version", "temperature", "input_hash", "input_summary", "status", "output", "output_summary", "error_message")


def run(requests: DataFrame, operation: str, provider: Callable[[dict], object], name: str, model: str, prompt_version: str, temperature: float = 0.0) -> DataFrame:
    """One RUN row for each of ``requests`` (request_id, input as JSON), SUCCEEDED with its output (JSON) or FAILED with why.

    ``provider`` is called once for each input that is JSON, on the executors; an error of one is that row's alone.  The hash is that of the
    input's text.  The output is what the contract reads; the log of runs is the row without it.
    """
    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers, failures = [], []
            for given in batch["input"]:
                answer = failure = None
                try:
                    answer = json.dumps(provider(json.loads(given)))
                except Exception as error:  # whatever a provider raises is the row's outcome
                    failure = str(error)
                answers.append(answer)
                failures.append(failure)
            yield batch.assign(answer=answers, failure=failures)

    kind = requests.schema["request_id"].dataType.simpleString()
    sound = requests.select("request_id", "input").where(F.try_parse_json("input").isNotNull())
    answered = sound.mapInPandas(call, f"request_id {kind}, input string, answer string, failure string")
    broken = requests.select("request_id", "input", F.lit(None).cast("string").alias("answer"), F.lit("The input is no JSON.").alias("failure")).where(F.try_parse_json("input").isNull())
    told = parsed(answered.unionByName(broken), operation)
    error = F.coalesce("failure", F.when(F.size("errors") > 0, F.array_join("errors", "; ")))
    given = F.try_parse_json("input")
    return told.select(
        "request_id", *[F.lit(v).alias(n) for n, v in (("operation", operation), ("provider", name), ("model", model), ("prompt_version", prompt_version), ("schema_version", CONTRACTS[operation][0]), ("temperature", float(temperature)))],
        F.when(given.isNotNull(), F.sha2("input", 256)).alias("input_hash"), F.when(given.isNotNull(), _input_summary(given)).alias("input_summary"), F.when(error.isNull(), "SUCCEEDED").otherwise("FAILED").alias("status"),
        F.when(error.isNull(), F.to_json("output")).alias("output"), F.when(error.isNull(), _summary(operation)).alias("output_summary"), error.alias("error_message"),
    )
