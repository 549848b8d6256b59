"""Secret scanning through a trigram inverted index, in DataFrame functions alone.

A Boolean trigram query is derived from each rule's parsed regular expression: an OR over its alternatives of
the AND of the trigrams that a match must hold.  The index is a written table of posting lists, keyed by trigram and segment, of the
trigrams that the rules ask for; a segment is a few thousand rows, so no list has more.  An alternative's lists are intersected, the
alternatives' results united, and only these candidates are verified with the regular
expression.  A rule whose matches have no mandatory trigram (the hex rule: any digits) scans all rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import row_key, settle


@dataclass(frozen=True)
class Rule:
    """One kind of secret; ``part``: the group of the pattern of which ``least`` characters are asked for."""

    kind: str
    pattern: str
    least: int
    part: int = 0


_NAME = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
#: Fixed patterns of the contract, in the order of its kinds.
RULES = (
    Rule("assign", f"{_NAME}[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8, 1),
    Rule("access", "(AKIA[A-Z0-9]+)", 16, 1),
    Rule("hex", "([0-9a-f]+)", 32, 1),
)


#: Keys of a segment of the index, more or less.
SEGMENT = 4096
#: Strings that a part of a pattern may stand for, up to which they are enumerated; and characters of a class.
ENUMERATED, CLASS = 64, 4


def trigrams(literal: str) -> frozenset[str]:
    """The trigrams that any text with ``literal`` holds."""
    return frozenset(literal[i : i + 3] for i in range(len(literal) - 2))


def _least(sets: list[frozenset[str]]) -> list[frozenset[str]]:
    """The alternatives that no other one makes needless."""
    kept = [x for x in dict.fromkeys(sets) if not any(y < x for y in sets)]
    return [frozenset()] if frozenset() in kept else kept


def _members(items: list) -> set[str] | None:
    """The characters of a class, if they are few."""
    out: set[str] = set()
    for kind, value in items:
        if kind is sre.LITERAL:
            out.add(chr(value))
        elif kind is sre.RANGE and value[1] - value[0] < CLASS:
            out.update(map(chr, range(value[0], value[1] + 1)))
        else:
            return None
    return out if len(out) <= CLASS else None


def _read(parsed, fold: bool) -> tuple[set[str] | None, list[frozenset[str]]]:
    """Of a parsed pattern: all the strings it stands for, if they are few, and its trigram query."""
    exact: set[str] = {""}
    query: list[frozenset[str]] = [frozenset()]
    whole = True

    def both(a, b):
        return _least([x | y for x, y in product(a, b)])

    def end_run() -> None:
        nonlocal exact, query, whole
        query, exact, whole = both(query, _least([trigrams(x) for x in exact])), {""}, False

    for kind, value in parsed:
        told: set[str] | None = None
        inner: list[frozenset[str]] = [frozenset()]
        if kind is sre.LITERAL:
            told = {chr(value)}
        elif kind is sre.IN:
            told = _members(value)
        elif kind is sre.SUBPATTERN:
            told, inner = _read(value[-1], fold)
        elif kind is sre.BRANCH:
            parts = [_read(x, fold) for x in value[1]]
            inner = _least([q for _, query_ in parts for q in query_])
            if all(x is not None for x, _ in parts):
                told = set().union(*(x for x, _ in parts))
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, sub = value
            some, inner = _read(sub, fold)
            if (low, high) == (0, 1) and some is not None:
                told, inner = some | {""}, [frozenset()]
            elif low == 0:
                inner = [frozenset()]
        if told is not None and fold:
            told = {x.lower() for x in told}
        if told is not None and len(told) * len(exact) <= ENUMERATED:
            exact = {x + y for x, y in product(exact, told)}
        else:
            end_run()
            query = both(query, inner if told is None else _least([trigrams(x) for x in told]))
    if whole:
        return exact, _least([trigrams(x) for x in exact])
    end_run()
    return None, query


def folds(rule: Rule) -> bool:
    """Whether the pattern takes letters in either case."""
    return any(a != b and a.lower() == b.lower() for a, b in re.findall(r"\[(\w)(\w)\]", rule.pattern))


def query_of(rule: Rule) -> list[frozenset[str]]:
    """The rule's Boolean query, derived from its pattern: any of these sets has to be there as a whole; none: no query."""
    query = _read(parser.parse(rule.pattern), folds(rule))[1]
    return [] if frozenset() in query else sorted(query, key=sorted)


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, kind, end) of the rule's matches, in code points, end exclusive.

    The pieces between matches, and the matches, alternate; their lengths add up to positions.
    """
    pattern = F.lit(rule.pattern)
    whole, part = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.part))
    between = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))
    matches = F.arrays_zip(whole.alias("w"), part.alias("p"), F.slice(between, 1, F.size(whole)).alias("b"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind_order:int,kind:string,end:int>>").alias("out"))

    def step(state: Column, m: Column) -> Column:
        begin = state["at"] + m["b"]
        end = begin + F.length(m["w"])
        span = F.struct(begin.alias("start"), F.lit(order).alias("kind_order"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.length(m["p"]) >= rule.least, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    return F.aggregate(matches, start, step, lambda s: s["out"])


def _quick(rule: Rule) -> Rule:
    """The same rule with its least length in the pattern, found faster, where that gives the same spans.

    That holds for ``(literal[class]+)`` with the literal in the class: a match is then the rest of a maximal run.
    """
    plain = re.fullmatch(r"\((\w*)(\[[^\]^]+\])\+\)", rule.pattern)
    if not plain or rule.part != 1 or rule.least <= len(plain[1]) or not re.fullmatch(f"{plain[2]}*", plain[1]):
        return rule
    return Rule(rule.kind, f"({plain[1]}{plain[2]}{{{rule.least - len(plain[1])},}})", rule.least, 1)


def terms(rules: tuple[Rule, ...] = RULES) -> list[str]:
    """The trigrams that the queries of ``rules`` name, marked ``=`` as they are and ``~`` where letters fold."""
    return sorted({("~" if folds(r) else "=") + t for r in rules for s in query_of(r) for t in s})


def index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Posting lists (segment, trigram, rows) of the trigrams that ``rules`` ask for; docs has k and text.

    A segment is a share of the keys, about SEGMENT of them; repeated rows have one key and are one posting.
    """
    segments = -(-docs.count() // SEGMENT) or 1
    lower = F.lower("text")
    held = [F.when(F.contains(lower if t[0] == "~" else F.col("text"), F.lit(t[1:])), F.lit(t)) for t in terms(rules)]
    posted = docs.select("k", F.pmod("k", F.lit(segments)).alias("segment"), F.explode(F.array_compact(F.array(*held) if held else F.array().cast("array<string>"))).alias("trigram"))
    return settle(posted.groupBy("segment", "trigram").agg(F.collect_set("k").alias("rows")))


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(k, the kinds whose Boolean query the row meets): in each segment the posting lists of an alternative's trigrams are
    intersected, shorter lists first, and the alternatives united."""
    none = F.array().cast("array<long>")
    lists = postings.groupBy("segment").agg(*[F.first(F.when(F.col("trigram") == t, F.col("rows")), ignorenulls=True).alias(t) for t in terms(rules)])

    def both(names: list[str]) -> Column:
        ordered = F.array_sort(F.array(*[F.struct(F.size(F.coalesce(F.col(f"`{n}`"), none)).alias("n"), F.coalesce(F.col(f"`{n}`"), none).alias("rows")) for n in names]))
        return F.aggregate(F.slice(ordered, 2, len(names)), ordered[0]["rows"], lambda met, x: F.array_intersect(met, x["rows"])) if len(names) > 1 else F.coalesce(F.col(f"`{names[0]}`"), none)

    def of_kind(kind: str):
        return lambda k: F.struct(k.alias("k"), F.lit(kind).alias("kind"))

    met = []
    for r in rules:
        if sets := query_of(r):
            united = none
            for s in sets:
                united = F.array_union(united, both([("~" if folds(r) else "=") + t for t in sorted(s)]))
            met.append(F.transform(united, of_kind(r.kind)))
    if not met:
        return postings.select(F.col("segment").alias("k"), F.array().cast("array<string>").alias("kinds")).limit(0)
    return lists.select(F.explode(F.concat(*met)).alias("m")).groupBy("m.k").agg(F.collect_set("m.kind").alias("kinds"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """All secrets of each row of ``docs`` (doc_id, text): its ``keep`` columns and ``found``, an array of
    (start, kind_order, kind, end) in code points, end exclusive, by start and then kind.

    Null and empty texts have none.  Repeated rows are scanned each; null doc_ids stay.  A text of any
    length is scanned whole; an empty table gives an empty result.  Matches of one rule are leftmost and do not overlap; rules may overlap.
    """
    base = docs.select(*[F.col(c).alias(f"__{c}") for c in keep], F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("k", row_key(*(f"__{c}" for c in keep if c != "text"), "text"))
    met = candidates(index(base, rules), rules)
    joined = base.join(met, "k", "left")
    none = F.array().cast("array<struct<start:int,kind_order:int,kind:string,end:int>>")
    spans = []
    for order, rule in enumerate(rules):
        quick = _quick(rule)
        verify = F.array_contains(F.coalesce("kinds", F.array().cast("array<string>")), rule.kind) if query_of(rule) else F.col("text").rlike(quick.pattern)
        spans.append(F.when(verify, _spans(F.col("text"), quick, order)).otherwise(none))
    return joined.select(*[F.col(f"__{c}").alias(c) for c in keep], F.array_sort(F.concat(*spans)).alias("found"))


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_<kind> for each rule, base_sha256 and spans; see ``scan``."""
    found = scan(docs, rules)

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(r.kind) for r in rules]
    listed = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *counts, listed.alias("spans")).withColumn("base_sha256", F.sha2("spans", 256))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret's span replaced by ``mark``; overlapping spans become one mark."""
    names = docs.columns
    found = scan(docs, rules, tuple(names))
    text = F.coalesce(F.col("text"), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        piece = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(fresh, F.concat(state["out"], piece, F.lit(mark))).otherwise(state["out"]).alias("out"))

    clean = F.aggregate("found", start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return found.select(*[F.when(F.size("found") > 0, clean).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in names])
