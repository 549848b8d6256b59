"""URL functions as native expressions: canonical form, storage paths, robots, fetch classification."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Query parameters that never count, of trackers and of mobile variants.
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid", "msclkid")
MOBILE = ("amp", "amp_js_v", "usqp")
LANGUAGE = ("lang", "language", "locale")


def _text(x: str) -> Column:
    return F.lit(x)


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def canonical(url: Column, keep_language: bool = True, international: bool = False) -> Column:
    """The canonical form of an http(s) url; null for other schemes and for what is no url.

    Scheme and host in lower case, no default port or fragment; dot segments resolved, no empty path segments, no amp or print segment
    at either end, no trailing slash; parameters without tracking and print ones, sorted by key and value as a reader would sort them.
    Path and parameters are percent-encoded anew as browsers do.  Hosts beyond ASCII are null, or Punycode if ``international``: that alone
    needs Python, and only for such hosts.
    """
    plain = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20\u00A0]+|[\x00-\x20\u00A0]+$", ""), r"[\t\n\r]", "")
    if not international:
        return bound(plain, lambda u: _canonical(u, F.lit(None).cast("string"), keep_language))
    name = _name(_authority(plain))
    coded = _punycode(F.when(name.rlike(_BEYOND), name))
    return bound(F.struct(plain.alias("u"), coded.alias("coded")), lambda x: _canonical(x["u"], x["coded"], keep_language))


#: The characters that paths, and hosts, hold as they are.
_IN_PATH = r"^[!$%&'()*+,\-./0-9:;=@A-Z\[\]\\_a-z|~]*$"
_BEYOND = r"[^\x00-\x7F]"
_NO_HOST = r"[\x00-\x20#%/:<>?@\[\\\]^|\x7F]"


def _in_path(text: Column) -> Column:
    """``text`` with what a path cannot hold percent-encoded; what is encoded already stays."""
    coded = F.transform(F.split(text, ""), lambda c: F.when(c.rlike(_IN_PATH), c).when(c == " ", "%20").otherwise(F.url_encode(c)))
    return F.when(text.rlike(_IN_PATH), text).otherwise(F.array_join(coded, ""))


def _decoded(text: Column) -> Column:
    """A key or value of a form: plus signs are spaces; a percent sign that encodes nothing stands for itself."""
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


@F.pandas_udf(StringType())
def _punycode(hosts: pd.Series) -> pd.Series:
    def one(host: str | None) -> str | None:
        if host is None:
            return None
        labels = re.split("[.\u3002\uff0e\uff61]", unicodedata.normalize("NFKC", host).lower())
        try:
            return ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in labels)
        except UnicodeError:
            return None

    return hosts.map(one)


def _head(url: Column) -> Column:
    """What comes before parameters and fragment, with slashes alone."""
    return F.replace(F.regexp_extract(url, r"^([^?#]*)", 1), F.lit("\\"), F.lit("/"))


def _authority(url: Column) -> Column:
    return F.regexp_extract(_head(url), r"(?i)^https?:/*([^/]*)", 1)


def _name(authority: Column) -> Column:
    """The host's name as it is written, decoded and in lower case, without user and port."""
    place = F.regexp_replace(authority, "^.*@", "")
    return F.lower(F.url_decode(F.regexp_replace(F.replace(F.regexp_replace(place, r":[^:\]]*$", ""), F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")))


def _host(authority: Column, coded: Column, default: Column) -> Column:
    """User, host and port as they are kept; null if they are none.  ``coded`` is the name of a host beyond ASCII, if it is known."""
    user, port = F.regexp_extract(authority, "^(.*@)", 1), F.regexp_extract(F.regexp_replace(authority, "^.*@", ""), r":([^:\]]*)$", 1)
    name = _name(authority)
    known = F.when(name.rlike(_BEYOND), coded).otherwise(name)
    number = F.regexp_replace(port, "^0+(?=[0-9])", "")
    sound = (port == "") | (port.rlike("^[0-9]+$") & (F.length(number) <= 5) & (number.try_cast("int") <= 65535))
    held = known.rlike(r"^\[[0-9a-f:.]+\]$") | ((known != "") & ~known.rlike(_NO_HOST))
    return F.when(sound & held, F.concat(F.when(user != "@", user).otherwise(""), known, F.when((number == "") | (number == default), "").otherwise(F.concat(F.lit(":"), number))))


def _without_first(word: str):
    return lambda p: F.when(F.lower(F.try_element_at(p, F.lit(1))) == word, F.slice(p, 2, F.size(p))).otherwise(p)


def _without_last(word: str):
    return lambda p: F.when(F.lower(F.try_element_at(p, F.lit(-1))) == word, F.slice(p, 1, F.size(p) - 1)).otherwise(p)


def _without_infix(word: str):
    """``name.word.ext`` becomes ``name.ext``."""
    return lambda x: F.regexp_replace(x, rf"(?i)\.{word}(\.[a-z0-9]+)$", "$1")


def _undotted(path: Column) -> Column:
    """Segments after ``.`` and ``..``, written out or encoded, are gone."""
    dots = lambda x: F.regexp_replace(x, "(?i)%2e", ".")
    return F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda done, x: F.when((x == "") | (dots(x) == "."), done).when(dots(x) == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, x)))


def _canonical(url: Column, coded: Column, keep_language: bool) -> Column:
    scheme = F.lower(F.regexp_extract(url, r"(?i)^(https?):", 1))
    path = F.regexp_extract(_head(url), r"(?i)^https?:/*[^/]*(.*)$", 1)
    host = _host(_authority(url), coded, F.when(scheme == "http", "80").otherwise("443"))
    parts = F.transform(F.when(path.rlike(r"(?i)(/|^)(\.|%2e){1,2}(/|$)"), _undotted(path)).otherwise(F.filter(F.split(path, "/"), lambda s: s != "")), _in_path)
    for word in ("amp", "print"):
        parts = bound(bound(parts, _without_first(word)), _without_last(word))
    for word in ("amp", "print"):
        parts = F.transform(parts, _without_infix(word))
    clean = F.concat(F.lit("/"), F.array_join(parts, "/"))
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p, i: F.struct(_decoded(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), _decoded(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v"), i.alias("i")))

    def stays(p: Column) -> Column:
        k, v = F.lower(p["k"]), F.lower(p["v"])
        gone = F.startswith(k, F.lit("utm_")) | k.isin(*TRACKING, *MOBILE)
        gone = gone | (k.isin("print", "printable") & v.isin("", "1", "true")) | (k.isin("view", "output", "display", "format") & (v == "print"))
        return ~(gone if keep_language else gone | k.isin(*LANGUAGE))

    # Equal keys and values by the collation stay in their order.
    told = F.transform(F.filter(pairs, stays), lambda p: F.struct(F.collate(p["k"], "UNICODE").alias("ck"), F.collate(p["v"], "UNICODE").alias("cv"), p["i"].alias("i"), p["k"].alias("k"), p["v"].alias("v")))
    kept = F.array_join(F.transform(F.array_sort(told), lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), host, clean, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def resolved(base: Column, location: Column) -> Column:
    """The canonical form of ``location`` as a redirect from the http(s) url ``base`` means it."""
    origin = F.regexp_extract(base, r"(?i)^\s*(https?://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"(?i)^\s*https?://[^/?#]*([^?#]*)", 1)
    bare = F.regexp_extract(location, "^([^?#]*)", 1)
    tail = F.substr(location, F.length(bare) + 1)
    parts = F.aggregate(
        F.split(bound(F.struct(path.alias("p"), bare.alias("b")), lambda x: F.when(x["b"] == "", x["p"]).when(F.startswith(x["b"], _text("/")), x["b"]).otherwise(F.concat(F.regexp_replace(x["p"], "[^/]*$", ""), _text("/"), x["b"]))), "/"),
        F.array().cast("array<string>"),
        lambda done, x: F.when(x.isin("", "."), done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, x)),
    )
    kept = F.when(F.startswith(tail, _text("?")) | (bare != ""), tail).otherwise(F.concat(F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1), tail))
    near = F.concat(origin, _text("/"), F.array_join(parts, "/"), kept)
    scheme = F.regexp_extract(base, r"(?i)^\s*(https?:)", 1)
    return canonical(F.when(F.rlike(location, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")), location).when(F.startswith(location, _text("//")), F.concat(scheme, location)).otherwise(near))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def _segment(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9._-]+", "-"), "^-+|-+$", "")


def storage_path(source_type: Column, source_id: Column, canonical_url: Column, content_hash_: Column, content_type: Column) -> Column:
    """Where a raw body is kept: by source type, source and host, under its hash, with the type's extension."""
    kind = F.lower(F.trim(F.regexp_extract(F.coalesce(content_type, F.lit("")), "^([^;]*)", 1)))
    extension = F.when(kind == "application/pdf", "pdf").when(kind.isin("application/json", "application/ld+json"), "json").when(kind == "text/plain", "txt").otherwise("html")
    host = F.regexp_extract(canonical_url, r"(?i)^\s*https?://([^/?#]*)", 1)
    return F.concat_ws("/", F.lit("raw-documents"), _segment(source_type), _segment(source_id), _segment(host), F.concat(content_hash_, F.lit("."), extension))


def access_status(status: Column, body: Column, paywall_header: Column) -> Column:
    """What a response says about access; the order of the tests matters.  ``paywall_header``: the header's text."""
    words = F.lower(F.coalesce(body, F.lit(""))).rlike("subscribe to continue|subscriber-only|paywall")
    return (
        F.when(status == 401, "LOGIN_REQUIRED")
        .when((status == 402) | F.coalesce(F.lower(paywall_header) == "true", F.lit(False)), "PAYWALLED")
        .when(status.isin(403, 451), "BLOCKED")
        .when(status.isin(404, 410), "REMOVED")
        .when(words, "PAYWALLED")
        .when(status.between(200, 299), "PUBLIC")
        .otherwise("UNKNOWN")
    )


def extraction_status(access: Column, status: Column, size: Column) -> Column:
    """A paywalled body is partial, without one there is metadata only; any other success waits for extraction."""
    return F.when(access == "PAYWALLED", F.when(size > 0, "PARTIAL").otherwise("METADATA_ONLY")).when(status.between(200, 299), "PENDING").otherwise("FAILED")


def header_map(headers: Column) -> Column:
    """Headers by lower-case name; of names that differ in case alone the last counts."""
    return F.map_from_entries(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))


def is_redirect(status: Column) -> Column:
    return status.isin(301, 302, 303, 307, 308)


def is_retryable(status: Column) -> Column:
    return status.isin(408, 429) | status.between(500, 599)


def domain(value: Column) -> Column:
    """The host of a url or a bare domain, in lower case, without www-independent parts."""
    bare = F.lower(F.trim(value))
    return F.nullif(F.regexp_extract(F.regexp_replace(bare, "^[a-z]+://", ""), "^([^/?#:]*)", 1), F.lit(""))


def robots_rules(txt: str | None, agent: str) -> list[tuple[str, bool]]:
    """(prefix, allowed) of the rules for ``agent``'s first token: those of its groups and of the general ones.

    A blank line ends a group, and so does a user-agent line after rules.  One trailing * of a prefix goes.
    """
    token = re.split(r"[ /\t]", agent.lower())[0]
    rules: list[tuple[str, bool]] = []
    names: list[str] = []
    begun = False
    for raw in re.split(r"\r?\n", txt or ""):
        line = raw.split("#", 1)[0].strip()
        if not line:
            names, begun = [], False
        if ":" not in line:
            continue
        key, value = (x.strip() for x in line.split(":", 1))
        if key.lower() == "user-agent":
            names = [*([] if begun else names), value.lower()]
            begun = False
        elif names and key.lower() in ("allow", "disallow"):
            begun = True
            if any(n == "*" or n in token for n in names):
                rules.append((value.strip().removesuffix("*"), key.lower() == "allow"))
    return [r for r in rules if r[0]]


def robots_verdict(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Whether the longest fitting prefix allows ``path``; allow wins a tie, and no rule allows."""
    fits = [F.when(F.startswith(path, F.lit(prefix)), F.struct(F.lit(len(prefix)).alias("n"), F.lit(allowed).alias("allowed"))) for prefix, allowed in rules]
    return F.coalesce(F.array_max(F.array(*fits))["allowed"], F.lit(True)) if fits else F.lit(True)


def robots_allowed(txt: str | None, path: str, agent: str) -> bool:
    """``robots_verdict`` of one path."""
    fits = [(len(prefix), allowed) for prefix, allowed in robots_rules(txt, agent) if path.startswith(prefix)]
    return max(fits)[1] if fits else True
