"""Main text of web pages: a host suffix array tells boilerplate, structure tells what an article is.

A tolerant tokeniser turns a page into blocks of text with a zone: ``main`` (inside an article or main
element), ``chrome`` (inside menus, headers, footers, sidebars, adverts, forms, comments, ...) or ``open``.
All pages of a host are one collection of token streams, two for a page: what is outside its article, and the article.
Their suffixes are sorted inside each partition, cut to ``RUN`` tokens, and Spark merges the partitions by (host,
prefix).  Cutting loses nothing: a substring of ``RUN`` tokens or more that two pages share covers exactly the tokens
that its runs of ``RUN`` tokens cover.

A run that distinct pages have outside their articles is boilerplate.  It decides what structure leaves in doubt:
on pages without an article, covered tokens go and the uncovered runs of open blocks stay; inside an article, a block
that only its class or id makes suspect (``doubt``: a widget, a header, shared links) goes if it is covered as a whole.

Articles quote the sentences that menus and adverts of their host print, and copies of one article repeat as a whole.
So a run is boilerplate inside articles only if more than half of the host's different articles have it, of ``LEAST`` or
more.  A plain block that such runs cover as a whole goes, unless that would take half of its article or more: then
most articles of the host are versions of one.  Nearly all suffixes of articles are rare, and leave before the sort:
each partition counts, for each host, the articles in each of ``BUCKETS`` buckets of runs.  The counts are summed, and
a run whose bucket half of the articles or fewer are in cannot be in more of them.  Only the others are sorted.
"""

from __future__ import annotations

import re
import zlib
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Rolling, mix, row_key, settle

#: Tokens of a repeated substring.
RUN = 8
#: Different articles of a host, from which repetition decides inside them.
LEAST = 4
#: Buckets that the runs of articles are counted in, and the parts that a host's buckets are summed in.
BUCKETS, SLICES = 1 << 16, 4

_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_RAW = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "math", "head", "title", "textarea", "select", "audio", "video", "xmp", "noframes", "noembed"}
_TEXT_RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes"}
_CHROME = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "label"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rb", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "br", "picture", "source", "input", "map", "area"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_NAMES = r"(?:^|[\s_-])(?:{})(?:$|[\s_-])"
_NAMED = re.compile(_NAMES.format("ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|cookies?|consent|gdpr|notices?|popup|modal|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|pagination|footer|comments?|commentlist|disqus|replies|respond|newsletter|subscribe|subscription|signup|login|skip-link"), re.I)
#: Names that are chrome outside an article, and a reason to doubt inside one.
_DOUBTED = re.compile(_NAMES.format("promo(?:tion)?|banner|alert|overlay|header|masthead|related|recommended|share|sharing|social|widget|toolbar"), re.I)
_NOTED = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alert", "alertdialog", "form", "toolbar"}
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: An open element of the key is closed by the start of one of these.
_CLOSES = {"p": {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}

MAIN, OPEN, CHROME, DOUBT = 0, 1, 2, 3


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _suspect(tag: str, attributes: str, in_main: bool) -> int | None:
    """CHROME or DOUBT, if the element's tag, role, class or id say so."""
    if tag in _CHROME or (tag == "header" and not in_main):
        return CHROME
    if not attributes or tag in ("html", "body", "article", "main"):
        return None
    a = _attributes(attributes)
    names = [a[n] for n in ("class", "id") if a.get(n)]
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in _NOTED or any(map(_NAMED.search, names)):
        return CHROME
    if tag == "header" or not any(map(_DOUBTED.search, names)):
        return None
    return DOUBT if in_main else CHROME


def blocks(html: str) -> list[tuple[int, str]]:
    """(zone, text) of each block of text, in page order."""
    out: list[tuple[int, str]] = []
    piece: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements and the zone inside them
    zone = OPEN
    at = 0

    def end_block() -> None:
        text = " ".join(unescape("".join(piece)).split())
        piece.clear()
        if text:
            out.append((zone, text))

    def inner() -> int:
        return stack[-1][1] if stack else OPEN

    while True:
        m = _TAG.search(html, at)
        if not m:
            piece.append(html[at:])
            end_block()
            return out
        piece.append(html[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if m[1] is not None:
            piece.append(m[1])
        if not tag:
            continue
        closing = bool(m[2])
        if not closing and tag in _RAW:
            if m[4].endswith("/") and tag not in _TEXT_RAW:
                continue
            if tag == "head":
                end = re.compile(r"</head\s*>|(?=<body[\s>])", re.I).search(html, at)
                if not end:
                    continue
            else:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag in _INLINE and not (not closing and m[4] and _suspect(tag, m[4], True)):
            if tag == "br":
                piece.append(" ")
            elif closing and stack and stack[-1][0] == tag:
                end_block()
                stack.pop()
                zone = inner()
            elif not closing and inner() in (CHROME, DOUBT) and any(t == tag for t, _ in stack) and tag not in _VOID:
                stack.append((tag, inner()))
            continue
        end_block()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        elif tag not in _VOID and not m[4].endswith("/"):
            while stack and tag in _CLOSES.get(stack[-1][0], ()):
                stack.pop()
            now = inner()
            if now != CHROME:
                if (told := _suspect(tag, m[4], now in (MAIN, DOUBT))) is not None:
                    now = told
                elif tag in ("article", "main") or 'role="main"' in m[4]:
                    now = MAIN
            stack.append((tag, now))
        zone = inner()


def host_of(url: str | None) -> str:
    """The host that pages are collected by."""
    rest = (url or "").partition("://")[2]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].lower()


def host_in(column: str) -> Column:
    """``host_of`` a column."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(column), F.lit("")), "://([^/?#]*)", 1))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _outside(found: list[tuple[int, str]]) -> list[tuple[int, int, str]]:
    """The tokens (block, zone, word) of a page outside its article: the stream that its suffixes are taken from."""
    return [(i, z, w) for i, (z, text) in enumerate(found) if z != MAIN for w in text.split(" ")]


def _inside(found: list[tuple[int, str]]) -> str:
    """The tokens of a page's article, with one space between them: its other stream."""
    return " ".join(text for z, text in found if z == MAIN)


def _runs(stream: str) -> tuple[np.ndarray, int]:
    """The hash of each run of RUN tokens (fewer: all), and one of the whole stream."""
    if not stream:
        return np.zeros(0, np.uint64), 0
    data = np.frombuffer(stream.encode("utf-8", "surrogatepass"), np.uint8)
    spaces, ends = np.flatnonzero(data == 0x20), np.array([len(data)])
    roll = Rolling(data)
    words = roll.between(np.concatenate([[0], spaces + 1]), np.concatenate([spaces, ends]))
    k = min(RUN, len(words))
    total = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[j : len(words) - k + 1 + j]
    return mix(total), int(_signed(roll.between(np.array([0]), ends))[0])


def _bucket(runs: np.ndarray) -> np.ndarray:
    return (runs >> np.uint64(64 - (BUCKETS - 1).bit_length())).astype(np.uint16)


def _coded(values: np.ndarray) -> bytes:
    """Small numbers in a byte each; one of 255 or more takes a byte of 255 for each 255 in it first."""
    more = values // 255
    out = np.full(int(more.sum()) + len(values), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = values % 255
    return out.tobytes()


def _decoded(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    return np.diff(np.cumsum(raw, dtype=np.int64)[raw < 255], prepend=0)


def _counted(articles: dict[int, dict[int, np.ndarray]]) -> dict[str, list]:
    """Of each host's different articles: their digests, and how many are in each bucket, as gaps and counts."""
    out: dict[str, list] = {n: [] for n in ("host", "digest", "slice", "gaps", "counts")}
    for host, buckets in articles.items():
        told = [(d, None, None, None) for d in buckets]
        found, counts = np.unique(np.concatenate(list(buckets.values())), return_counts=True)
        width = BUCKETS // SLICES
        cut = np.searchsorted(found, np.arange(1, SLICES) * width)
        for s, (at, n) in enumerate(zip(np.split(found.astype(np.int64), cut), np.split(counts, cut), strict=True)):
            if len(at):
                told.append((None, s, _coded(np.diff(at - s * width, prepend=-1) - 1), _coded(n - 1)))
        for row in told:
            for column, value in zip(out.values(), (host, *row), strict=True):
                column.append(value)
    return out


def _rows(schema: str, **columns) -> pa.RecordBatch:
    """A batch of ``schema`` that has nulls in all but ``columns``."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = {n: kinds[t] for n, t in (c.split(" ") for c in schema.split(", "))}
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in fields.items()], names=list(fields))


_OPEN = "host long, slice int, open binary"


def _open(batches):
    """From rows in the order of host and slice: the buckets that more than half of a host's articles are in, as bitmaps."""
    now, total = None, np.zeros(BUCKETS // SLICES, np.int64)

    def ended(out: list[tuple]) -> None:
        if now and (often := 2 * total > now[2]).any():
            out.append((*now[:2], zlib.compress(np.packbits(often).tobytes(), 1)))

    for batch in batches:
        out: list[tuple] = []
        columns = [batch.column(n).to_pylist() for n in ("host", "slice", "n", "gaps", "counts")]
        for host, part, n, gaps, counts in zip(*columns, strict=True):
            if (host, part, n) != now:
                ended(out)
                now = host, part, n
                total[:] = 0
            total[np.cumsum(_decoded(gaps) + 1) - 1] += _decoded(counts) + 1
        yield _rows(_OPEN, **dict(zip(("host", "slice", "open"), zip(*out), strict=True))) if out else _rows(_OPEN, host=[])
    ended(last := [])
    if last:
        yield _rows(_OPEN, **dict(zip(("host", "slice", "open"), zip(*last), strict=True)))


def _asked(found: list[tuple[int, str]], tokens: list[tuple[int, int, str]], n: int) -> np.ndarray:
    """The runs that repetition decides on: of a page without an article all, else those that touch a doubted block."""
    zones = {z for z, _ in found}
    if MAIN not in zones:
        return np.arange(n)
    if DOUBT not in zones:
        return np.zeros(0, np.int64)
    before = np.concatenate([[0], np.cumsum([z == DOUBT for _, z, _ in tokens])])
    at = np.arange(n)
    return at[before[np.minimum(at + RUN, len(tokens))] > before[at]]


_TOLD = "host long, prefix long, low long, high long, k long, at long, digest long, slice int, gaps binary, counts binary"


def _told(batches):
    """Rows of four kinds from one parse of each page.

    Of each partition's sorted, cut suffixes outside articles: host, prefix, and the first and last page that has it.
    Of the runs that repetition decides on there: host, prefix, k and at, the run's place in its page's stream.
    Of the articles: host and digest; host, slice, gaps and counts.
    """
    for batch in batches:
        suffixes: list[list] = [[], [], []]
        asks: list[list] = [[], [], [], []]
        articles: dict[int, dict[int, np.ndarray]] = {}
        for k, host, html in zip(*(batch.column(n).to_pylist() for n in ("k", "host", "html")), strict=True):
            found = blocks(html)
            within, digest = _runs(_inside(found))
            if len(within) and digest not in articles.setdefault(host, {}):
                articles[host][digest] = np.unique(_bucket(within))
            tokens = _outside(found)
            runs = _signed(_runs(" ".join(w for *_, w in tokens))[0])
            if not len(runs):
                continue
            at = _asked(found, tokens, len(runs))
            for column, values in zip(suffixes, (np.full(len(runs), host), runs, np.full(len(runs), k)), strict=True):
                column.append(values)
            for column, values in zip(asks, (np.full(len(at), host), runs[at], np.full(len(at), k), at), strict=True):
                column.append(values)
        if articles:
            yield _rows(_TOLD, **_counted(articles))
        if not suffixes[0]:
            continue
        h, p, g = (np.concatenate(c) for c in suffixes)
        order = np.lexsort((g, p, h))  # the suffix array, as far as RUN tokens tell suffixes apart
        h, p, g = h[order], p[order], g[order]
        cut = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (p[1:] != p[:-1])]))
        last = np.concatenate([cut[1:], [len(h)]]) - 1
        yield _rows(_TOLD, host=h[cut], prefix=p[cut], low=g[cut], high=g[last])
        h, p, k, at = (np.concatenate(c).astype(np.int64) for c in asks)
        yield _rows(_TOLD, host=h, prefix=p, k=k, at=at)


_OPENED = "host long, prefix long, k long, at long, digest long"


def _opened(batches):
    """The suffixes of articles that lie in open buckets: host, prefix, k, at, and the digest of the article."""
    for batch in batches:
        out: list[list] = [[np.zeros(0, np.int64)] for _ in range(5)]
        for k, host, html, slices in zip(*(batch.column(n).to_pylist() for n in ("k", "host", "html", "slices")), strict=True):
            runs, digest = _runs(_inside(blocks(html)))
            often = np.zeros((SLICES, BUCKETS // SLICES), bool)
            for s in slices:
                often[s["slice"]] = np.unpackbits(np.frombuffer(zlib.decompress(s["open"]), np.uint8))
            at = np.flatnonzero(often.ravel()[_bucket(runs)])
            for column, values in zip(out, (np.full(len(at), host), _signed(runs[at]), np.full(len(at), k), at, np.full(len(at), digest)), strict=True):
                column.append(values)
        yield _rows(_OPENED, **dict(zip(("host", "prefix", "k", "at", "digest"), map(np.concatenate, out), strict=True)))


def _hit(n: int, covered: list[int]) -> np.ndarray:
    """For each of ``n`` tokens: whether a run that starts at one of ``covered`` covers it."""
    starts = np.bincount(np.array(covered, np.int64), minlength=n + 1)
    return np.cumsum(starts - np.concatenate([np.zeros(k := min(RUN, n), np.int64), starts[: n + 1 - k]]))[:n] > 0


def _common(found: list[tuple[int, str]], inside: list[int]) -> set[int]:
    """The blocks of an article that its host's common runs cover as a whole, if they are less than half of it."""
    if not inside:
        return set()
    at = [i for i, (z, _) in enumerate(found) if z == MAIN]
    ends = np.cumsum([found[i][1].count(" ") + 1 for i in at])
    hit = np.concatenate([[0], np.cumsum(_hit(ends[-1], inside))])
    sizes = np.diff(ends, prepend=0)
    whole = hit[ends] - hit[ends - sizes] == sizes
    return {i for i, w in zip(at, whole, strict=True) if w} if 2 * sizes[whole].sum() < ends[-1] else set()


def _kept(found: list[tuple[int, str]], covered: list[int], inside: list[int]) -> str:
    """Main blocks that are not common and doubted ones that are not covered as a whole; without main ones, the uncovered runs of the open blocks."""
    main = any(z == MAIN for z, _ in found)
    common = _common(found, inside)
    stays: dict[int, list[str]] = {i: [] for i, (z, _) in enumerate(found) if main and z == MAIN and i not in common}
    if not main or any(z == DOUBT for z, _ in found):
        tokens = _outside(found)
        for (block, zone, word), hit in zip(tokens, _hit(len(tokens), covered).tolist(), strict=True):
            if not hit and zone == (DOUBT if main else OPEN):
                stays.setdefault(block, []).append(word)
    return "\n\n".join(found[block][1] if main else " ".join(words) for block, words in sorted(stays.items()))


def _texts(batches):
    for batch in batches:
        pages = zip(*(batch.column(n).to_pylist() for n in ("html", "covered", "inside")), strict=True)
        texts = [_kept(blocks(page), at or [], within or []) for page, at, within in pages]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


#: Covered runs up to which they are sent to every task (8 bytes each, and a key for each page); beyond, they meet their pages in a shuffle.
SENT = 2_000_000


def _common_runs(base: DataFrame, told: DataFrame) -> DataFrame | None:
    """k and at of the runs in articles that more than half of their host's different articles have."""
    hosts = settle(told.where("digest is not null").groupBy("host").agg(F.count_distinct("digest").alias("n")).where(f"n >= {LEAST}"))
    counts = told.where("slice is not null").select("host", "slice", "gaps", "counts").join(hosts, "host")
    often = settle(counts.repartition("host", "slice").sortWithinPartitions("host", "slice").mapInArrow(_open, _OPEN))
    size = often.agg(F.sum(F.length("open") + 8)).first()[0]
    if not size:
        return None
    slices = often.groupBy("host").agg(F.collect_list(F.struct("slice", "open")).alias("slices"))
    asked = base.select("k", "host", "html").join(F.broadcast(slices) if size <= 8 * SENT else slices, "host")
    opened = settle(asked.mapInArrow(_opened, _OPENED))
    common = settle(opened.groupBy("host", "prefix").agg(F.count_distinct("digest").alias("c")).join(hosts, "host").where("2 * c > n").select("host", "prefix"))
    return opened.join(common, ["host", "prefix"]).select("k", "at")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of ``pages`` (page_id, url, html).

    Null or empty html has an empty text.  Null urls share the empty host.  A page repeated under another
    page_id on its host counts as a distinct page; fully repeated rows count once in the suffix array and
    stay in the result.  Inside articles, those of the same tokens count once.  Null page_ids stay.  Very long pages
    are read whole.  An empty table gives an empty result.  Columns beyond these three are ignored.  A page shorter
    than ``RUN`` tokens is one run.
    """
    base = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html")).withColumn("k", row_key("page_id", "url", "html")).withColumn("host", F.xxhash64(host_in("url")))
    schema = "page_id " + base.schema["page_id"].dataType.simpleString() + ", url string, text string, n_chars long"
    told = settle(base.mapInArrow(_told, _TOLD))
    repeated = told.where("low is not null").groupBy("host", "prefix").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("host", "prefix")
    hits = told.where("k is not null").select("host", "prefix", "k", "at").join(repeated, ["host", "prefix"]).select("k", "at", F.lit(None).cast("long").alias("within"))
    if (common := _common_runs(base, told)) is not None:
        hits = hits.union(common.select("k", F.lit(None).cast("long"), "at"))
    covered = settle(hits.groupBy("k").agg(F.collect_set("at").alias("covered"), F.collect_set("within").alias("inside")))
    few = (covered.agg(F.sum(F.size("covered") + F.size("inside"))).first()[0] or 0) <= SENT
    joined = base.join(F.broadcast(covered) if few else covered, "k", "left")
    return joined.select("page_id", "url", "html", "covered", "inside").mapInArrow(_texts, schema)
