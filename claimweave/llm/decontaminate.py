"""Benchmark decontamination with a stored positional inverted index of the training documents.

The index is a table of segments, written to the shared folder.  A segment holds, for some ten thousand consecutive
documents or fewer, every term with the sorted positions of its tokens.  A phrase is looked up from its rarest terms: their
posting lists, shifted by the terms' offsets, are intersected, rarest first, so that most phrases end after one or
two short lists.  The benchmark is sent to the executors in blocks of bounded size, as hashes of its windows; several
blocks are passes over the index, not over the texts.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._common import ASCII_LOWER, Rolling, free_others, row_key, settle

WINDOW = 10
#: Characters of benchmark text in one broadcast block.
BLOCK = 4_000_000
#: Characters of documents in one segment, unless one document has more.
SEGMENT = 16_000_000

#: Bytes of words: digits, letters and whatever is beyond ASCII.
_INSIDE = np.array([b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])


def terms_of(data: bytes) -> np.ndarray:
    """A hash of each word ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 bytes, A-Z lower-cased."""
    raw = np.frombuffer(data.translate(ASCII_LOWER), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    inside = np.concatenate([[False], _INSIDE[raw], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return Rolling(raw).between(edge[::2], edge[1::2])


class Phrases:
    """Distinct windows of benchmark items, as rows of term hashes by window length, with the items that have them."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        found: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for name, text in items:
            ids = terms_of((text or "").encode("utf-8", "surrogatepass")).tolist()
            for i in range(max(len(ids) - window, 0) + 1 if ids else 0):
                found[tuple(ids[i : i + window])].add(name)
        self.groups: list[tuple[np.ndarray, list[list[str]]]] = []
        for size in sorted({len(w) for w in found}):
            some = [w for w in found if len(w) == size]
            self.groups.append((np.array(some, np.uint64), [sorted(found[w]) for w in some]))


class Segment:
    """Posting lists of the token positions of some documents."""

    def __init__(self, sizes: np.ndarray, terms: np.ndarray, bounds: np.ndarray, positions: np.ndarray):
        self.sizes, self.terms, self.bounds, self.positions = sizes, terms, bounds, positions
        self.n = int(sizes.sum())
        self.document = np.repeat(np.arange(len(sizes)), sizes)
        self.begin = np.cumsum(sizes) - sizes

    @classmethod
    def of(cls, documents: list[np.ndarray]) -> Segment:
        """From the term hashes of each document."""
        sizes = np.array([len(d) for d in documents], np.int64)
        tokens = np.concatenate(documents) if documents else np.zeros(0, np.uint64)
        order = np.argsort(tokens, kind="stable")
        ranked = tokens[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
        return cls(sizes, ranked[first], np.append(first, len(ranked)), order)

    def columns(self) -> dict[str, bytes]:
        """As stored: positions as differences inside the sorted order."""
        return {"sizes": self.sizes.astype("<i4").tobytes(), "terms": self.terms.astype("<u8").tobytes(), "bounds": self.bounds.astype("<i4").tobytes(), "positions": np.diff(self.positions, prepend=0).astype("<i4").tobytes()}

    @classmethod
    def stored(cls, columns: dict[str, bytes]) -> Segment:
        sizes, bounds, positions = (np.frombuffer(columns[n], "<i4").astype(np.int64) for n in ("sizes", "bounds", "positions"))
        return cls(sizes, np.frombuffer(columns["terms"], "<u8"), bounds, np.cumsum(positions))

    def numbers(self, windows: np.ndarray) -> np.ndarray:
        """The number of each hash among the segment's terms; -1 where it has none."""
        if not len(self.terms):
            return np.full(windows.shape, -1, np.int64)
        at = np.minimum(np.searchsorted(self.terms, windows), len(self.terms) - 1)
        return np.where(self.terms[at] == windows, at, -1)

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.bounds[term] : self.bounds[term + 1]]

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Starts of the exact phrase, inside one document."""
        sizes = self.bounds[terms + 1] - self.bounds[terms]
        rarest = np.argsort(sizes, kind="stable")
        starts = self.postings(terms[rarest[0]]) - rarest[0]
        starts = starts[(starts >= 0) & (starts + len(terms) <= self.n)]
        for offset in rarest[1:]:
            if not len(starts):
                return starts
            has = self.postings(terms[offset])
            at = np.minimum(np.searchsorted(has, starts + offset), len(has) - 1)
            starts = starts[has[at] == starts + offset]
        return starts[self.document[starts] == self.document[starts + len(terms) - 1]]

    def near(self, terms: np.ndarray, slop: int) -> np.ndarray:
        """Positions of the first term with every other term at most ``slop`` words away in the same document; rarest first."""
        centre, others = self.postings(terms[0]), np.unique(terms[terms != terms[0]])
        for term in others[np.argsort(self.bounds[others + 1] - self.bounds[others], kind="stable")]:
            if not len(centre):
                break
            has = self.postings(term)
            after = np.minimum(np.searchsorted(has, centre), len(has) - 1)
            good = np.zeros(len(centre), bool)
            for at in (after, np.maximum(after - 1, 0)):
                good |= (np.abs(has[at] - centre) <= slop) & (self.document[has[at]] == self.document[centre])
            centre = centre[good]
        return centre


_STORED = "sizes binary, terms binary, bounds binary, positions binary"


def index(docs: DataFrame) -> DataFrame:
    """The written index of ``docs`` (doc_id, text): segments (doc_ids, keys, sizes, terms, bounds, positions).

    keys: a hash of each row's doc_id and text, by which rows and results meet again.  Null texts have no words.
    """
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("k", row_key("doc_id", "text"))
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches):
        free_others()
        for batch in batches:
            texts = [t.as_py() for t in batch.column("text").cast(pa.large_binary())]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= SEGMENT):
                    size += len(texts[end])
                    end += 1
                segment = Segment.of([terms_of(t) for t in texts[at:end]])
                names = [pa.array([batch.column(c).slice(at, end - at).to_pylist()], pa.list_(batch.schema.field(c).type)) for c in ("doc_id", "k")]
                stored = segment.columns()
                yield pa.RecordBatch.from_arrays([*names, *[pa.array([v], pa.binary()) for v in stored.values()]], names=["doc_ids", "keys", *stored])
                at = end

    return settle(base.mapInArrow(run, f"doc_ids array<{kind}>, keys array<bigint>, {_STORED}"))


def _look_up(phrases: Phrases, slop: int | None, kind: pa.DataType):
    def run(batches):
        free_others()
        for batch in batches:
            for row in range(batch.num_rows):
                segment = Segment.stored({n: batch.column(n)[row].as_py() for n in ("sizes", "terms", "bounds", "positions")})
                n = len(segment.sizes)
                spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
                items: list[set[str]] = [set() for _ in range(n)]
                near: list[set[str]] = [set() for _ in range(n)]
                for windows, names in phrases.groups:
                    numbers = segment.numbers(windows)
                    for i in np.flatnonzero((numbers >= 0).all(axis=1)):
                        terms = numbers[i]
                        for start in segment.phrase(terms):
                            d = segment.document[start]
                            first = int(start - segment.begin[d])
                            spans[d].append((first, first + len(terms) - 1))
                            items[d].update(names[i])
                        if slop is not None:
                            for at in segment.near(terms, slop):
                                near[segment.document[at]].update(names[i])
                columns = [
                    pa.array(batch.column("doc_ids")[row].as_py(), kind), pa.array(batch.column("keys")[row].as_py(), pa.int64()), pa.array(segment.sizes, pa.int64()),
                    pa.array([merged(x) for x in spans], pa.list_(pa.list_(pa.int64()))), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array([sorted(x) for x in near], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "k", "n_words", "spans", "items", "near"])

    return run


def merged(spans: list) -> list[list[int]]:
    """Maximal runs of hit words, [first, last]."""
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def search(segments: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """doc_id, k, n_words, spans, items and near of each indexed row.

    spans: maximal runs [first, last] of words inside an occurrence of a window; items: item_ids (as strings,
    sorted) with such windows; near: item_ids of windows whose terms all lie within ``slop`` words of an
    occurrence of the first one, where ``slop`` is given.  A window is ``window`` consecutive item words; an item with fewer, but not none, is one.

    Item_ids that repeat count once; a null item_id is written "null"; items without words have no window.
    An empty benchmark hits nothing.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK))
    kind = segments.schema["doc_ids"].dataType.elementType
    schema = f"doc_id {kind.simpleString()}, k long, n_words long, spans array<array<long>>, items array<string>, near array<string>"
    found = []
    for b in range(blocks):
        part = items.where(F.pmod(row_key("item_id", "text"), F.lit(blocks)) == b)
        phrases = Phrases([tuple(r) for r in part.collect()], window)  # a block: BLOCK characters or so
        found.append(segments.mapInArrow(_look_up(phrases, slop, to_arrow_type(kind)), schema))
    if blocks == 1:
        return found[0]
    both = found[0]
    for more in found[1:]:
        both = both.unionByName(more)
    names = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    spans = F.aggregate(F.array_sort(F.flatten(F.collect_list("spans"))), F.array().cast("array<array<long>>"), _join_span).alias("spans")
    # Rows equal in doc_id and text share k, and come once from every block: as many rows as there were stay.
    rows = F.count(F.lit(1)) / blocks
    grouped = both.groupBy("doc_id", "k").agg(F.max("n_words").alias("n_words"), spans, names("items"), names("near"), rows.cast("int").alias("copies"))
    return grouped.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copy", "copies")


def _join_span(done, s):
    last = F.element_at(done, -1)
    joins = (F.size(done) > 0) & (s[0] <= F.try_element_at(F.try_element_at(done, F.lit(-1)), F.lit(2)) + 1)
    longer = F.array(F.try_element_at(last, F.lit(1)), F.greatest(F.try_element_at(last, F.lit(2)), s[1]))
    return F.when(joins, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(s)))


def matches(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """``keep`` (default doc_id; they must not be named like what follows) and text of each row of ``docs``, with n_words,
    spans, items and near of ``search``.

    Null and empty texts have no words and stay as they are.  Repeated documents are looked up each.  A text of any length
    is indexed whole.  An empty table gives an empty result.
    """
    keep = keep or ["doc_id"]
    if clash := {"text", "n_words", "spans", "items", "near"} & set(keep):
        raise ValueError(f"cannot keep columns of these names: {sorted(clash)}")
    found = search(index(docs), benchmark, window, slop).drop("doc_id").dropDuplicates(["k"])
    rows = docs.select(*[F.col(c) for c in dict.fromkeys([*keep, "text"])], _key().alias("__k"))
    return rows.join(found, F.col("__k") == F.col("k")).select(*keep, "text", "n_words", "spans", "items", "near")


def _key() -> Column:
    """The key that ``index`` gives a row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.xxhash64(F.col("doc_id"), text, F.col("doc_id").isNull(), F.lit(False))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and spans; see ``search``."""
    found = search(index(docs), benchmark)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0] + 1)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), "spans")


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
