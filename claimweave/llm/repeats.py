"""Removal of long byte strings that occur more than once: sparse distributed prefix doubling.

Plain prefix doubling ranks every byte position in every round; at 840 MB that is 840 million rows
a round.  Here the positions are thinned first, without losing a match: every 400-byte string holds
the leftmost smallest hash among its 128-byte substrings at the same offset, so equal strings share
that anchor.  Anchors stand for the run of start positions they are the anchor of.  Rounds then
rank them at growing lengths, and, as in prefix doubling, what has become unique leaves and what is
repeated over its whole reach is settled:

    128 bytes at the anchor -> 385 bytes common to 16 neighbouring starts -> 400 bytes of one start

Each round is a group-by on the rank (a 64-bit hash) with a map-side combine, joined back to the
positions; hot ranks are counted before the shuffle, and the join may be split by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Rolling, free_others, row_key, settle

CORE = 128
BIN = 16
SALTS = 1024
_CHUNK_BITS = 20


def _anchored(data: np.ndarray, length: int, core: int) -> Iterator[tuple[Rolling, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For stretches of ``data``: rolling hashes, offset, anchors, first and last start they stand for."""
    starts, width = len(data) - length + 1, length - core + 1
    reach = (1 << _CHUNK_BITS) - length
    for base in range(0, max(starts, 0), reach):
        part = data[base : base + reach + length - 1]
        roll = Rolling(part)
        at = np.arange(len(part) - core + 1, dtype=np.uint64)
        ranked = (roll.windows(core) >> np.uint64(_CHUNK_BITS) << np.uint64(_CHUNK_BITS)) | at
        n = len(ranked) - width + 1
        grid = np.concatenate([ranked, np.full(-len(ranked) % width, ~np.uint64(0))]).reshape(-1, width)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()[width - 1 : width - 1 + n]
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
        anchor = (np.minimum(ahead, behind) & np.uint64((1 << _CHUNK_BITS) - 1)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
        last = np.concatenate([first[1:] - 1, [n - 1]])
        yield roll, base, anchor[first], first, last


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _bytes_of(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes]:
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def _anchor_rows(length: int, core: int):
    def run(batches):
        free_others()
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            for k, text in zip(batch.column("k").to_pylist(), _bytes_of(batch.column("text")), strict=True):
                for roll, base, anchor, first, last in _anchored(np.frombuffer(text, np.uint8), length, core):
                    rows = (np.full(len(first), k), first + base, last + base, anchor + base, _signed(roll.between(anchor, anchor + core)), _signed(roll.between(first, last + length)))
                    for column, values in zip(out, rows, strict=True):
                        column.append(values)
                if sum(map(len, out[1])) > 200_000:
                    yield _batch(out)
                    out = [[] for _ in range(6)]
            if out[0]:
                yield _batch(out)

    return run


def _batch(columns: list[list[np.ndarray]]) -> pa.RecordBatch:
    names = ("k", "first", "last", "anchor", "key", "block")
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(t.to_pandas_dtype())) for c, t in zip(columns, kinds, strict=True)], names=names)


_ROWS = "k long, first int, last int, anchor int, key long, block long"


def _classified(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the rows whose ``key`` repeats: those whose ``block`` repeats too, and those to look at more closely.

    The latter are the rows of a block seen once, and for each of their keys one row of every repeated block,
    since a match may lie in part of it.  A common passage gives one key to a block of every document that has
    it, so a key's blocks are never met in one place: they are gathered in up to ``SALTS`` parts of a key.
    """
    place = ("k", "first", "last", "anchor")
    # Written first: a join that shares a stage with an aggregate is one that Spark cannot split at a hot key.
    keys = settle(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), (F.min("block") != F.max("block")).alias("mixed")).where("c > 1").select("key", "mixed"))
    repeated = settle(rows.join(keys, "key"))
    mixed = repeated.where("mixed")
    counted = mixed.groupBy("key", "block").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(*place)).alias("one"))
    blocks = settle(counted.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALTS))))
    parts = blocks.groupBy("key", "salt").agg(F.min("c").alias("least"))
    unsettled = parts.groupBy("key").agg(F.min("least").alias("least")).where("least = 1")
    opened = parts.join(unsettled, "key", "left_semi").select("key", "salt")
    closer = blocks.join(opened, ["key", "salt"], "left_semi").select("one.*")
    whole = mixed.join(blocks.where("c > 1").select("key", "block"), ["key", "block"], "left_semi").select(*place)
    return repeated.where("not mixed").select(*place).union(whole), closer


def _sliced(length: int):
    """The bytes that the starts of each open anchor reach."""

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("k", "first", "last", "anchor", "bytes")}
            for k, text, spans in zip(batch.column("k").to_pylist(), _bytes_of(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                for s in spans:
                    for name, value in (("k", k), ("first", s["first"]), ("last", s["last"]), ("anchor", s["anchor"]), ("bytes", text[s["first"] : s["last"] + length])):
                        out[name].append(value)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return run


def _bins(length: int, width: int):
    """Starts in groups of ``width``, aligned to the anchor; key: what all of them share; block: what they reach."""

    def run(batches):
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            columns = [batch.column(n).to_pylist() for n in ("k", "first", "last", "anchor")]
            for k, first, last, anchor, data in zip(*columns, _bytes_of(batch.column("bytes")), strict=True):
                roll = Rolling(np.frombuffer(data, np.uint8))
                number = np.arange((anchor - last) // width, (anchor - first) // width + 1)
                high = anchor - number * width  # the bin's last start, and the first byte common to all
                low = high - width + 1
                lo, hi = np.maximum(low, first), np.minimum(high, last)
                rows = (np.full(len(number), k), lo, hi, np.full(len(number), anchor), _signed(roll.between(high - first, low + length - first)), _signed(roll.between(lo - first, hi + length - first)))
                for column, values in zip(out, rows, strict=True):
                    column.append(values)
            if out[0]:
                yield _batch(out)

    return run


def _kept(length: int):
    import hashlib

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "spans")}
            for doc_id, text, found in zip(batch.column("doc_id").to_pylist(), _bytes_of(batch.column("text")), batch.column("found").to_pylist(), strict=True):
                spans: list[list[int]] = []
                for lo, hi in sorted((s["first"], s["last"]) for s in found or ()):
                    if spans and lo <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], hi + length)
                    else:
                        spans.append([lo, hi + length])
                pieces, at = [], 0
                for lo, hi in spans:
                    pieces.append(text[at:lo])
                    at = hi
                kept = b"".join([*pieces, text[at:]]) if spans else text
                removed = sum(hi - lo for lo, hi in spans)
                for name, value in (("doc_id", doc_id), ("n_bytes", len(text)), ("n_removed", removed), ("n_spans", len(spans)), ("kept_sha256", hashlib.sha256(kept).hexdigest()), ("text", kept.decode("utf-8", "replace")), ("spans", spans)):
                    out[name].append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return run


def remove_repeats(docs: DataFrame, length: int = 400, core: int = CORE) -> DataFrame:
    """Find the bytes of ``docs`` (doc_id, text) covered by a ``length``-byte string that also starts elsewhere.

    Returns doc_id, n_bytes (of the input), n_removed, n_spans (maximal removed runs), kept_sha256, text (what is
    left; a character cut in half by a run becomes U+FFFD there, not in the digest) and spans ([start, end) of
    each run, in bytes), one row for each input row.

    Null and empty texts: 0 bytes, nothing removed.  Texts shorter than ``length`` hold no such string.
    Repeated rows are occurrences of their own and cover each other.  Null doc_ids are kept.
    Very long texts are hashed in stretches of a megabyte that overlap by ``length`` bytes.
    """
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).withColumn("k", row_key("doc_id", "text"))
    keyed = base.select("k", "text")
    anchors = keyed.where(F.length("text") >= length).mapInArrow(_anchor_rows(length, core), _ROWS)
    whole, closer = _classified(anchors)

    spans = closer.groupBy("k").agg(F.collect_set(F.struct("first", "last", "anchor")).alias("spans"))
    reached = settle(keyed.join(spans, "k").mapInArrow(_sliced(length), "k long, first int, last int, anchor int, bytes binary").dropDuplicates(["k", "first", "anchor"]))
    whole_bins, closer = _classified(reached.mapInArrow(_bins(length, BIN), _ROWS))
    inner = reached.alias("r").join(closer.select("k", "anchor", F.col("first").alias("lo"), F.col("last").alias("hi")), ["k", "anchor"]).where("lo >= first and hi <= last").select("k", F.col("lo").alias("first"), F.col("hi").alias("last"), "anchor", F.expr(f"substring(bytes, lo - first + 1, hi - lo + {length})").alias("bytes"))
    single, _ = _classified(inner.mapInArrow(_bins(length, 1), _ROWS))

    found = whole.union(whole_bins).union(single).select("k", "first", "last")
    covered = found.groupBy("k").agg(F.collect_set(F.struct("first", "last")).alias("found"))
    joined = base.join(covered, "k", "left").select("doc_id", "text", "found")
    return joined.mapInArrow(_kept(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string, spans array<array<long>>")
