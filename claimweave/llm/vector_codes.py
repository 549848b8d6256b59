"""Vector code compression: each part of a vector becomes the number of its nearest codebook entry.

Components become integers, so that all sums and distances are exact.  Codebooks are broadcast, one vector's width times the
number of entries; Arrow batches compute the distances to all entries as |x|^2 - 2 x.c + |c|^2 with int64 matrix products and take the
first smallest.  Each round, tasks add up the parts of each entry, the sums are merged by a grouped shuffle, and only the new
codebooks reach the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import settle

#: Vectors whose distances are computed at once.
ROWS = 2048


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, label, v): floor(scale * x) of each component, of vectors of finite components alone; without a label column all labels are null."""
    sound = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    return vectors.where(sound).select("vec_id", label.alias("label"), F.transform("embedding", lambda c: F.floor(c.cast("double") * float(scale)).cast("long")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    out = np.zeros((len(sizes), width), np.int64)
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance to it) of each row of ``x``; ties go to the lower index."""
    near = (book * book).sum(axis=1) - 2 * (x @ book.T)
    index = np.argmin(near, axis=1)
    return index, near[np.arange(len(x)), index] + (x * x).sum(axis=1)


class Codebooks:
    """Entries of dense shape (parts, entries, width of a part)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def cut(self, rows: pa.Array) -> list[np.ndarray]:
        parts, _, width = self.entries.shape
        whole = _matrix(rows, parts * width)
        return [whole[:, p * width : (p + 1) * width] for p in range(parts)]


def _round(base: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round: floors of the means of what each entry is nearest to."""
    parts, size, width = books.entries.shape
    held = base.sparkSession.sparkContext.broadcast(books.entries)

    def run(batches):
        now = Codebooks(held.value)
        sums, counts = np.zeros((parts, size, width), np.int64), np.zeros((parts, size), np.int64)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                for p, x in enumerate(now.cut(batch.column("v").slice(at, ROWS))):
                    index, _ = nearest(x, now.entries[p])
                    np.add.at(sums[p], index, x)
                    counts[p] += np.bincount(index, minlength=size)
        part, entry = np.nonzero(counts)
        columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "sums"])

    told = base.select("v").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    merged = told.select("part", "entry", "n", F.posexplode("sums").alias("at", "s")).groupBy("part", "entry", "at").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    out = books.entries.copy()
    for r in merged.collect():  # a number for each component of the codebooks at most
        out[r.part, r.entry, r["at"]] = r.s // r.n
    held.unpersist()
    return Codebooks(out)


def train(base: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> Codebooks | None:
    """Codebooks of ``quantised`` vectors, from the parts of the smallest vec_ids; None without vectors."""
    longest, high, low = base.agg(F.max(F.size("v")), F.max(F.array_max("v")), F.min(F.array_min("v"))).first()
    if longest is None:
        return None
    width = -(-longest // parts)
    most = max(abs(high or 0), abs(low or 0))
    if width * (2 * most) ** 2 * parts >= 1 << 63:
        raise OverflowError(f"components of {most} after scaling lead to distances beyond 64 bits")
    first = base.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").toArrow().column("v").combine_chunks()
    whole = _matrix(first, parts * width)
    books = Codebooks(whole.reshape(len(whole), parts, width).transpose(1, 0, 2).copy())
    for _ in range(rounds):
        books = _round(base, books)
    return books


def encode(base: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error) of ``quantised`` vectors: two hex digits (more beyond 256 entries) for each part, and the squared distance."""
    digits = max(2, len(f"{books.entries.shape[1] - 1:x}"))
    label = base.schema["label"].dataType.simpleString()
    kind = base.schema["vec_id"].dataType.simpleString()
    held = base.sparkSession.sparkContext.broadcast(books.entries)

    def run(batches):
        now = Codebooks(held.value)
        hexed = np.array([f"{i:0{digits}x}" for i in range(now.entries.shape[1])])
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                rows = batch.slice(at, ROWS)
                code, error = np.full(len(rows), "", f"U{digits * len(now.entries)}"), np.zeros(len(rows), np.int64)
                for p, x in enumerate(now.cut(rows.column("v"))):
                    index, far = nearest(x, now.entries[p])
                    code, error = np.char.add(code, hexed[index]), error + far
                yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("label"), pa.array(code.tolist(), pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return base.select("vec_id", "label", "v").mapInArrow(run, f"vec_id {kind}, label {label}, code string, error long")


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, v) of encoded vectors: the entries their codes name, one after another."""
    digits = max(2, len(f"{books.entries.shape[1] - 1:x}"))
    held = codes.sparkSession.sparkContext.broadcast(books.entries)
    kind = codes.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            index = [[int(c[i : i + digits], 16) for i in range(0, len(c), digits)] for c in batch.column("code").to_pylist()]
            flat = [np.concatenate([held.value[p][k] for p, k in enumerate(row)]) for row in index]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(flat, pa.list_(pa.int64()))], names=["vec_id", "v"])

    return codes.select("vec_id", "code").mapInArrow(run, f"vec_id {kind}, v array<long>")


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of ``vectors`` (vec_id, embedding, label).

    Vectors that are null or hold null or non-finite components take no part.  Shorter vectors, and lengths that ``parts`` does not divide,
    count as filled up with zeros.  Null vec_ids stay, and come last where codebooks start; of equal vec_ids the smaller vector comes first.
    Repeated rows are all encoded, alike.  Fewer vectors than ``entries`` give fewer entries; none gives no rows.
    Components so large that a distance leaves 64 bits are an error.  Null labels count as one label.
    """
    base = settle(quantised(vectors, scale))
    books = train(base, parts, entries, rounds)
    if books is None:
        return base.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    codes = settle(encode(base, books))
    total = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    joined = codes.alias("c").join(total.alias("t"), F.col("c.label").eqNullSafe(F.col("t.label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
