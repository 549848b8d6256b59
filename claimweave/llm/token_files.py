"""Token ids in succinct files: one wavelet matrix for each shard.

A file holds the ids of consecutive documents as bit planes, most significant bit first; on each plane
the ids are stably parted by their bit.  A rank directory counts the set bits before each block of 512 bits (a
sixteenth of the plane); with it, ``access``, ``rank`` (counting) and ``select`` (occurrence lookup) take one step a
plane and look into one block.  Planes are compressed together in one zstd frame.
The bytes of a file travel in a binary column of a Parquet table, so that any store that Spark writes to
will do and a retried task leaves no half-written file.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from functools import cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import free_others, hold, settle

MAGIC = b"WVM1"
#: Ids of one file, unless a single document has more.
SHARD = 1_000_000
#: Words remembered per worker.
REMEMBERED = 1_500_000
_HEAD = struct.Struct("<4sIQQ")
#: Bytes of a block of the rank directory.
BLOCK = 64


class WaveletMatrix:
    """Access, counting and lookup over a sequence of ids."""

    def __init__(self, planes: list[np.ndarray], zeros: list[int], n: int):
        self.n, self.zeros, self.bits = n, zeros, planes
        self._before: list[np.ndarray] = []

    def _blocks(self, level: int) -> np.ndarray:
        """A plane as rows of BLOCK bytes, the last one filled up with zeros."""
        plane = self.bits[level]
        short = -len(plane) % BLOCK or (0 if len(plane) else BLOCK)
        return (np.concatenate([plane, np.zeros(short, np.uint8)]) if short else plane).reshape(-1, BLOCK)

    @property
    def before(self) -> list[np.ndarray]:
        """The rank directory of each plane: set bits before each block."""
        if not self._before:
            self._rows = [self._blocks(i) for i in range(len(self.bits))]
            counts = [np.bitwise_count(r.view(np.uint64)).sum(axis=1, dtype=np.uint32) for r in self._rows]
            self._before = [np.concatenate([[0], np.cumsum(c)]).astype(np.uint32) for c in counts]
        return self._before

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        depth = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        ids = ids.astype(np.uint16 if depth <= 16 else np.uint32)
        planes, zeros = [], []
        for level in range(depth - 1, -1, -1):
            one = (ids & ids.dtype.type(1 << level)).astype(bool)
            low, high = ids[~one], ids[one]
            planes.append(np.packbits(one, bitorder="little"))
            zeros.append(len(low))
            ids = np.concatenate([low, high])
        return cls(planes, zeros, len(ids))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Set bits of a plane before position ``at``: the directory, and what the block has before it."""
        ahead = self.before[level]
        block = np.minimum(at >> 9, len(self._rows[level]) - 1)
        words = self._rows[level].view(np.uint64)[block]
        bits = np.clip((at - (block << 9))[:, None] - np.arange(0, 512, 64), 0, 64)
        masks = np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << (bits & 63).astype(np.uint64)) - np.uint64(1))
        return ahead[block].astype(np.int64) + np.bitwise_count(words & masks).sum(axis=1, dtype=np.int64)

    def _place(self, level: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """Positions of the ``nth`` (from 0) bits of a kind on a plane: a search in the directory, then one block each."""
        ahead = self.before[level].astype(np.int64)
        if not bit:
            ahead = (np.arange(len(ahead)) << 9) - ahead
        block = np.searchsorted(ahead, nth, side="right") - 1
        rows = np.unpackbits(self._rows[level][block], axis=1, bitorder="little") == bit
        inside = np.cumsum(rows, axis=1, dtype=np.int32) == (nth - ahead[block] + 1)[:, None]
        return (block << 9) + np.argmax(inside, axis=1)

    def access(self, at) -> np.ndarray:
        """The ids at positions ``at``."""
        at = np.asarray(at, np.int64).copy()
        value = np.zeros(len(at), np.uint32)
        for level, zero in enumerate(self.zeros):
            one = (self.bits[level][at >> 3] >> (at & 7).astype(np.uint8)) & 1 if len(at) else np.zeros(0, np.uint8)
            ones = self._ones(level, at)
            value = (value << np.uint32(1)) | one
            at = np.where(one == 1, zero + ones, at - ones)
        return value

    def all(self) -> np.ndarray:
        """The whole sequence, from the last plane up: each plane puts its zeros and ones back in their places."""
        kind = np.uint16 if len(self.zeros) <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for level in range(len(self.zeros) - 1, -1, -1):
            one = np.unpackbits(self.bits[level], bitorder="little", count=self.n).view(bool)
            zero, back = self.zeros[level], np.empty(self.n, kind)
            back[~one] = out[:zero]
            back[one] = out[zero:] | kind(1 << (len(self.zeros) - 1 - level))
            out = back
        return out.astype(np.uint32)

    def _range(self, value: int, end: int) -> tuple[int, int]:
        lo, hi = 0, end
        if value >> len(self.zeros):
            return 0, 0
        for level, zero in enumerate(self.zeros):
            a, b = (int(x) for x in self._ones(level, np.array([lo, hi])))
            lo, hi = (zero + a, zero + b) if value >> (len(self.zeros) - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, value: int, end: int | None = None) -> int:
        """How often ``value`` occurs before position ``end``."""
        lo, hi = self._range(value, self.n if end is None else end)
        return hi - lo

    def select(self, value: int, number) -> np.ndarray | int:
        """The positions of the ``number``-th occurrences (from 0; an int or an array) of ``value``; -1 where there are fewer."""
        asked = np.atleast_1d(np.asarray(number, np.int64))
        lo, hi = self._range(value, self.n)
        there = (asked >= 0) & (asked < hi - lo)
        at = lo + asked[there]
        for level in range(len(self.zeros) - 1, -1, -1):
            one = value >> (len(self.zeros) - 1 - level) & 1
            at = self._place(level, one, at - self.zeros[level] if one else at)
        out = np.full(len(asked), -1, np.int64)
        out[there] = at
        return out if np.ndim(number) else int(out[0])

    def check(self, sizes: np.ndarray, end_id: int) -> None:
        """Raise unless every document of ``sizes`` ids ends with ``end_id``: seen by random access and by counting."""
        ends = np.cumsum(sizes)
        if len(ends) and ((self.access(ends - 1) != end_id).any() or self.rank(end_id) < len(ends) or ends[-1] != self.n):
            raise ValueError("a token file does not end its documents")

    def to_bytes(self, sizes: np.ndarray) -> bytes:
        """The file: a header, then one zstd frame of document sizes, zero counts and planes."""
        import zstandard

        body = sizes.astype("<u8").tobytes() + np.array(self.zeros, "<u8").tobytes() + b"".join(p.tobytes() for p in self.bits)
        return _HEAD.pack(MAGIC, len(self.zeros), self.n, len(sizes)) + zstandard.ZstdCompressor(level=1).compress(body)

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[WaveletMatrix, np.ndarray]:
        """The matrix and the sizes of its documents."""
        import zstandard

        magic, depth, n, docs = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        body = zstandard.ZstdDecompressor().decompress(data[_HEAD.size :])
        sizes = np.frombuffer(body, "<u8", docs).astype(np.int64)
        zeros = np.frombuffer(body, "<u8", depth, 8 * docs).astype(np.int64).tolist()
        at, size = 8 * (docs + depth), -(-n // 8)
        planes = [np.frombuffer(body, np.uint8, size, at + i * size) for i in range(depth)]
        return cls(planes, zeros, n), sizes


class _Words:
    """The tokenizers library, with the ids of words between ASCII white space remembered.

    White space is dropped by this tokenizer and never part of a token, so that pieces between it are
    encoded alike alone and in their text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[str, bytes] = {}
        self.closings: dict[str, bytes] = {}
        (self.bar,) = self.tokenizer.encode("|", add_special_tokens=False).ids

    def _whole(self, words: list[str]) -> list[bytes]:
        """The ids of each word; words go through the library together, between bars, whose token no other word has."""
        text = " | ".join(words)
        ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        cut = np.flatnonzero(ids == self.bar).tolist()
        flat = ids.tobytes()
        return [flat[4 * a : 4 * b] for a, b in zip([0, *(c + 1 for c in cut)], [*cut, len(ids)], strict=True)]

    def _learn(self, words: list[str]) -> None:
        """Encode new words.  Letters of ASCII, but for closing punctuation, are one run to the tokenizer: its
        model takes them as they are, in lower case."""
        tokenize, known, rest = self.tokenizer.model.tokenize, self.known, []
        for w in words:
            body = w.rstrip(".,;:!?")
            if body.isascii() and body.isalpha():
                coded = array("I", [x.id for x in tokenize(body.lower())]).tobytes()
                closing = w[len(body) :]
                if closing:
                    end = self.closings.get(closing)
                    if end is None:
                        end = array("I", self.tokenizer.encode(closing, add_special_tokens=False).ids).tobytes()
                        if len(closing) < 9:
                            self.closings[closing] = end
                    coded += end
                known[w] = coded
            elif "|" in w:
                known[w] = array("I", self.tokenizer.encode(w, add_special_tokens=False).ids).tobytes()
            else:
                rest.append(w)
        for at in range(0, len(rest), 200):
            some = rest[at : at + 200]
            known.update(zip(some, self._whole(some), strict=True))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts``, each closed by ``end_id``, and their numbers.

        A batch's distinct words are looked up once; their ids are then gathered by position.
        """
        split = pc.ascii_split_whitespace(texts)
        coded = split.values.dictionary_encode()
        words = coded.dictionary.to_pylist()
        fresh = list(filterfalse(self.known.__contains__, words))
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known.clear()
            fresh = words
        self._learn(fresh)
        found = list(map(self.known.__getitem__, words))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = np.cumsum(sizes) - sizes
        bounds = split.offsets.to_numpy().astype(np.int64)
        word = coded.indices.to_numpy()[bounds[0] : bounds[-1]]
        bounds -= bounds[0]
        each = sizes[word]
        ends = np.concatenate([[0], np.cumsum(each)])
        here = np.repeat(first[word] - ends[:-1], each) + np.arange(ends[-1])
        ids = np.frombuffer(b"".join(found), "<u4")[here]
        at = ends[bounds]
        return np.insert(ids, at[1:], np.uint32(end_id)), np.diff(at) + 1


@cache
def _words(path: str) -> _Words:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return _Words(path)


def write(docs: DataFrame, path: str, end_id: int = 1, partitions: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order and write token files.

    Returns the written table: part (in document order), shard (in order within it), doc_ids, n_tokens and
    file.  Rows of one doc_id are ordered by their text's hash; null doc_ids come first.
    """
    spark = docs.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = base.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h").select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def run(batches):
        free_others("token_files")
        coder = _words(path)
        hold("token_files", _words.cache_clear)
        shard = part = 0
        ids, sizes, names = np.zeros(0, np.uint32), np.zeros(0, np.int64), []

        def files(last: bool):
            """Shards of whole documents from what is held; what is left over waits for more."""
            nonlocal shard, ids, sizes, names
            while len(sizes) and (last or len(ids) > SHARD):
                ends = np.cumsum(sizes)
                n = max(1, int(np.searchsorted(ends, SHARD, side="right")))
                data = WaveletMatrix.build(ids[: ends[n - 1]]).to_bytes(sizes[:n])
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([names[:n]], pa.list_(pa.int64())), pa.array([int(ends[n - 1])], pa.int64()), pa.array([data], pa.binary())], names=["part", "shard", "doc_ids", "n_tokens", "file"])
                shard += 1
                ids, sizes, names = ids[ends[n - 1] :], sizes[n:], names[n:]

        for batch in batches:
            if not len(batch):
                continue
            part = batch.column("part")[0].as_py()
            for at in range(0, len(batch), 4096):
                rows = batch.slice(at, 4096)
                more, counts = coder.encode(rows.column("text"), end_id)
                ids, sizes = np.concatenate([ids, more]), np.concatenate([sizes, counts])
                names += rows.column("doc_id").to_pylist()
                yield from files(False)
        yield from files(True)

    return settle(ordered.mapInArrow(run, "part int, shard int, doc_ids array<long>, n_tokens long, file binary"))


def read(files: DataFrame, end_id: int = 1) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of each document in the files.

    Starts are running sums: over the few rows that tell each part's size, then over the shards of a part.
    """
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    bases, total = [], 0
    for part, size in sorted(sizes.collect()):  # one row for each of the parts asked for in write()
        bases.append((part, total))
        total += size
    base = files.sparkSession.createDataFrame(bases, "part int, base long")
    before = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ahead = files.select("part", "shard", F.sum("n_tokens").over(before).alias("ahead"))
    placed = files.join(F.broadcast(base), "part").join(ahead, ["part", "shard"]).select(F.col("base") + F.coalesce("ahead", F.lit(0)).alias("x"), "doc_ids", "file").toDF("start", "doc_ids", "file")

    def run(batches):
        for batch in batches:
            for start, names, data in zip(batch.column("start").to_pylist(), batch.column("doc_ids").to_pylist(), batch.column("file"), strict=True):
                matrix, sizes = WaveletMatrix.from_bytes(data.as_py())
                matrix.check(sizes, end_id)
                ids = matrix.all().astype("<u4")
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends - sizes, ends, strict=True)]
                columns = [pa.array(names, pa.int64()), pa.array(start + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """``read(write(docs))``.

    Null and empty texts are the end id alone.  Repeated rows are documents of their own.  An empty table gives
    an empty result.  A document longer than a shard gets a file to itself.
    """
    return read(write(docs, path, end_id), end_id)
