"""Shared helpers: shared-folder tables, text hashing kernels, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


# --------------------------------------------------------------- shared tables
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a session inside one process gets a temporary folder; any other is an error, since a
    folder of the driver's machine is none that executors can read.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = _LOCAL.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="claimweave-"))
    return path.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage.

    A lost executor then costs only the tasks it was running: what is written stays readable by all.
    """
    path = f"{shared_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``settle`` wrote, once nothing reads it any more."""
    path = getattr(df, "_settled_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        with contextlib.suppress(Exception):
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration() if hasattr(df.sparkSession, "_jsc") else df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def row_key(*columns: str) -> Column:
    """A 64-bit key of a row's content.  Rows equal in ``columns`` share it, which every caller allows for."""
    return F.xxhash64(*[F.col(c) for c in columns], *[F.col(c).isNull() for c in columns])


def pinned(df: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of ``df`` alone, so that extra columns and clashing names cannot interfere."""
    return df.select(*[F.col(c) for c in columns])


# -------------------------------------------------------------- worker memory
_HELD: dict[str, Callable[[], None]] = {}


def hold(name: str, drop: Callable[[], None]) -> None:
    """Tell that this worker process keeps something for later tasks, and how to drop it."""
    _HELD[name] = drop


def free_others(name: str = "") -> None:
    """Drop what other operators' tasks have left in this worker process, since workers outlive tasks."""
    others = [n for n in _HELD if n != name]
    for n in others:
        _HELD.pop(n)()
    if others:
        trim()


def trim() -> None:
    """Give memory that is free in this worker process back to the system: idle workers live on beside the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


# ------------------------------------------------------------ hashing kernels
def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(max(n, 1), U64)
    out[0] = 1
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * U64(pow(base, done, 1 << 64))
        done += more
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(31))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(29)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(32)
    return x


#: One random 64-bit value for each byte, from a fixed seed: the same on every executor.
BYTE_VALUES = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=U64)


class Rolling:
    """Hashes of any substring of a byte string in constant time each, vectorised."""

    _cap = 0
    _pow = _inv = None

    @classmethod
    def _reach(cls, n: int) -> None:
        if n > cls._cap:
            cap = max(1 << 16, 2 * n)
            cls._pow, cls._inv, cls._cap = _powers(cap + 1, _BASE), _powers(cap + 1, _INVERSE), cap

    def __init__(self, data: np.ndarray):
        self._reach(len(data))
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(BYTE_VALUES[data] * self._pow[: len(data)], out=self.sums[1:])

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self._inv[start])

    def windows(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:-k]) * self._inv[:n])


#: Lower-cases A-Z and leaves every other byte.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
SHINGLE = 5


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word of ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased."""
    data = np.frombuffer(text.translate(ASCII_LOWER), np.uint8)
    if not len(data):
        return np.zeros(0, U64)
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return Rolling(data).between(edge[::2], edge[1::2])


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct five-word shingles as sorted 64-bit hashes; fewer words: the whole sequence; none: empty."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(words):
        return words
    k = min(SHINGLE, len(words))
    total = np.full(len(words) - k + 1, k, U64)
    for j in range(k):
        total = total * U64(0xD6E8FEB86659FD93) + words[j : len(words) - k + 1 + j]
    return np.unique(mix(total))


# -------------------------------------------------------- connected components
def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); root is the component's smallest node.

    Alternating large-star and small-star contraction; each round is a written table, and no node's
    neighbours are ever gathered in one row.  The least neighbours are written before the join, since Spark can
    split a hub's edges there only if the join's stage holds no aggregate.
    """
    a, b = F.col("a"), F.col("b")
    now = settle(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    mark = _mark(now)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = settle(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        paired = large.join(least, "u")
        small = paired.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        then = settle(small)
        discard(least)
        discard(now)
        now, before = then, mark
        mark = _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not converge in {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
