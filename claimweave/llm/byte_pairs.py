"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside each partition.

A pre-token's bytes become token-position rows.  A recursive query joins neighbouring rows with the
merge table and contracts each word's leftmost pair of least rank until none is left.  Decoding is
an ordered aggregation of the ids' bytes.  Words are encoded once per worker and remembered up to a
fixed number of entries.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import free_others, hold

#: Words remembered per worker; beyond it the memory starts anew.
REMEMBERED = 900_000
#: Contractions in one recursive query; words that need more go on in the next.
DEPTH = 48
#: From this many bytes a word's equal pairs are contracted together.
LONG = 96
#: Characters of text handled at a time.
SLICE = 3_000_000

_SHORT = """
WITH RECURSIVE s(i, w, p, t) AS (
  SELECT 0, w, p, t FROM state
  UNION ALL
  (WITH pairs AS (SELECT w, p, t, lead(t) OVER o AS n, lead(p) OVER o AS np FROM s WINDOW o AS (PARTITION BY w ORDER BY p)),
        best AS (SELECT w, min((c::{big} << {two}) | (p::{big} << {one}) | np) AS b FROM pairs JOIN merges ON l = t AND r = n GROUP BY w)
   SELECT i + 1, s.w, s.p, CASE WHEN s.p = ((b >> {one}) & {mask}) THEN (b >> {two})::INT ELSE t END
   FROM s JOIN best ON s.w = best.w WHERE s.p <> (b & {mask}) AND i < {depth})
)
SELECT w, p, t, i FROM s WHERE (w, i) IN (SELECT (w, max(i)) FROM s GROUP BY w) ORDER BY w, p
"""

# Every pair of the least rank at once, left to right without overlap, where the new token cannot
# take part in an earlier merge; otherwise the leftmost alone.
_LONG = """
WITH RECURSIVE s(i, w, p, t) AS (
  SELECT 0, w, p, t FROM state
  UNION ALL
  (WITH pairs AS (SELECT i, w, p, t, lead(t) OVER o AS n, row_number() OVER o AS place FROM s WINDOW o AS (PARTITION BY w ORDER BY p)),
        ranked AS (SELECT pairs.*, c, min(c) OVER (PARTITION BY w) AS least FROM pairs LEFT JOIN merges ON l = t AND r = n),
        hit AS (SELECT *, place - row_number() OVER (PARTITION BY w, c = least ORDER BY place) AS run FROM ranked WHERE least IS NOT NULL),
        turn AS (SELECT *, row_number() OVER (PARTITION BY w, c = least, run ORDER BY place) AS k,
                        row_number() OVER (PARTITION BY w, c = least ORDER BY place) AS k_all FROM hit),
        marked AS (SELECT turn.*, coalesce(c = least AND k % 2 = 1 AND (k_all = 1 OR NOT early), false) AS take FROM turn JOIN tokens ON id = least),
        shed AS (SELECT *, coalesce(lag(take) OVER (PARTITION BY w ORDER BY place), false) AS gone FROM marked)
   SELECT i + 1, w, p, CASE WHEN take THEN least ELSE t END FROM shed WHERE NOT gone AND i < {depth})
)
SELECT w, p, t, i FROM s WHERE (w, i) IN (SELECT (w, max(i)) FROM s GROUP BY w) ORDER BY w, p
"""

_DECODE = "SELECT d, string_agg(bytes, '' ORDER BY p) AS text FROM ids JOIN tokens ON id = t GROUP BY d"


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a ``.tiktoken`` file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Codec:
    """Encoder and decoder over one DuckDB connection."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.pattern = regex.compile(pattern)
        self.ranks = ranks = read_ranks(path)
        splits = [(ranks[b[:i]], ranks[b[i:]], c) for b, c in ranks.items() for i in range(1, len(b)) if b[:i] in ranks and b[i:] in ranks]
        left, right, made = (np.array(x, np.int32) for x in zip(*splits, strict=True)) if splits else (np.zeros(0, np.int32),) * 3
        early = np.zeros(max(ranks.values(), default=0) + 1, bool)
        for part in (left, right):
            early[part[made < part]] = True
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.first = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.con = duckdb.connect(":memory:")
        self.con.execute("SET threads = 1")
        self.con.execute("SET memory_limit = '200MB'")
        self.con.execute("SET enable_progress_bar = false")
        merges = pa.table({"l": left, "r": right, "c": made})  # noqa: F841  read by name
        tokens = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "bytes": [b.decode("latin-1") for b in ranks], "early": [bool(early[i]) for i in ranks.values()]})  # noqa: F841
        self.con.execute("CREATE TABLE merges AS SELECT * FROM merges")
        self.con.execute("CREATE TABLE tokens AS SELECT * FROM tokens")
        self.known: dict[str, bytes] = {}

    def _contract(self, words: list[bytes], query: str) -> list[bytes]:
        sizes = np.array([len(b) for b in words])
        wide = int(sizes.max()) >= 1 << 22
        one, big = (40, "HUGEINT") if wide else (22, "BIGINT")
        sql = query.format(big=big, one=one, two=2 * one, mask=(1 << one) - 1, depth=DEPTH)
        w = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        p = np.arange(len(w), dtype=np.int32) - np.repeat(np.cumsum(sizes) - sizes, sizes).astype(np.int32)
        t = self.first[np.frombuffer(b"".join(words), np.uint8)]
        done = [b""] * len(words)
        while len(w):
            self.con.register("state", pa.table({"w": w, "p": p.astype(np.int32), "t": t}))
            rows = self.con.sql(sql).to_arrow_table()
            w, p, t, i = (rows.column(c).to_numpy() for c in range(4))
            cut = np.flatnonzero(np.diff(w, prepend=-1))
            open_ = i == DEPTH
            flat, ends = t.astype("<u4").tobytes(), (4 * np.append(cut[1:], len(t))).tolist()
            start = 0
            for at, end in zip(w[cut].tolist(), ends, strict=True):
                done[at] = flat[start:end]
                start = end
            w, p, t = w[open_], p[open_], t[open_]
        return done

    def learn(self, words: list[str]) -> None:
        """Encode ``words`` that are not known yet."""
        raw = [x.encode("utf-8", "surrogatepass") for x in words]
        whole = [self.ranks.get(b) for b in raw]
        rest = [i for i, r in enumerate(whole) if r is None]
        for i, r in enumerate(whole):
            if r is not None:
                self.known[words[i]] = np.array([r], "<u4").tobytes()
        for part, query in (([i for i in rest if len(raw[i]) < LONG], _SHORT), ([i for i in rest if len(raw[i]) >= LONG], _LONG)):
            for some in _slices(part, lambda i: len(raw[i]), 400_000):
                for i, tokens in zip(some, self._contract([raw[i] for i in some], query), strict=True):
                    self.known[words[i]] = tokens

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        split = [self.pattern.findall(x) for x in texts]
        known = self.known
        fresh: set[str] = set()
        for words in split:
            fresh.update(filterfalse(known.__contains__, words))
        if len(known) + len(fresh) > REMEMBERED:
            known.clear()
            fresh.update(*split)
        if fresh:
            self.learn(list(fresh))
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def decode(self, coded: list[bytes]) -> list[bytes]:
        """Each document's bytes from its ids."""
        ids = np.frombuffer(b"".join(coded), "<u4").astype(np.int32)
        sizes = [len(x) // 4 for x in coded]
        d = np.repeat(np.arange(len(coded), dtype=np.int32), sizes)
        self.con.register("ids", pa.table({"d": d, "p": np.arange(len(ids), dtype=np.int64), "t": ids}))
        out = [b""] * len(coded)
        rows = self.con.sql(_DECODE).to_arrow_table()
        for i, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
            out[i] = text.encode("latin-1")
        return out


def _slices(items: list, size, limit: int):
    """Lists of ``items`` of up to ``limit`` in total ``size``, each of one item at least."""
    some: list = []
    total = 0
    for x in items:
        n = size(x)
        if some and total + n > limit:
            yield some
            some, total = [], 0
        some.append(x)
        total += n
    if some:
        yield some


@cache
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process."""
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str] | None = None, texts: bool = False) -> DataFrame:
    """Encode each row's ``text`` and decode the ids again.

    Returns the columns ``keep`` (default doc_id), n_tokens, ids_sha256, decoded_sha256 and, with
    ``texts``, the ids themselves as ``token_ids`` (array of int).  Null and empty texts have no ids and
    the digests of nothing.  Special tokens' strings are ordinary text.  Repeated rows stay; any length
    of text or word is encoded whole.
    """
    keep = keep or ["doc_id"]
    if clash := {"n_tokens", "ids_sha256", "decoded_sha256", "token_ids"} & set(keep):
        raise ValueError(f"cannot keep columns of these names: {sorted(clash)}")
    base = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("__text"))

    def run(batches):
        free_others("byte_pairs")
        worker = codec(path, pattern)
        hold("byte_pairs", codec.cache_clear)
        for batch in batches:
            column = batch.column(len(keep))
            at = 0
            for some in _slices([x.as_py() for x in column], len, SLICE):
                coded = worker.encode(some)
                plain = worker.decode(coded)
                rows = batch.slice(at, len(some))
                at += len(some)
                out = [rows.column(i) for i in range(len(keep))]
                out += [
                    pa.array([len(x) // 4 for x in coded], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in coded]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in plain]),
                ]
                names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
                if texts:
                    out.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in coded], pa.list_(pa.int32())))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1])
    more = ", token_ids array<int>" if texts else ""
    return base.mapInArrow(run, f"{kinds}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
