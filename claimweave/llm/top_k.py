"""Exact top-k inner-product search by term-at-a-time accumulation.

Vectors become integer weights.  Queries and candidates are dealt into tiles of bounded size; in a
tile pair each dimension is a term whose postings (candidate, weight) are scattered, times the query's
weight, into dense score arrays.  Each tile keeps its k best by partition selection; tiles are merged
by rank.  Every query meets every candidate, in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import settle

CANDIDATES, QUERIES = 8192, 512
_FLOOR = np.iinfo(np.int64).min


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, for vectors of finite components alone."""
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * float(scale)).cast("long"))
    sound = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return vectors.where(sound & F.col("vec_id").isNotNull()).select("vec_id", x.alias("v"))


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores of dense shape (queries, candidates), one term (dimension) at a time."""
    scores = np.zeros((len(queries), len(candidates)), np.int64)
    for term in range(queries.shape[1]):
        asks = np.flatnonzero(queries[:, term])
        posts = np.flatnonzero(candidates[:, term])
        if len(asks) == len(queries) and len(posts) == len(candidates):
            scores += np.multiply.outer(queries[:, term], candidates[:, term])
        elif len(asks) and len(posts):
            scores[np.ix_(asks, posts)] += np.multiply.outer(queries[asks, term], candidates[posts, term])
    return scores


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    rows = column.combine_chunks()
    sizes = np.diff(rows.offsets.to_numpy())
    flat = rows.flatten().to_numpy()
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _best(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        q_id, c_id = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        q_row, c_row = left.column("row").to_numpy(), right.column("row").to_numpy()
        out: list[list] = [[], [], [], []]
        if len(q_id) and len(c_id):
            width = max(int(np.diff(t.column("v").combine_chunks().offsets.to_numpy()).max()) for t in (left, right))
            order = np.argsort(c_row)
            c_row, c_id, weights = c_row[order], c_id[order], _matrix(right.column("v"), width)[order]
            for at in range(0, len(q_id), 64):
                some = slice(at, at + 64)
                scores = accumulate(_matrix(left.column("v").slice(at, 64), width), weights)
                for r, q, row in zip(q_row[some], q_id[some], scores, strict=True):
                    own = np.searchsorted(c_row, r)
                    if own < len(c_row) and c_row[own] == r:
                        keep = np.ones(len(row), bool)
                        keep[own] = False
                        ids, row = c_id[keep], row[keep]
                    else:
                        ids = c_id
                    if len(row) > k:
                        least = -np.partition(-row, k - 1)[k - 1]
                        near = np.flatnonzero(row >= least)
                    else:
                        near = np.arange(len(row))
                    near = near[np.lexsort((ids[near], -row[near]))][:k]
                    out[0] += [r] * len(near)
                    out[1] += [q] * len(near)
                    out[2] += ids[near].tolist()
                    out[3] += row[near].tolist()
        return pa.table({n: pa.array(v, pa.int64()) for n, v in zip(("query_row", "query_id", "vec_id", "score"), out, strict=True)})

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """Each query's ``k`` highest integer inner products; ties go to the smaller vec_id.

    ``vectors`` has vec_id and embedding; queries are rows whose vec_id is divisible by ``every``, candidates
    all rows but the query's own.  Returns query_id, rank (from 1), vec_id, score.

    Vectors that are null or hold null or non-finite components take no part, nor do null vec_ids.  Shorter
    vectors count as padded with zeros.  Rows with one vec_id are queries and candidates each: one may find the other, and each has its own
    ranks.  Fewer candidates than ``k``: all.  No queries or candidates: no rows.
    """
    base = settle(quantised(vectors, scale).withColumn("row", F.monotonically_increasing_id()))
    total, asked = base.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0)).first()
    c_tiles, q_tiles = -(-total // CANDIDATES) or 1, -(-asked // QUERIES) or 1
    dealt = F.xxhash64("row")
    ask = base.where(F.col("vec_id") % every == 0).select("row", "vec_id", "v", F.pmod(dealt, F.lit(q_tiles)).alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(c_tiles - 1).cast("long"))).alias("c"))
    hold = base.select("row", "vec_id", "v", F.pmod(dealt, F.lit(c_tiles)).alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_tiles - 1).cast("long"))).alias("q"))
    found = ask.groupBy("q", "c").cogroup(hold.groupBy("q", "c")).applyInArrow(_best(k), "query_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
