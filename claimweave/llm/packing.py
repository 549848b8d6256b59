"""Sum-of-squares packing of documents into sequences of bounded length.

Documents become token ids, closed by an end id; longer ones are cut into pieces of a sequence's length.  Pieces
are dealt into groups of bounded size.  Inside a group they go from the longest to the shortest, each into the open
sequence that leaves the sum of the squared counts of open sequences per residual gap smallest; a new sequence is
opened where none has room.  What a group leaves at most half full goes on as pieces of the next level, until one
level merges nothing more.  Ids stay in the table they were written to: packing moves numbers alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import free_others, hold, settle
from .token_files import _words

#: Pieces of one packing group on average, and rows of text that are encoded at once.
GROUP, ROWS = 4096, 2048


def pieces(docs: DataFrame, path: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Written table of row, doc_id, piece (from 0), start, length and ids (little-endian unsigned 32-bit) of ``docs`` (doc_id, text).

    Each row is a document of its own with a number ``row``, so repeated rows and repeated or null doc_ids stay apart.  A null or empty text
    is the end id alone.  Texts of any length are encoded whole; only documents of more than ``capacity`` ids are cut.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches):
        free_others("packing")
        coder = _words(path)
        hold("packing", _words.cache_clear)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                rows = batch.slice(at, ROWS)
                ids, sizes = coder.encode(rows.column("text"), end_id)
                ids = np.ascontiguousarray(ids, "<u4")
                n = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(sizes)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, sizes[doc] - start)
                ends = np.cumsum(length)
                for a in range(0, len(doc), GROUP):
                    some = slice(a, a + GROUP)
                    first, last = int(ends[a] - length[a]), int(ends[some][-1])
                    bounds = np.concatenate([[0], ends[some] - first]).astype(np.int32) * 4
                    coded = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(ids[first:last])])
                    which = pa.array(doc[some])
                    yield pa.RecordBatch.from_arrays([rows.column("row").take(which), rows.column("doc_id").take(which), pa.array(piece[some].astype(np.int32)), pa.array(start[some]), pa.array(length[some]), coded], names=["row", "doc_id", "piece", "start", "length", "ids"])

    return settle(base.mapInArrow(run, f"row long, doc_id {kind}, piece int, start long, length long, ids binary"))


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence from 0, offset) of pieces in the order given.

    Gaps are told apart by size alone, so that a step looks at one count for each size; of the sequences of a gap the last opened is taken, and
    of equal sums the smallest gap.
    """
    count = np.zeros(capacity, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity)]
    sequence, offset, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, n in enumerate(lengths.tolist()):
        there = count[n:]
        # What the sum of squares becomes less what it is: 1 - 2 N(gap) for the gap that goes, 1 + 2 N(rest) for the one that comes.
        change = 2 * count[: capacity - n] + 1
        change[:1] = 0
        change = np.where(there > 0, change + 1 - 2 * there, np.iinfo(np.int64).max)
        k = int(np.argmin(change)) if len(change) else 0
        if len(change) and there[k]:
            gap = n + k
            s = open_at[gap].pop()
            count[gap] -= 1
        else:
            gap, s, made = capacity, made, made + 1
        sequence[i], offset[i] = s, capacity - gap
        if gap > n:
            count[gap - n] += 1
            open_at[gap - n].append(s)
    return sequence, offset


def _packed(items: DataFrame, capacity: int, level: int) -> DataFrame:
    """``items`` (item, length) with their sequence_id ("level", group and number in one long) and offset there."""
    total = items.count()
    groups = -(-total // GROUP) or 1
    dealt = items.withColumn("group", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(groups)))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        item, length = table.column("item").to_numpy(), table.column("length").to_numpy()
        order = np.lexsort((item, -length))
        sequence, offset = place(length[order], capacity)
        name = (level << 58) + key[0].as_py() * (4 * GROUP) + sequence
        fill = np.bincount(sequence, length[order]).astype(np.int64)[sequence]
        return pa.table({"item": pa.array(item[order]), "sequence_id": pa.array(name), "offset": pa.array(offset), "fill": pa.array(fill)})

    return settle(dealt.groupBy("group").applyInArrow(run, "item long, sequence_id long, offset long, fill long"))


def pack(sizes: DataFrame, capacity: int = 2048) -> DataFrame:
    """(row, piece, sequence_id, offset) of pieces (row, piece, length of 1 to ``capacity``); no pieces: no rows.

    A group packs 4,096 pieces on average and leaves one sequence at most half full; those are packed on, as wholes, so that groups
    cost no sequences of their own.  Equal pieces are told apart by row and piece, which must be unique.
    """
    named = settle(sizes.select("row", "piece", F.col("length").cast("long").alias("length"), F.monotonically_increasing_id().alias("item")))
    placed = _packed(named.select("item", "length"), capacity, 0)
    level = 0
    while True:
        loose = placed.where(F.col("fill") <= capacity // 2).select(F.col("sequence_id").alias("item"), F.col("fill").alias("length")).distinct()
        loose = settle(loose)
        before = loose.count()
        if before < 2:
            break
        level += 1
        again = _packed(loose, capacity, level)
        if again.agg(F.countDistinct("sequence_id")).first()[0] == before:
            break
        moved = again.select(F.col("item").alias("sequence_id"), F.col("sequence_id").alias("to"), F.col("offset").alias("shift"), F.col("fill").alias("full"))
        joined = placed.join(moved, "sequence_id", "left")
        placed = settle(joined.select("item", F.coalesce("to", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0).cast("long"))).alias("offset"), F.coalesce("full", "fill").alias("fill")))
    return named.join(placed, "item").select("row", "piece", "sequence_id", "offset")


def placed(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """``cut`` (from ``pieces``, or a projection of it with row, piece and length) with sequence_id and offset."""
    return cut.join(pack(cut.select("row", "piece", "length"), capacity), ["row", "piece"])


def sequences(where: DataFrame) -> DataFrame:
    """(sequence_id, n_pieces, ids) of ``placed`` pieces with their ids: the ids of each sequence in one run, none longer than a sequence."""
    lists = where.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("l"))
    return lists.select("sequence_id", F.size("l").alias("n_pieces"), F.aggregate("l", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
