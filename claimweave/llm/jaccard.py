"""Exact Jaccard join of word shingles: size-banded tiles, bitmap signatures, sorted-array intersection.

Documents with one and the same shingle set are one representative.  A tile is compared pair by pair:
the set bits of two bitmap signatures bound the overlap from above, and only pairs that may still link
are intersected exactly.  To keep the number of tiles in proportion to the input, tiles are made inside
families: two linked sets share a shingle among the first quarter (plus one) of their shingles in any
common order, so sets are gathered by the connected components of "shares such a shingle"; frequent
shingles are put last in the order, which changes no result.  Families beyond one tile are dealt into
size bands, of which only neighbours can link, and bands into tiles of bounded size; each pair of tiles
is a task of its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import components, discard, free_others, mix, row_key, settle, shingle_set, trim

#: Shingles in a tile, more or less.
TILE = 1_500_000
#: Documents and shingles of the table that puts frequent shingles last.  It orders, and decides nothing.
SAMPLE, FREQUENT = 3000, 50_000
#: Sizes of one band differ by up to this factor; sets of the lowest OVERLAP of a band are in the band below, too.
BAND, OVERLAP = 3.0, 1.34
#: Shingles that a prefix has beyond those that linking needs, out of a hundred, and rounds of leaving.
EXTRA, ROUNDS = 10, 2
#: Members of families, in rows, up to which they are broadcast to the scan of the texts instead of joined by a shuffle.
BROADCAST = 200_000

NUMERATOR, DENOMINATOR = 75, 100


def fingerprint(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _described(batches):
    free_others()
    for batch in batches:
        sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k"), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.int64())], names=["doc_id", "k", "n", "fp"])
    trim()


def _shingles(batches):
    for batch in batches:
        sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
        if sets:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["key"])


def _prefixes(frequent: np.ndarray):
    """(key, fp): the first n // 4 + 1 shingles of each set and a tenth more, in order of frequency in the sample and hash."""

    def run(batches):
        free_others()
        seen: set[int] = set()
        for batch in batches:
            keys, owners = [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text)
                if not len(s):
                    continue
                fp = fingerprint(s)
                if fp in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(fp)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    late = frequent[at] == s
                    s = np.concatenate([s[~late], s[late]])
                n = len(s)
                keys.append(s[: n - -(-n * NUMERATOR // DENOMINATOR) + 1 + -(-n * EXTRA // 100)])
                owners.append(np.full(len(keys[-1]), fp, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners))], names=["key", "fp"])
        seen.clear()
        trim()

    return run


def _signatures(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """A bitmap of each set: one bit for each shingle, by hash."""
    out = np.empty((len(sets), bits // 8), np.uint8)
    for row, s in zip(out, sets, strict=True):
        one = np.zeros(bits, bool)
        one[(mix(s) & np.uint64(bits - 1)).astype(np.int64)] = True
        row[:] = np.packbits(one)
    return out.view(np.uint64)


def _may_link(bitmap: np.ndarray, sizes: np.ndarray, i: int, other: np.ndarray) -> np.ndarray:
    """Those of ``other`` whose overlap with i, by the bits that only one of both has, may suffice; some at a time, to bound memory."""
    step, kept = max(1, (1 << 19) // bitmap.shape[1]), []
    for at in range(0, len(other), step):
        some = other[at : at + step]
        # every bit that i has and j lacks stands for a shingle of i that is not in j
        alone = np.bitwise_count(bitmap[i] & ~bitmap[some]).sum(axis=1, dtype=np.int64)
        beyond = np.bitwise_count(bitmap[some] & ~bitmap[i]).sum(axis=1, dtype=np.int64)
        most = np.minimum(sizes[i] - alone, sizes[some] - beyond)
        kept.append(some[(DENOMINATOR + NUMERATOR) * most >= NUMERATOR * (sizes[i] + sizes[some])])
    return np.concatenate(kept) if kept else other


def links_of_tile(names: list[int], sets: list[np.ndarray], both: bool, side: np.ndarray, home: np.ndarray, copies: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Every link of a tile, or (``both``) between its sides 0 and 1, told as pairs that connect all that is linked
    and each set's number of linked rows.  A bitmap has at least as many bits as twice the shingles of the smaller set, up to 65536.

    Sets that are both guests of the tile's band (``home`` false) meet in the band below, and not here.  For the exact
    intersection each set is an array of places in the tile's sorted dictionary: the larger sets' arrays are looked up
    in the marked places of the smaller one.
    """
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    names, sets, side, home, copies, sizes = [names[i] for i in order], [sets[i] for i in order], side[order], home[order], copies[order], sizes[order]
    widths = np.array([1 << max(9, min(16, int(2 * n).bit_length())) for n in sizes])
    bitmap, width, first = np.empty((0, 0), np.uint64), 0, 0
    dictionary, places = np.unique(np.concatenate(sets), return_inverse=True)
    places = np.split(places.astype(np.int32), np.cumsum(sizes)[:-1])
    marked = np.zeros(len(dictionary), np.uint8)
    root, linked = np.arange(len(sets)), np.zeros(len(sets), np.int64)
    out = []
    for i in range(len(sets)):
        end = np.searchsorted(sizes, sizes[i] * DENOMINATOR // NUMERATOR, side="right")
        other = np.arange(i + 1, end)
        if both:
            other = other[side[other] != side[i]]
        if not home[i]:
            other = other[home[other]]
        if width != widths[i]:
            # sets by size: this width is that of the next sets, whose partners are up to a third larger
            width, first = widths[i], i
            last = np.searchsorted(widths, width, side="right") - 1
            bitmap = _signatures(sets[first : np.searchsorted(sizes, sizes[last] * DENOMINATOR // NUMERATOR, side="right")], width)
        other = _may_link(bitmap, sizes[first:], i - first, other - first) + first
        if not len(other):
            continue
        marked[places[i]] = 1
        starts = np.concatenate([[0], np.cumsum(sizes[other])[:-1]])
        common = np.add.reduceat(marked[np.concatenate([places[j] for j in other])], starts, dtype=np.int64)
        marked[places[i]] = 0
        other = other[DENOMINATOR * common >= NUMERATOR * (sizes[i] + sizes[other] - common)]
        linked[i] += copies[other].sum()
        linked[other] += copies[i]
        for j in other[root[other] != root[i]]:
            if root[j] != root[i]:
                out.append((names[i], names[j]))
                root[root == root[j]] = root[i]
    return out, [(names[i], int(linked[i])) for i in np.flatnonzero(linked)]


def _tile(table: pa.Table) -> pa.Table:
    names = table.column("fp").to_pylist()
    sets = [shingle_set(x.as_py()) for x in table.column("text")]
    side, home, copies = (table.column(c).to_numpy() for c in ("side", "home", "c"))
    cross = table.column("t")[0].as_py() != table.column("other")[0].as_py()
    found, linked = links_of_tile(names, sets, cross, side, home.astype(bool), copies) if len(names) > 1 else ([], [])
    a, b = [x for x, _ in found] + [x for x, _ in linked], [y for _, y in found] + [None] * len(linked)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array([0] * len(found) + [n for _, n in linked], pa.int64())})


def join(docs: DataFrame) -> DataFrame:
    """doc_id, k (a hash of the row's doc_id and text), n_shingles, component_id and n_links of each row of ``docs``.

    Two documents link when their sets of distinct five-word shingles have a Jaccard similarity of 0.75 or
    more; component_id is the smallest doc_id reachable, n_links the number of other rows that link with the row,
    copies included.  Links are all verified and counted in their tiles; what leaves a tile is no more than its
    sets: a spanning forest and the counts.  A document with fewer than five words has its
    whole sequence as its one shingle.  Null, empty and blank texts have no shingles and link with nothing.
    Repeated rows are members of one component.  Null doc_ids stay, and count only where no other id is there.
    """
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("k", row_key("doc_id", "text"))
    doc_kind = base.schema["doc_id"].dataType.simpleString()
    told = settle(base.mapInArrow(_described, f"doc_id {doc_kind}, k long, n long, fp long"))
    total = told.count()

    step = max(1, total // SAMPLE)
    sample = base.where(F.pmod(F.xxhash64("k"), F.lit(step)) == 0).mapInArrow(_shingles, "key long")
    often = sample.groupBy("key").count().where("count > 2").orderBy(F.desc("count"), "key").limit(FREQUENT).toArrow()
    frequent = np.sort(often.column("key").to_numpy().view(np.uint64))

    held = base.mapInArrow(_prefixes(frequent), "key long, fp long")
    sizes = told.where("n > 0").groupBy("fp").agg(F.max("n").alias("n"))
    least = F.floor(F.col("n") * (NUMERATOR * EXTRA) / (DENOMINATOR * 100)) + 1
    before = None
    for _ in range(ROUNDS):
        shared = settle(_shared(held).select("key", "fp"))
        if before is not None:
            discard(before)
        counts = shared.groupBy("fp").agg(F.count(F.lit(1)).alias("c"))
        held = shared.join(counts.join(sizes, "fp").where(F.col("c") >= least).select("fp"), "fp").select("key", "fp")
        before = shared
    edges = _shared(held).groupBy("fp", "first").agg(F.lit(1)).select(F.col("fp").alias("a"), F.col("first").alias("b"))
    return _finished(base, told, components(edges))


def _shared(held: DataFrame) -> DataFrame:
    """The distinct (key, fp) whose key other sets hold as well, with the key's first fp."""
    of_key = Window.partitionBy("key")
    return held.select("key", "fp", F.min("fp").over(of_key).alias("first"), F.max("fp").over(of_key).alias("last")).where("first <> last").select("key", "fp", "first").distinct()


def _finished(base: DataFrame, told: DataFrame, families: DataFrame) -> DataFrame:
    sets = told.where("n > 0").groupBy("fp").agg(F.max("n").alias("n"), F.min("k").alias("k"), F.count(F.lit(1)).alias("c"))
    members = families.select(F.col("node").alias("fp"), F.col("root").alias("family")).join(sets, "fp")
    level = F.log(F.col("n").cast("double")) / float(np.log(BAND))
    own, low = F.floor(level).cast("int"), F.floor(level - float(np.log(OVERLAP) / np.log(BAND))).cast("int")
    members = settle(members.select("*", F.explode(F.array_distinct(F.array(own, low))).alias("band")))
    whole = members.where(F.col("band") == own).groupBy("family").agg(F.sum("n").alias("total"))
    bands = members.groupBy("family", "band").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / TILE)).cast("int").alias("tiles"))
    plan = settle(bands.join(whole, "family").select("family", "band", (F.col("total") <= TILE).alias("small"), "tiles"))
    dealt = members.withColumn("home", F.col("band") == own).join(plan, ["family", "band"]).where("home or not small")
    t, n = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"), F.col("tiles")
    place = F.transform(F.sequence(F.lit(0), n - 1), lambda o: F.struct(F.col("band").alias("band"), F.least(o, t).alias("t"), F.greatest(o, t).alias("other"), (t > o).cast("int").alias("side"), F.col("home").cast("int").alias("home")))
    one = F.array(F.struct(F.lit(-1).alias("band"), F.lit(0).alias("t"), F.lit(0).alias("other"), F.lit(0).alias("side"), F.lit(1).alias("home")))
    placed = dealt.select("k", "fp", "c", "family", F.when(F.col("small"), one).otherwise(place).alias("places"))
    gathered = placed.groupBy("k", "fp", "c", "family").agg(F.flatten(F.collect_list("places")).alias("places"))
    gathered = settle(gathered)
    if gathered.count() <= BROADCAST:
        gathered = F.broadcast(gathered)
    texts = base.select("k", "text").join(gathered, "k")
    if _repeated(told):
        texts = texts.dropDuplicates(["k"])
    texts = texts.select("fp", "c", "family", F.explode("places").alias("p"), "text")
    tiles = texts.select("fp", "c", "family", "p.band", "p.t", "p.other", "p.side", "p.home", "text").groupBy("family", "band", "t", "other")
    links = settle(tiles.applyInArrow(_tile, "a long, b long, n long"))
    linked = components(links.where("b IS NOT NULL").select("a", "b"))
    counted = links.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("others"))

    owners = told.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("c"))
    in_component = owners.join(linked, owners.fp == linked.node).groupBy("root").agg(F.min("least").alias("component_id"))
    owned = owners.withColumnRenamed("fp", "node")
    by_link = linked.join(counted.withColumnRenamed("a", "node"), "node").join(owned, "node").join(in_component, "root")
    by_link = by_link.select(F.col("node").alias("fp"), "component_id", (F.col("c") - 1 + F.col("others")).alias("n_links"))
    copies = owners.where("c > 1").join(linked, owners.fp == linked.node, "left_anti").select("fp", F.col("least").alias("component_id"), (F.col("c") - 1).alias("n_links"))
    component = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")
    return told.join(by_link.union(copies), "fp", "left").select("doc_id", "k", F.col("n").alias("n_shingles"), component, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _repeated(told: DataFrame) -> bool:
    """Whether a row with shingles occurs more than once as a whole."""
    return bool(told.where("n > 0").groupBy("k").count().where("count > 1").limit(1).count())


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component of ``join``, that of the smallest doc_id; rows without shingles all stay."""
    names = docs.columns
    found = settle(join(docs))
    first = found.groupBy("component_id", F.when((F.col("n_shingles") == 0) | F.col("component_id").isNull(), F.col("k")).alias("alone")).agg(F.min(F.struct("doc_id", "k")).alias("f"))
    chosen = first.select(F.col("f.k").alias("__k"))
    repeated = _repeated(found.select("k", F.col("n_shingles").alias("n")))
    kept = docs.withColumn("__text", F.coalesce("text", F.lit(""))).withColumn("__k", row_key("doc_id", "__text")).join(chosen, "__k", "left_semi")
    if repeated:
        blank = F.col("__text").rlike(r"^[\x20\x09-\x0D]*$")
        kept = kept.where(blank).union(kept.where(~blank).dropDuplicates(["__k"]))
    return kept.select(*names)
