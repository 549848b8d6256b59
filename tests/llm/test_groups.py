"""Packing, vector codes and spelling variants against brute force, with nulls, empty and long input, ties, repeats and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from claimweave.llm import packing, queries, spelling, vector_codes

from .test_operators import ROWS, docs

WORDS = public_tokenizers.path("word_bpe_49k.json")


# ------------------------------------------------------------------- packing
def brute_place(lengths, capacity):
    """The rule by its definition: the whole sum of squares for each open sequence that has room, a new one if none has."""
    gaps, out = [], []
    for n in lengths:
        room = [g for g in range(len(gaps)) if gaps[g] >= n]
        if room:
            def squares(s):
                left = [gaps[i] - n if i == s else gaps[i] for i in range(len(gaps))]
                return sum(c * c for c in Counter(x for x in left if x).values())

            least = min((squares(s), gaps[s]) for s in room)
            s = max(s for s in room if (squares(s), gaps[s]) == least)
        else:
            s = len(gaps)
            gaps.append(capacity)
        out.append((capacity - gaps[s], n))
        gaps[s] -= n
    return out, gaps


def test_places_make_the_squares_smallest():
    rng = random.Random(1)
    for capacity in (1, 2, 7, 20):
        for _ in range(20):
            lengths = np.array(sorted((rng.randint(1, capacity) for _ in range(rng.randint(0, 40))), reverse=True), np.int64)
            sequence, offset = packing.place(lengths, capacity)
            expected, gaps = brute_place(lengths.tolist(), capacity)
            fills = np.bincount(sequence, lengths).astype(int) if len(lengths) else []
            assert sorted(fills) == sorted(capacity - g for g in gaps) and sorted(zip(offset, lengths, strict=True)) == sorted(expected)


def check_packed(rows, capacity):
    """Every sequence is gapless from 0 and no longer than ``capacity``."""
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing(spark, capacity):
    library = Tokenizer.from_file(WORDS)
    library.encode_special_tokens = True
    rng = random.Random(5)
    rows = [*ROWS, (8, " ".join(rng.choice(("run", "oak", "é", "12")) for _ in range(5000))), (9, "a " * 15), (10, "a " * 16)]
    cut = packing.pieces(docs(spark, rows), WORDS, capacity=capacity)
    told = packing.placed(cut, capacity).collect()
    coded = Counter((i, tuple([*library.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in rows)
    joined = defaultdict(list)
    for r in told:
        joined[r.row, r.doc_id].append(r)
    back = Counter()
    for (_, i), parts in joined.items():
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and [r.start for r in parts] == [capacity * k for k in range(len(parts))]
        assert all(r.length == capacity for r in parts[:-1]) and all(len(r.ids) == 4 * r.length for r in parts)
        back[i, tuple(np.frombuffer(b"".join(r.ids for r in parts), "<u4").tolist())] += 1
    assert back == coded
    made = check_packed(told, capacity)
    assert made <= -(-sum(r.length for r in told) // capacity) + 1
    for r in packing.sequences(packing.placed(cut, capacity)).collect():
        mine = sorted((x for x in told if x.sequence_id == r.sequence_id), key=lambda x: x.offset)
        assert bytes(r.ids) == b"".join(bytes(x.ids) for x in mine) and r.n_pieces == len(mine)
    assert packing.placed(packing.pieces(docs(spark, []), WORDS)).count() == 0


@pytest.mark.parametrize("group,spare", [(50, 1.05), (1000, 1.01)])
def test_many_groups_leave_no_loose_sequences(spark, monkeypatch, group, spare):
    monkeypatch.setattr(packing, "GROUP", group)
    rng = random.Random(2)
    rows = [(i, 0, rng.choice((2048, 3, rng.randint(1, 2048)))) for i in range(3000)]
    sizes = spark.createDataFrame(rows, "row long, piece int, length long")
    packed = packing.pack(sizes)
    told = packed.join(sizes, ["row", "piece"]).collect()
    assert len(told) == 3000
    made = check_packed(told, 2048)
    fills = Counter()
    for r in told:
        fills[r.sequence_id] += r.length
    assert len(fills) == made and sum(f <= 1024 for f in fills.values()) <= 1
    in_one = packing.place(np.array(sorted((r[2] for r in rows), reverse=True)), 2048)[0].max() + 1
    assert made <= spare * in_one


def test_packing_query(spark):
    """The digests of the query are those of the library's ids, and the sequences are few."""
    sf = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(WORDS)
    library.encode_special_tokens = True
    got = queries.op11_packing(spark, sf).collect()
    expected = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            some = np.array(ids[k : k + 2048], "<u4")
            expected.add((r.doc_id, k // 2048, k, len(some), zlib.crc32(some.tobytes())))
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == expected and len(got) == len(expected)
    assert check_packed(got, 2048) <= -(-sum(r.length for r in got) // 2048) + 1


# -------------------------------------------------------------- vector codes
def brute_codes(rows, parts, entries, rounds, scale):
    kept = []
    for i, v, label in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(scale * float(np.float32(x)))) for x in v], label))
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    kept = [(i, v + [0] * (width * parts - len(v)), label) for i, v, label in kept]
    ordered = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    books = [[v[p * width : (p + 1) * width] for _, v, _ in ordered[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign(v):
        return [min((far(v[p * width : (p + 1) * width], c), k) for k, c in enumerate(books[p])) for p in range(parts)]

    for _ in range(rounds):
        of = [defaultdict(list) for _ in range(parts)]
        for _, v, _ in kept:
            for p, (_, k) in enumerate(assign(v)):
                of[p][k].append(v[p * width : (p + 1) * width])
        books = [[[sum(c) // len(of[p][k]) for c in zip(*of[p][k], strict=True)] if k in of[p] else old for k, old in enumerate(books[p])] for p in range(parts)]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out = [(i, "".join(f"{k:02x}" for _, k in assign(v)), sum(d for d, _ in assign(v)), label) for i, v, label in kept]
    total = Counter()
    for _, _, e, label in out:
        total[label] += e
    return [(i, c, e, total[label], sha) for i, c, e, label in out], books


VECTORS = "vec_id long, embedding array<float>, label int, code string, v int, error long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "c", 1, 2) for i, v, label in rows], VECTORS)


def vector_rows(n, width=8, seed=3):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(width)], rng.choice((None, 1, 1, 1, 2))) for i in range(n)]
    odd = [(None, [0.5] * width, 1), (3, [0.25] * width, None), (3, [0.25] * width, None), (900, None, 1), (901, [None] + [1.0] * (width - 1), 2), (902, [float("nan")] * width, 1), (903, [float("inf")] * width, 1), (904, [1.0] * (width - 2), 1), (905, [], 2), (7, list(rows[7][1]), 9)]
    return rows + odd


@pytest.mark.parametrize("n,entries,width", [(60, 16, 8), (300, 256, 8), (5, 256, 6)])
def test_vector_codes(spark, n, entries, width):
    rows = vector_rows(n, width) if n > 10 else [(i, [float(i), -float(i), 0.1, 0.2, 0.3, -0.4][:width], i % 2) for i in range(n)]
    expected, books = brute_codes(rows, 4, entries, 4, 1024)
    got = vector_codes.compress(vectors(spark, rows), entries=entries)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
    base = vector_codes.quantised(vectors(spark, rows))
    trained = vector_codes.train(base, entries=entries)
    codes = vector_codes.encode(base, trained)
    assert vector_codes.decode(codes, trained).count() == len(expected)
    assert trained.entries.tolist() == books


def test_ties_go_to_the_lower_entry():
    index, far = vector_codes.nearest(np.array([[1], [5]]), np.array([[0], [2], [2]]))
    assert index.tolist() == [0, 1] and far.tolist() == [1, 9]


def test_decoded_vectors_lie_at_the_error(spark):
    rows = vector_rows(80)
    base = vector_codes.quantised(vectors(spark, [r for r in rows if r[0] is not None and r[0] not in (3, 7)]))
    books = vector_codes.train(base, entries=16)
    codes = vector_codes.encode(base, books)
    told = {r.vec_id: list(r.v) for r in vector_codes.decode(codes, books).collect()}
    plain = {r.vec_id: list(r.v) for r in base.collect()}
    for r in codes.collect():
        own = plain[r.vec_id] + [0] * (len(told[r.vec_id]) - len(plain[r.vec_id]))
        assert sum((a - b) ** 2 for a, b in zip(own, told[r.vec_id], strict=True)) == r.error


def test_no_vectors(spark):
    for rows in ([], [(1, None, 1), (2, [float("nan")], None)]):
        got = vector_codes.compress(vectors(spark, rows))
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and got.count() == 0
    with pytest.raises(OverflowError):
        vector_codes.compress(vectors(spark, [(1, [3e38, 0.0, 0.0, 0.0], 1)]))


# ------------------------------------------------------------------ spelling
def brute_words(rows, every, length, least):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= length and n >= least}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(words, times=2):
    near = defaultdict(list)
    for a, b in itertools.combinations(words, 2):
        if abs(len(a) - len(b)) < 2 and one_apart(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w in words:
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            if words[best] >= times * words[w]:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return out


@pytest.mark.parametrize("block", [1, 3, 64])
def test_near_words_in_blocks_of_any_size(spark, block):
    """Words over few letters, so that nearly all blocks are skewed, with short, long and accented ones."""
    rng = random.Random(block)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 6))): rng.choice((3, 5, 6, 12, 40)) for _ in range(250)}
    words |= {"x" * 300: 9, "x" * 301: 20, "x" * 150 + "y" + "x" * 149: 4, "×÷ßÀÿ": 3, "×÷ßàÿ": 7}
    given = spark.createDataFrame(list(words.items()), "word string, n long")
    got = sorted(map(tuple, spelling.group(given, block=block).collect()), key=str)
    assert got == sorted(brute_groups(words), key=str)


def test_variants(spark):
    rng = random.Random(8)
    stems = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöü") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(stems).title() if rng.random() < 0.2 else rng.choice(stems) for _ in range(n))
    rows = [*ROWS, *[(i, text(300)) for i in range(10, 40)], (10, text(50)), (None, text(80)), (50, "Straße ÀÉ×÷ " * 4), (51, "colour color colours " * 3), (52, "color " * 20)]
    for every, least in ((97, 3), (5, 2)):
        expected = brute_groups(brute_words(rows, every, 5, least))
        got = spelling.variants(docs(spark, rows), every=every, least=least)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str) and len(expected) > 40
    assert spelling.variants(docs(spark, [])).count() == spelling.variants(docs(spark, [(1, None), (2, "12 4")])).count() == 0


# ---------------------------------------------------------- postings of secrets
def test_posting_lists_are_intersected(spark, monkeypatch):
    """In segments of any size, the candidates are the rows that hold all trigrams of an alternative; repeated rows are one posting."""
    from pyspark.sql import functions as F

    from claimweave.llm import secrets

    rng = random.Random(5)
    bits = ["pass", "word", "PASSWORD", "secret", "Secre", "tok", "token=abcdefgh1", "AKIA", "AKI", "KIA", "api_key", "apikey: 123456789", " ", "wd"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 6))) for _ in range(150)] + ["password"] * 5
    for segment in (4, 4096):
        monkeypatch.setattr(secrets, "SEGMENT", segment)
        held = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("k", F.xxhash64("text"))
        lists = secrets.index(held)
        assert lists.groupBy("segment", "trigram").count().where("count > 1").isEmpty() and lists.agg(F.max(F.size("rows"))).first()[0] <= max(segment * 6, 60)
        got = {(r.k, kind) for r in secrets.candidates(lists).collect() for kind in r.kinds}
        expected = set()
        for r in held.collect():
            for rule in secrets.RULES:
                low = r.text.lower() if secrets.folds(rule) else r.text
                if any(all(t in low for t in s) for s in secrets.query_of(rule)):
                    expected.add((r.k, rule.kind))
        assert got == expected and len(expected) > 50
