"""Borders that small texts never cross: stretches, shards, slices, segments, blocks; and shared rules by brute force."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from claimweave.llm import _common, byte_pairs, decontaminate, html_text, repeats, secrets, token_files, url_filter

from .test_operators import RANKS, ROWS, SHA, by_id, docs


def words(rng, n, letters="abcdefg"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))


def test_repeats_across_stretches(spark):
    """A text of over a megabyte with repeats inside, at the border of the stretches and in another document."""
    rng = random.Random(11)
    border = (1 << repeats._CHUNK_BITS) - 400
    noise = rng.randbytes(1_250_000).hex()[:1_250_000]
    passage, other = words(rng, 150), words(rng, 120)
    long = noise[: border - 200] + passage + noise[border - 200 + len(passage) :] + other
    rows = [(1, long), (2, "x " + passage + " y"), (3, other), (4, other[:399]), (5, "é" * 300 + passage)]
    got = by_id(repeats.remove_repeats(docs(spark, rows)))
    data = [t.encode() for _, t in rows]
    seen = defaultdict(int)
    for b in data:
        for s in range(len(b) - 399):
            seen[hash(b[s : s + 400])] += 1
    for row, b in zip(got, data, strict=True):
        hit = np.zeros(len(b), bool)
        for s in range(len(b) - 399):
            if seen[hash(b[s : s + 400])] > 1:
                hit[s : s + 400] = True
        kept = np.frombuffer(b, np.uint8)[~hit].tobytes()
        assert row[1:3] == (len(b), int(hit.sum())) and row[4] == SHA(kept) and row[5] == kept.decode("utf-8", "replace")
    assert got[0][3] == 2


def test_repeats_leave_text(spark):
    passage = words(random.Random(2), 140)
    rows = [(1, "one " + passage + " end"), (2, "two " + passage + " fin"), (3, None), (4, "short")]
    got = {r.doc_id: r.text for r in repeats.remove_repeats(docs(spark, rows)).collect()}
    assert got == {1: "oneend", 2: "twofin", 3: "", 4: "short"}


def test_no_shared_folder_on_a_cluster():
    class Conf:
        @staticmethod
        def get(*_):
            return None

    class Session:
        conf = Conf

        class sparkContext:  # noqa: N801
            master, applicationId = "spark://host:7077", "a"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        _common.shared_dir(Session)
    Session.sparkContext.master = "local[2]"
    assert _common.shared_dir(Session).startswith("file://")


def test_long_texts_are_encoded_whole(spark, monkeypatch):
    """Texts on both sides of a slice's border, and a word of several thousand bytes."""
    import base64

    import tiktoken

    monkeypatch.setattr(byte_pairs, "SLICE", 500)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    rows = [(1, words(rng, 400)), (2, ""), (3, words(rng, 50)), (4, "ab" * 4000), (5, words(rng, 300, "éßa"))]
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_pairs.encode(docs(spark, rows), RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in rows:
        ids = library.encode_ordinary(t)
        assert got[i] == (len(ids), SHA(np.array(ids, "<u4").tobytes()), SHA(t.encode()))


def test_many_shards(spark, monkeypatch):
    """Starts run on over files; a document of more ids than a shard has a file of its own."""
    monkeypatch.setattr(token_files, "SHARD", 60)
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    rng = random.Random(6)
    rows = [(i, words(rng, rng.choice([0, 3, 20, 200]))) for i in range(40)]
    files = token_files.write(docs(spark, rows), path)
    assert files.count() > 10
    start, expected = 0, []
    for i, t in rows:
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")
        expected.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert by_id(token_files.read(files)) == expected


@pytest.mark.parametrize("n", [511, 512, 513, 5000])
def test_rank_directory(n):
    ids = np.random.default_rng(n).integers(0, 7, n).astype(np.uint32)
    m, _ = token_files.WaveletMatrix.from_bytes(token_files.WaveletMatrix.build(ids).to_bytes(np.array([n])))
    for v in range(8):
        where = np.flatnonzero(ids == v)
        assert m.select(v, np.arange(len(where) + 1)).tolist() == [*where.tolist(), -1]
        assert all(m.rank(v, e) == (where < e).sum() for e in (0, 1, 63, 64, 511, min(512, n), n))
    assert sum(len(b) * 4 for b in m.before) <= sum(len(p) for p in m.bits) / 8 + 16 * len(m.bits)
    with pytest.raises(ValueError, match="end"):
        m.check(np.array([n]), int(ids[-1]) ^ 1)


def brute_boilerplate(pages):
    """Tokens outside articles inside a run of RUN tokens (or the whole stream) that another page of the host has outside its article, too."""
    streams = {}
    for i, url, html in pages:
        streams[i] = [(b, z, w) for b, (z, text) in enumerate(html_text.blocks(html)) for w in text.split(" ") if z != html_text.MAIN]
    seen = defaultdict(set)
    for i, url, _ in pages:
        w = [x[2] for x in streams[i]]
        k = min(html_text.RUN, len(w))
        for at in range(len(w) - k + 1 if w else 0):
            seen[html_text.host_of(url), tuple(w[at : at + k])].add(i)
    out = {}
    for i, url, _ in pages:
        w = [x[2] for x in streams[i]]
        k = min(html_text.RUN, len(w))
        hit = set()
        for at in range(len(w) - k + 1 if w else 0):
            if len(seen[html_text.host_of(url), tuple(w[at : at + k])]) > 1:
                hit.update(range(at, at + k))
        out[i] = (streams[i], hit)
    return out


def test_html_against_brute_force(spark):
    """Pages with and without articles on two hosts: notices, doubted blocks, unique blocks, copies of one article."""
    rng = random.Random(8)
    notices = [words(rng, n) for n in (5, 8, 9, 12, 30)]
    article = words(rng, 60)
    pages = []
    for i in range(60):
        mine = [f"<div>{rng.choice(notices)}</div>" if rng.random() < 0.5 else f"<p>{words(rng, rng.randint(1, 30))}</p>" for _ in range(rng.randint(0, 5))]
        if i % 2:
            inner = f"<p>{article if i % 3 else words(rng, 20)}</p>"
            doubt = f"<div class='widget'>{rng.choice(notices[2:]) if rng.random() < 0.6 else words(rng, 14)}</div>"
            html = f"<body>{mine[0] if mine else ''}<article>{inner}{doubt}<p>{rng.choice(notices)}</p></article>{''.join(mine[1:])}"
        else:
            html = "<body>" + "".join(mine)
        pages.append((i, f"http://{'ab'[i % 4 // 2]}.org/{i}", html))
    told = brute_boilerplate(pages)
    expected = {}
    for i, _, html in pages:
        found, (stream, hit) = html_text.blocks(html), told[i]
        main = any(z == html_text.MAIN for z, _ in found)
        parts = {b: [t] for b, (z, t) in enumerate(found) if main and z == html_text.MAIN}
        for at, (b, z, w) in enumerate(stream):
            if at not in hit and z == (html_text.DOUBT if main else html_text.OPEN):
                parts.setdefault(b, []).append(w)
        expected[i] = "\n\n".join(found[b][1] if main else " ".join(p) for b, p in sorted(parts.items()))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.extract(df).collect()} == expected
    copies = [i for i, _, h in pages if article in h]
    assert len(copies) > 5 and all(article in expected[i] for i in copies)
    assert any("widget" in h and notices[4] in h and notices[4] not in expected[i].split("\n\n")[1:2] for i, _, h in pages)


def brute_articles(pages):
    """The paragraphs that stay of each page (page, host, paragraphs), from its words alone."""
    runs = lambda ps: (w := " ".join(ps).split(" ")) and [tuple(w[i : i + 8]) for i in range(max(1, len(w) - 7))]
    different, out = defaultdict(set), {}
    for _, host, ps in pages:
        different[host].add(" ".join(ps))
    for i, host, ps in pages:
        have = [set(runs([x])) for x in different[host]]
        hit = set()
        for at, run in enumerate(runs(ps)):
            if len(have) >= 4 and 2 * sum(run in h for h in have) > len(have):
                hit.update(range(at, at + 8))
        at, gone, size = 0, [], len(" ".join(ps).split(" "))
        for p in ps:
            n = len(p.split(" "))
            gone.append(hit >= set(range(at, at + n)))
            at += n
        taken = sum(len(p.split(" ")) for p, g in zip(ps, gone, strict=True) if g)
        out[i] = [p for p, g in zip(ps, gone, strict=True) if not g or 2 * taken >= size]
    return out


@pytest.mark.parametrize("sent", [2_000_000, 0])
def test_html_common_to_articles(spark, monkeypatch, sent):
    """What most articles of a host print goes; what some quote, copies and versions of one article, and what few hosts' articles share stay."""
    monkeypatch.setattr(html_text, "SENT", sent)
    rng = random.Random(3)
    asks, about, quoted, long = words(rng, 12), words(rng, 20), words(rng, 11), words(rng, 90)
    pages = []
    for host, n, make in [
        ("most.org", 40, lambda i: [words(rng, 30), *[asks] * (i % 4 > 0), words(rng, 25), *[quoted] * (i % 5 < 2), *[about + " " + words(rng, 2)] * (i % 3 > 0)]),
        ("half.org", 8, lambda i: [words(rng, 40), *[asks] * (i % 2)]),
        ("two-parts.org", 9, lambda i: [words(rng, 50), asks + " " + about, about + " " + asks] if i % 2 else [words(rng, 50), asks, about]),
        ("versions.org", 7, lambda i: [long, words(rng, 10)]),
        ("few.org", 3, lambda i: [words(rng, 40), asks]),
        ("once.org", 1, lambda i: [words(rng, 40), asks]),
        ("long.org", 6, lambda i: [words(rng, 3000), asks, words(rng, 9)]),
        ("", 5, lambda i: [words(rng, 40), about]),
    ]:
        pages += [(len(pages) + i, host, make(i)) for i in range(n)]
    one = [words(rng, 60), asks]  # one article at 30 places is one of four, and what it shares with two is common
    pages += [(len(pages) + i, "copies.org", one if i < 30 else [words(rng, 60), *[asks] * (i < 32)]) for i in range(33)]
    shape = lambda ps: "<nav>menu</nav><article>" + "".join(f"<p>{p}</p>" for p in ps) + "</article>"
    df = spark.createDataFrame([(i, f"http://{h.upper()}/{i}?x" if h else None, shape(ps)) for i, h, ps in pages], "page_id long, url string, html string").repartition(5)
    expected = brute_articles(pages)
    assert {r.page_id: r.text for r in html_text.extract(df).collect()} == {i: "\n\n".join(ps) for i, ps in expected.items()}
    kept = {h: [[p in expected[i] for p in (asks, quoted, long)] for i, x, _ in pages if x == h] for h in {h for _, h, _ in pages}}
    assert not any(k[0] for h in ("most.org", "copies.org", "long.org") for k in kept[h]) and sum(k[1] for k in kept["most.org"]) == 16
    assert sum(k[0] for k in kept["half.org"]) == 4 and all(k[2] for k in kept["versions.org"]) and all(k[0] for k in kept["few.org"])


def test_html_host_is_the_same_in_spark(spark):
    urls = ["http://A.b/c", "x", None, "", "a://b://c", "http://h?x=://i", "s://h#f", "s://", "s://ho\nst/", "s://u:p@\u00c4.de:80/"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", html_text.host_in("url").alias("h")).collect()
    assert [r.h for r in rows] == [html_text.host_of(r.url) for r in rows]


def test_html_edges(spark, monkeypatch):
    """No table of known runs gives the same; empty tables, repeated rows, null ids and clashing columns."""
    rows = [(1, "http://a.org/1", "<body><div>a b c d e f g h i</div><div>own words one</div>", "k", 5), (2, "http://a.org/2", "<body><div>a b c d e f g h i</div>", "k", 5)]
    rows += [rows[0], (None, None, "<p>" + "long " * 200_000, "x", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, k string, covered int")
    monkeypatch.setattr(html_text, "SENT", 0)
    got = sorted((r.page_id or 0, r.text) for r in html_text.extract(df).collect())
    assert got == [(0, ("long " * 200_000).strip()), (1, "own words one"), (1, "own words one"), (2, "")]
    assert html_text.extract(df.limit(0)).count() == 0


def test_trigram_queries_are_needed():
    """Every match holds the trigrams of one alternative of its rule's query."""
    rng = random.Random(3)
    for kind, make in (("assign", lambda: rng.choice(["password", "PassWd", "SECRET", "token", "api_key", "APIKEY"]) + rng.choice(["", "'"]) + " " * rng.randint(0, 2) + ":" + "x" * 9), ("access", lambda: "AKIA" + "Z9" * 8)):
        rule = next(r for r in secrets.RULES if r.kind == kind)
        for _ in range(50):
            text = make()
            assert re.search(rule.pattern, text)
            assert any(all(t in (text.lower() if secrets.folds(rule) else text) for t in s) for s in secrets.query_of(rule))
    assert secrets.query_of(secrets.Rule("x", "(a|bcd)[0-9]+", 1)) == []
    assert secrets.query_of(secrets.Rule("x", "(abcd|bcde)[0-9]+z?", 1)) == [{"abc", "bcd"}, {"bcd", "cde"}]


def test_secrets_in_long_and_no_texts(spark):
    text = "clear words " * 60_000 + "token=abcdefgh1"
    got = {r.doc_id: r.spans for r in secrets.report(docs(spark, [(1, text), (2, None), (3, "AKIA")])).collect()}
    assert got == {1: f"assign:{len(text) - 15}:{len(text)}", 2: "", 3: ""}
    assert secrets.report(docs(spark, [])).count() == 0


def brute_hits(rows, bench, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = defaultdict(set)
    for i, t in bench:
        w = split(t)
        for s in range(max(len(w) - window, 0) + 1 if w else 0):
            windows[tuple(w[s : s + window])].add(str(i))
    out = []
    for i, t in rows:
        w, hit, items = split(t), set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if tuple(w[s : s + k]) in windows:
                    hit.update(range(s, s + k))
                    items |= windows[tuple(w[s : s + k])]
        out.append((i, len(w), len(hit), len(items), SHA(",".join(sorted(items)).encode()), bool(hit)))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, str(r)))


@pytest.mark.parametrize(("segment", "block"), [(16_000_000, 4_000_000), (3000, 400)])
def test_decontamination_against_brute_force(spark, monkeypatch, segment, block):
    """Also over many segments and several blocks of the benchmark."""
    monkeypatch.setattr(decontaminate, "SEGMENT", segment)
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    rng = random.Random(9)
    bench = [(i, words(rng, rng.choice([0, 2, 9, 10, 11, 40]), "abc")) for i in range(30)]
    rows = [*ROWS, *((100 + i, words(rng, 30, "abc") + " " + (rng.choice(bench)[1] if i % 3 else "") + " " + words(rng, rng.choice([0, 500]), "abc")) for i in range(40))]
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = by_id(decontaminate.report(docs(spark, rows), b).drop("spans"))
    assert got == brute_hits(rows, bench)
    split = lambda t: decontaminate.terms_of((t or "").encode()).tolist()
    near = {(i, str(j)) for i, t in rows if i for j, x in bench for w in [split(x)] for s in range(max(len(w) - 10, 0) + 1 if w else 0)
            if any(all(any(z == y and abs(p - c) <= 12 for p, z in enumerate(split(t))) for y in w[s : s + 10]) for c, y0 in enumerate(split(t)) if y0 == w[s])} if block == 400 else None
    if near is not None:
        told = decontaminate.search(decontaminate.index(docs(spark, rows)), b, slop=12).where("doc_id is not null").collect()
        assert {(r.doc_id, i) for r in told for i in r.near} == near
    kept = decontaminate.matches(docs(spark, rows), b, keep=["doc_id", "n", "band"])
    assert kept.columns == ["doc_id", "n", "band", "text", "n_words", "spans", "items", "near"] and kept.count() == len(rows)
    assert {r.doc_id: r.text for r in kept.collect()}[1] is None
    with pytest.raises(ValueError, match="items"):
        decontaminate.matches(docs(spark, rows), b, keep=["items"])


def test_urls_held_out():
    """Leave-one-out over the labelled table, and the table's own accuracy."""
    hits = 0
    for i, (url, label) in enumerate(url_filter.LABELLED):
        weights, bias = url_filter.train(url_filter.LABELLED[:i] + url_filter.LABELLED[i + 1 :], rounds=60)
        r = url_filter.features(*url_filter._parts(url))
        hits += (weights[r].sum() / np.sqrt(len(r)) + bias >= 0) == bool(label)
    assert hits / len(url_filter.LABELLED) > 0.7


def test_url_edges(spark):
    rows = [(1, "http://x.com/" + "a" * 100_000, "h"), (1, "http://x.com/" + "a" * 100_000, "h"), (None, "http://b.net/es/", "p")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = url_filter.judge(df).collect()
    assert len(got) == 3 and {(r.page_id, r.verdict, r.rule) for r in got} >= {(None, "block", "net/es/")}
    assert url_filter.judge(df.limit(0)).count() == 0
