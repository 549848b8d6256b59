"""The thin queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_pairs, decontaminate, html_text, jaccard, packing, repeats, secrets, spelling, token_files, top_k, toxicity, url_filter, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pairs.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents")).drop("spans")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(_table(spark, sf_dir, "embeddings"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages")).drop("probability")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("spans")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    told = cut.select("row", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.placed(told).drop("row")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_byte_pairs, op2_repeats, op3_top_k, op4_html_text, op5_secrets, op6_token_files, op7_toxicity, op8_url_filter, op9_decontaminate, op10_jaccard, op11_packing, op12_vector_codes, op13_spelling, pipeline)
}

_SPAN_SQL = """
  list_transform(range(1, len(m) + 1), lambda i: {{
    's': list_sum(list_transform(b[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)::BIGINT,
    'k': {order}, 'n': '{kind}', 'l': length(m[i]), 'v': length(v[i])}}) AS {kind}_all"""


def _spans_sql(rule: secrets.Rule, order: int) -> str:
    """Matches of a rule in DuckDB: pieces between matches and matches alternate."""
    pattern = rule.pattern.replace("'", "''").replace("\\x20", " ")
    source = f"SELECT rid, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_extract_all(text, '{pattern}', 1) AS v, string_split_regex(text, '{pattern}') AS b FROM d"
    return f"SELECT rid, {_SPAN_SQL.format(order=order, kind=rule.kind)} FROM ({source})"


def _secrets_sql() -> str:
    parts = [f"{r.kind} AS ({_spans_sql(r, i)})" for i, r in enumerate(secrets.RULES)]
    kept = [f"list_filter({r.kind}_all, lambda x: x.v >= {r.least})" for r in secrets.RULES]
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents), {', '.join(parts)},
f AS (SELECT doc_id, {', '.join(f'{k} AS {r.kind}' for k, r in zip(kept, secrets.RULES, strict=True))} FROM d {' '.join(f'JOIN {r.kind} USING (rid)' for r in secrets.RULES)}),
j AS (SELECT *, list_sort(list_concat(list_concat(assign, access), hex)) AS found FROM f),
t AS (SELECT *, array_to_string(list_transform(found, lambda x: x.n || ':' || x.s || ':' || (x.s + x.l)), ',') AS spans FROM j)
SELECT doc_id, len(assign) AS n_assign, len(access) AS n_access, len(hex) AS n_hex, coalesce(spans, '') AS spans, sha256(coalesce(spans, '')) AS base_sha256 FROM t"""


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Rounds of nearest entries and floored means, one after another."""
    far = "list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS (SELECT rid, x.p, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT rid, x.p, k, {far} AS d FROM x JOIN c{r} c ON c.p = x.p) x GROUP BY rid, x.p)")
        if r < rounds:
            steps.append(f"m{r} AS (SELECT p, k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (SELECT a.p, a.k, i, sum(x.v[i])::BIGINT AS s, count(*) AS n FROM a{r} a JOIN x ON x.rid = a.rid AND x.p = a.p, (SELECT unnest(range(1, w + 1)) AS i FROM size) GROUP BY a.p, a.k, i) GROUP BY p, k)")
            steps.append(f"c{r + 1} AS (SELECT c.p, c.k, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON m.p = c.p AND m.k = c.k)")
    return f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
size AS (SELECT max(len(v)) // {parts} AS w FROM e),
x AS MATERIALIZED (SELECT rid, p, v[p * w + 1:(p + 1) * w] AS v FROM e, size, (SELECT unnest(range({parts})) AS p)),
c0 AS (SELECT p, rid - 1 AS k, v FROM x WHERE rid <= {entries}),
{', '.join(s.replace(' AS (', ' AS MATERIALIZED (', 1) for s in steps)},
t AS (SELECT rid, string_agg(lpad(lower(to_hex(k)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY rid),
o AS (SELECT vec_id, label, code, error FROM e JOIN t USING (rid))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(n, ',' ORDER BY p, k, i)) FROM (SELECT p, k, unnest(v)::VARCHAR AS n, unnest(range(len(v))) AS i FROM c{rounds})) AS codebooks_sha256 FROM o"""


#: crc32 as a fold over bytes; its table comes from eight steps for each entry.
_SPELLING_SQL = r"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT list(list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
r AS (SELECT coalesce(doc_id::VARCHAR, 'null') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
g AS (SELECT d, run, count(*) AS n FROM r GROUP BY d, run),
b AS (SELECT *, hex(encode(d || ':' || run)) AS x FROM g),
h AS (SELECT d, run, n, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::UBIGINT)), lambda c, y: xor(c // 256, t[(xor(c % 256, y) + 1)::BIGINT])), 4294967295::UBIGINT) AS h FROM b, tab),
s AS (SELECT CASE WHEN h % 97 = 0 THEN run[:(h % len(run))::BIGINT] || run[(h % len(run))::BIGINT + 2:] ELSE run END AS word, n FROM h),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM s WHERE len(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
gone AS MATERIALIZED (SELECT word, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, unnest(range(1, len(word) + 1)) AS i FROM w)),
near AS (SELECT a.word, z.word AS other FROM gone a JOIN gone z ON a.i = z.i AND a.rest = z.rest AND a.word <> z.word AND len(a.word) = len(z.word) UNION SELECT rest, word FROM gone WHERE rest IN (SELECT word FROM w) UNION SELECT word, rest FROM gone WHERE rest IN (SELECT word FROM w)),
best AS (SELECT near.word, count(*) AS n_near, max(o.n) AS m, arg_min(o.word, (-o.n, encode(o.word))) AS other FROM near JOIN w o ON o.word = near.other GROUP BY near.word),
f AS MATERIALIZED (SELECT w.word, CASE WHEN m >= 2 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN m END AS form_n FROM w LEFT JOIN best USING (word)),
up(word, root) AS (SELECT word, word FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, root, f.n, f.n_near, f.form_n FROM f JOIN up ON up.word = f.word JOIN f last ON last.word = up.root WHERE last.form IS NULL"""


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}')"

ORACLE_SQL: dict[str, str] = {
    "op3_top_k": """
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM e q JOIN e c ON q.rid <> c.rid WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op5_secrets": _secrets_sql(),
    "op9_decontaminate": f"""
WITH dw AS (SELECT doc_id, {_WORDS_SQL.format(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')} AS w FROM documents),
bw AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item_id, {_WORDS_SQL.format(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS s, least(len(w), 10) AS k
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
occ AS (SELECT DISTINCT d.doc_id, d.i, k, win.item_id FROM
        (SELECT doc_id, i, kk, array_to_string(w[i:i + kk - 1], ' ') AS s FROM (SELECT doc_id, w, kk, unnest(range(1, len(w) - kk + 2)) AS i FROM dw, (SELECT DISTINCT k AS kk FROM win) WHERE len(w) >= kk)) d
        JOIN win ON win.s = d.s AND win.k = d.kk),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op12_vector_codes": _codes_sql(),
    "op13_spelling": _SPELLING_SQL,
    "op10_jaccard": f"""
WITH RECURSIVE dw AS (SELECT doc_id, {_WORDS_SQL.format(r'[^\x20\x09-\x0D]+')} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM dw WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
         GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM dw UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other)
SELECT dw.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, coalesce(l.n_links, 0)::BIGINT AS n_links
FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM link GROUP BY a) l USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)""",
}
