import re

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken

from claimweave.llm import byte_pairs, toxicity

from .test_operators import SHA, brute_components

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


@pytest.fixture
def folder(spark, tmp_path):
    """A folder of small tables: labels of no document, and one benchmark item."""
    spark.createDataFrame([(10_000, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], COLUMNS)


ROWS = [
    (1, None), (2, ""), (3, " "), (4, "one two three four five six seven"), (4, "one two three four five six seven"), (5, "one two three four five six seven"), (6, "pre " + ITEM.upper() + " post"),
    (7, "the password: hunter2hunter2 and AKIA" + "Z" * 16), (8, "plain words " * 20_000), (None, "no id at all here now"), (9, "alpha beta gamma"),
]


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "jaccard", "decontamination", "secrets", "byte_pairs"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == corpus_pipeline.COLUMNS, name
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > sizes[0] / 2
    assert corpus_pipeline.run(spark, sf).count() == sizes[-1]


def test_edges_of_each_stage(spark, folder):
    """Nulls, empty and long texts, repeated rows and clean documents, stage by stage."""
    docs = table(spark, ROWS)
    key = lambda rows: sorted(((r.doc_id, r.text) for r in rows), key=str)
    assert key(corpus_pipeline.drop_toxic(spark, docs, folder).collect()) == sorted(ROWS, key=str)
    kept = key(corpus_pipeline.drop_near_copies(spark, docs, folder).collect())
    roots = {c for _, n, c in brute_components(ROWS)}
    assert {i for i, _ in kept} == roots and len(kept) == len(ROWS) - 2
    assert key(corpus_pipeline.drop_contaminated(spark, docs, folder).collect()) == sorted((r for r in ROWS if r[0] != 6), key=str)
    masked = {r.doc_id: r for r in corpus_pipeline.mask_secrets(spark, docs, folder).collect()}
    assert masked[7].text == "the [SECRET] and [SECRET]" and masked[7].n_chars == len(masked[7].text) and masked[1].text is None and masked[8].text == dict(ROWS)[8]
    coded = corpus_pipeline.encode(spark, docs, folder).collect()
    assert len(coded) == len(ROWS) and {r.n_tokens for r in coded if r.doc_id in (1, 2)} == {0}


def test_empty_tables(spark, folder):
    docs = table(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name


def test_run_against_brute_force(spark, folder):
    """Without labels the toxicity models reject nothing; the rest is done by hand."""
    table(spark, ROWS).write.parquet(f"{folder}/documents.parquet")
    rows = [(i, t) for (i, t), (_, n, c) in zip(ROWS, brute_components(ROWS), strict=True) if c == i]
    rows = [r for n, r in enumerate(rows) if r not in rows[:n]]
    rows = [(i, t) for i, t in rows if not (t and ITEM in t.lower())]
    ranks = byte_pairs.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    secret = re.compile(r"password: [A-Za-z0-9+/_.=-]{8,}|AKIA[A-Z0-9]{12,}")
    expected = []
    for i, t in rows:
        text = secret.sub("[SECRET]", t or "")
        expected.append((i, len(library.encode_ordinary(text)), SHA(text.encode())))
    got = [(r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_clashing_names_are_refused(spark):
    docs = spark.createDataFrame([(1, "a", 1, 2)], "doc_id long, text string, score int, n_tokens int")
    with pytest.raises(ValueError, match="score"):
        toxicity.score(docs, toxicity.Model([{}, {}], [{}, {}]), keep=["doc_id", "score"])
    with pytest.raises(ValueError, match="n_tokens"):
        byte_pairs.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["n_tokens"])
    assert toxicity.score(docs, toxicity.Model([{}, {}], [{}, {}])).columns == ["doc_id", "score", "predicted"]
