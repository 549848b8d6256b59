import datetime as dt

import pytest
from pyspark.sql import functions as F

from claimweave.functions import html, text, urls
from claimweave.operators import jobs


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'timestamp_ntz' if isinstance(v, dt.datetime) else 'string'}" for k, v in values.items()))
    return df.select(column).first()[0]


def test_canonical_urls(spark):
    cases = {
        "HTTPS://WWW.Example.org:443/a//b/?utm_source=x&b=2&a=1#frag": "https://www.example.org/a/b?a=1&b=2",
        "http://example.org/amp/story/print": "http://example.org/story",
        "http://example.org/story.amp.html?view=print&lang=de": "http://example.org/story.html?lang=de",
        "http://example.org": "http://example.org/",
        "mailto:x@example.org": None,
    }
    for url, expected in cases.items():
        assert one(spark, urls.canonical(F.col("u")), u=url) == expected, url
    assert one(spark, urls.canonical(F.col("u"), keep_language=False), u="http://e.org/a?lang=de") == "http://e.org/a"


def test_access_order(spark):
    status = lambda code, body, header="": one(spark, urls.access_status(F.col("s"), F.col("b"), F.col("h")), s=code, b=body, h=header)
    assert [status(401, ""), status(402, ""), status(451, ""), status(410, ""), status(503, "paywall"), status(200, ""), status(503, ""), status(200, "", "TRUE")] == ["LOGIN_REQUIRED", "PAYWALLED", "BLOCKED", "REMOVED", "PAYWALLED", "PUBLIC", "UNKNOWN", "PAYWALLED"]
    extraction = lambda access, code, n: one(spark, urls.extraction_status(F.col("a"), F.col("s"), F.col("n")), a=access, s=code, n=n)
    assert [extraction("PAYWALLED", 402, 0), extraction("PAYWALLED", 402, 5), extraction("PUBLIC", 204, 0), extraction("BLOCKED", 403, 9)] == ["METADATA_ONLY", "PARTIAL", "PENDING", "FAILED"]


def test_storage_paths(spark):
    path = lambda kind: one(spark, urls.storage_path(F.lit("NEWS_ARTICLE"), F.lit("-Src 1!"), F.lit("https://News.Example.org:8080/a"), F.lit("h"), F.col("k")), k=kind)
    assert path("application/PDF; x") == "raw-documents/news_article/src-1/news.example.org-8080/h.pdf"
    assert [path(k).rsplit(".")[-1] for k in ("text/xml", None or "", "application/ld+json", "text/plain")] == ["html", "html", "json", "txt"]


def test_every_segment_loses_its_infix(spark):
    url = "http://e.org/a.amp.html/b.print.PDF/amp/" + "x/" * 3
    assert one(spark, urls.canonical(F.col("u")), u=url) == "http://e.org/a.html/b.PDF/amp/x/x/x"
    long = "http://e.org/amp/" + "/".join(str(i) for i in range(120_000))
    assert one(spark, urls.canonical(F.col("u")), u=long) == long.replace("/amp", "")


def test_robots():
    txt = "User-agent: *\nDisallow: /private\nAllow: /private/open\n\nUser-agent: bot\nDisallow: /\n"
    assert not urls.robots_allowed(txt, "/private/x", "reader")
    assert urls.robots_allowed(txt, "/private/open/x", "reader")
    assert not urls.robots_allowed(txt, "/any", "mybot/1.0")
    assert urls.robots_allowed(None, "/any", "reader")
    assert urls.robots_allowed(txt, "/any", "reader (like bot)")  # the first token alone counts


def test_robots_on_a_column(spark):
    rules = urls.robots_rules("User-agent: *\nDisallow: /private*\nAllow: /private/open\nDisallow:\n", "reader/2")
    assert rules == [("/private", False), ("/private/open", True)]
    assert [one(spark, urls.robots_verdict(F.col("p"), rules), p=x) for x in ("/private/x", "/private/open/x", "/")] == [False, True, True]
    assert one(spark, urls.robots_verdict(F.col("p"), []), p="/")


def test_normalised_text(spark):
    assert one(spark, text.normalized(F.col("t")), t="Grüß' Éva’s  Café!") == "gru eva s cafe"
    assert one(spark, text.normalized_full(F.col("t")), t="Grüß' Éva’s  Café!") == "gru eva s cafe"


def test_spans_and_sentences(spark):
    t = "First one. Anna owns the firm. Last"
    assert tuple(one(spark, text.span(F.col("t"), F.col("e")), t=t, e="anna OWNS")) == (11, 20)
    assert one(spark, text.span(F.col("t"), F.col("e")), t=t, e="absent") is None
    assert one(spark, text.sentence(F.col("t"), F.lit(11), F.lit(20)), t=t) == "Anna owns the firm."


def meta(spark, page):
    return html.metadata(spark.createDataFrame([(page,)], "html string")).first()


def test_page_metadata(spark):
    page = '<html lang="de"><head><title>T &amp; U</title><meta property="og:title" content="Graph"></head><body><nav>menu</nav><article><h1>H</h1><script>x</script><p>A&nbsp;b</p></article></body></html>'
    m = meta(spark, page)
    assert (m.title, m.language, m.text, m.field_sources, m.extraction_status) == ("Graph", "de", "H A b", {"title": "openGraph", "language": "html", "text": "visibleContent"}, "SUCCESS")
    assert meta(spark, "").extraction_status == "FAILED" and meta(spark, None).extraction_status == "FAILED"
    assert meta(spark, "<title>only</title><body> </body>").extraction_status in ("METADATA_ONLY", "SUCCESS")
    assert meta(spark, "<body><p>text</p></body>").extraction_status == "PARTIAL"


def test_json_ld_in_graphs_and_lists(spark):
    page = """<script type="application/ld+json">{broken</script>
    <script type='application/ld+json'>{"@graph": [{"@type": "Person", "name": "P"}, {"@type": ["Thing", "NewsArticle"], "headline": " A &amp; B ", "author": [{"x": 1}, {"name": "Ann"}], "publisher": {"headline": "Pub"},
    "datePublished": "2024-03-01T10:00:00Z", "inLanguage": "de_CH", "description": 7}]}</script>
    <meta name="author" content="Other"><meta itemprop="headline" content="Item"><body><main><h1>x</h1>body</main></body>"""
    m = meta(spark, page)
    assert (m.title, m.author, m.publisher, m.description, m.language) == ("A & B", "Ann", "Pub", "7", "de-CH")
    assert m.published_at.isoformat().startswith("2024-03-01T10:00") and set(m.field_sources.values()) == {"jsonLd", "visibleContent"}


def test_precedence_and_dates(spark):
    page = """<html lang="fr-CH"><meta name="Author" content="first"><meta name="author" content='last'><meta property=article:published_time content="soon"><meta name="date" content="2024-01-01">
    <meta name="application-name" content="App"><meta name="twitter:title" content="Tw"><time itemprop="datePublished" datetime="2023-05-06"></time><body>b</body>"""
    m = meta(spark, page)
    assert (m.author, m.publisher, m.title, m.language) == ("last", "App", "Tw", "fr-CH")
    assert m.published_at.isoformat().startswith("2023-05-06") and m.field_sources["published_at"] == "schemaOrg"
    bad = meta(spark, page.replace("<time", "<tim"))
    assert bad.published_at is None and bad.field_sources["published_at"] == "openGraph"


def test_references(spark):
    for given, expected in {"&#65;&#x42;&#x1F600; &copy; &lt;": "AB😀 &copy; <", "&amp;lt; &#38;lt;": "&lt; &lt;", "&#0; &#xD800; &": "&#0; &#xD800; &", "plain": "plain"}.items():
        assert one(spark, html.decoded(F.col("t")), t=given) == expected


def test_months_overflow(spark):
    at = dt.datetime(2023, 1, 31, 10, 5)
    assert one(spark, jobs.next_run(F.col("t"), F.lit("MONTHLY")), t=at) == dt.datetime(2023, 3, 3, 10, 5)


def test_language_tags(spark):
    tag = lambda x: one(spark, text.language(F.col("t")), t=x)
    assert [tag("DE_ch"), tag("en"), tag("german"), tag("en-latin"), tag("de_CH_x")] == ["de-CH", "en", None, "en", "de"]


@pytest.mark.parametrize(
    ("base", "location", "want"),
    [
        ("https://a.org/x/y?q=1", "z", "https://a.org/x/z"),
        ("https://a.org/x/y", "../../../z?b=2&a=1", "https://a.org/z?a=1&b=2"),
        ("https://a.org", "z", "https://a.org/z"),
        ("https://a.org/x/y?q=1", "?r=2", "https://a.org/x/y?r=2"),
        ("https://a.org/x/y?q=1", "#part", "https://a.org/x/y?q=1"),
        ("https://a.org/x", "//B.org/w", "https://b.org/w"),
        ("http://a.org/x", "https://b.org:443/", "https://b.org/"),
        ("https://a.org/x", "mailto:someone@a.org", None),
        ("https://a.org/x", None, None),
    ],
)
def test_resolved(spark, base, location, want):
    row = spark.createDataFrame([(base, location)], "base string, location string").select(urls.resolved(F.col("base"), F.col("location")).alias("u")).first()
    assert row.u == want


def test_urls_beyond_ascii(spark):
    from claimweave.functions import urls

    told = {
        "HTTPS://Example.COM:443/news/story/?utm_source=newsletter&b=2&a=1&fbclid=abc#section": "https://example.com/news/story?a=1&b=2",
        "https://example.com/amp/news/story?amp=1": "https://example.com/news/story", "https://example.com/news/story/amp": "https://example.com/news/story",
        "https://example.com/news/story.print.html?view=print": "https://example.com/news/story.html", "https://example.ch/article?lang=de&utm_medium=social": "https://example.ch/article?lang=de",
        "http://bücher.example/straße?q=größe": "http://xn--bcher-kva.example/stra%C3%9Fe?q=gr%C3%B6%C3%9Fe", "https://日本語.jp": "https://xn--wgv71a119e.jp/", "https://faß.de/": "https://xn--fa-hia.de/",
        "https://e.org/a%2Fb/%7Ex/{y}?k=a%2Fb&e=~": "https://e.org/a%2Fb/%7Ex/%7By%7D?e=%7E&k=a%2Fb", "https://e.org/./a/%2E%2e/b/..": "https://e.org/", "https://e.org?b=1&a=2&A=1&a=1&ä=3": "https://e.org/?a=1&a=2&A=1&%C3%A4=3&b=1",
        "https://e.org/?a&b=&=c": "https://e.org/?=c&a=&b=", "https://e.org:0443/": "https://e.org/", "http://e.org:443/": "http://e.org:443/", "https://e.org:x/": None, "https://e.org:70000/": None, "https://:80/": None,
        "https://a b/": None, "ftp://e.org/": None, "mailto:a@b": None, "": None, "https://[::1]:8080/x": "https://[::1]:8080/x", "http:\\\\e.org\\a": "http://e.org/a", "http:/e.org/a": "http://e.org/a", " \thttps://e.org/\n ": "https://e.org/",
        "https://e%78.org/": "https://ex.org/", "https://u@E.org/": "https://u@e.org/", "https://e.org/?q=a+b%20c%": "https://e.org/?q=a+b+c%25",
    }
    rows = spark.createDataFrame([(u,) for u in told] + [(None,)], "url string")
    got = {r.url: r.c for r in rows.select("url", urls.canonical(F.col("url"), international=True).alias("c")).collect()}
    assert got == told | {None: None}
    assert rows.where("url = 'https://日本語.jp'").select(urls.canonical(F.col("url")).alias("c")).first().c is None


def test_terms_are_told_in_one_search(spark):
    """Whole words in any place; the filter normalises a text once, not once for each term."""
    texts = ["Not so", "it is NO  longer", "n'est pas", "knot", "none", "ends with n\u00edcht", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    hits = df.where(text.contains_any(text.normalized(F.col("text")), ("not", "no longer", "nest pas", "nicht")))
    assert [r.id for r in hits.orderBy("id").collect()] == [0, 1, 2, 5]
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1
    assert df.where(text.contains_any(F.col("text"), ())).count() == 0
