"""Feeds by the JVM's XML functions against the Python parser."""

from pyspark.sql import functions as F

from sparkwire.sources import feeds as S
from sparkwire.sources import feedxml
from tests.test_engine import NOW, documents, item, rss

ATOM = b"""<?xml version="1.0" encoding="utf-8"?>
<feed xmlns="http://www.w3.org/2005/Atom"><title>Feed</title><updated>2026-01-01T00:00:00Z</updated>
<entry><title type="html">One &amp;amp; two</title><link rel="self" href="https://x.example/self"/><link href="https://x.example/t"/><updated>2026-09-28T09:00:00+02:00</updated><id>i</id><author><name>Ann</name><email>a@x</email></author><summary>S</summary></entry>
<entry><title>No link</title><published>2026-09-28T07:15:00.5Z</published><content>long</content></entry>
<entry><title>Only edit</title><link rel="edit" href="https://x.example/e"/><published>nonsense</published><created>2026-09-27</created></entry></feed>"""
RDF = b"""<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>c</title></channel>
<item><title>R</title><link>https://x.example/r</link><dc:date>2026-09-28T00:00:00Z</dc:date><dc:creator>Cy</dc:creator></item></rdf:RDF>"""
FULL = rss(
    item("A &amp; B", "https://x.example/a"), item("<![CDATA[C <b>d</b>]]>", " https://x.example/c ", text="<![CDATA[<p>Hi <item> there</p>]]>"),
    '<title/><title>second</title><link>https://x.example/d</link><guid isPermaLink="false">g-1</guid><author>x@y</author><pubDate>28 Sep 26 07:15 EST</pubDate><description></description><content:encoded xmlns:content="q">enc</content:encoded>',
    *[item("T", f"https://x.example/{i}", date) for i, date in enumerate(("Mon, 28 Sep 2026 07:15:00 +0200", "Mon, 28 Sep 2026 07:15 GMT", "28 September 2026 07:15:09 PDT", "2026-09-28 07:15", "2026-13-99", "yesterday", "Mon, 28 Sep 2026 07:15:00 UT", ""))],
)
CASES = {
    "rss": FULL, "atom": ATOM, "rdf": RDF, "empty": rss(), "cut": FULL[: FULL.rindex(b"<item>") + 20], "cut-early": rss(item("A", "https://x.example/a"))[:60], "entity": b"<!DOCTYPE x [<!ENTITY a 'b'>]><rss/>", "none": None,
    "fault": b"<rss><channel><language>de</language><item><title>ok</title><link>https://x.example/ok</link></item><item><title>bad</titel></item><item><title>after</title></item></channel></rss>", "junk": b"<<this is not", "plain": b"plain words",
    "latin": '<?xml version="1.0" encoding="ISO-8859-1"?><rss><channel><item><title>Caf\xe9</title><link>https://x.example/l</link></item></channel></rss>'.encode("latin-1"), "bom": b"\xef\xbb\xbf" + FULL, "zero": b"",
}


def test_equals_the_python_parser(spark):
    docs = documents(spark, *CASES.items()).repartition(3)
    names = [f.name for f in S.entries(docs).schema]
    rows = lambda df: {(r["feed"], r["entry"]): tuple(r[c] for c in names) for r in df.collect()}
    want, got = rows(S.entries(docs)), rows(feedxml.entries(docs))
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == want[k], k
    assert sum(k[1] is not None for k in got) > 35


def test_no_python_worker_and_equal_articles(spark):
    nested = b'<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="xhtml"><div>Big <b>news</b> today</div></title><link href="https://x.example/n"/><content type="xhtml"><div>a <i>b</i></div></content></entry></feed>'
    docs = documents(spark, ("n", nested), *CASES.items())
    e = feedxml.entries(docs)
    plan = e._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapInPandas" not in plan
    columns = ["feed", "title", "canonical_url", "published_at", "author", "rank", F.regexp_replace("summary", r"\s", "").alias("summary")]
    rows = lambda x: sorted(map(repr, map(tuple, S.articles(x, NOW).select(*columns).collect())))
    assert rows(e) == rows(S.entries(docs))
