import pytest
from pyspark.sql import functions as F

from sparkwire.functions import layout
from sparkwire.functions import text as X
from sparkwire.functions import urls as N


@pytest.mark.parametrize(
    "url, expected",
    [
        ("HTTPS://User:pw@Example.COM:443/A/b/?utm_source=x&q=a%20b&fbclid=1#top", "https://example.com/A/b/?q=a%20b"),
        ("http://example.com", "http://example.com/"),
        ("http://example.com:8080/x", "http://example.com:8080/x"),
        ("  https://example.com/x?b=2&&a=1  ", "https://example.com/x?b=2&a=1"),
        ("https://example.com/?utm%5Fsource=a&z=%zz", "https://example.com/?z=%zz"),
        ("http://[2001:DB8::1]:80/", "http://[2001:db8::1]/"),
        ("https://my_host.com/x", "https://my_host.com/x"),
        ("http://example.com:bad/", None),
        ("http://example.com:70000/", None),
        ("ftp://example.com/", None),
        ("javascript:alert(1)", None),
        ("https:///nohost", None),
        ("https://exa mple.com/", None),
        ("", None),
        (None, None),
    ],
)
def test_canonical_url(one, url, expected):
    assert one(N.canonical_url(F.col("u")), u=url) == expected
    assert one(N.is_http_url(F.col("u")), u=url) is (expected is not None or url in ("http://example.com:bad/", "http://example.com:70000/"))


@pytest.mark.parametrize(
    "raw, expected",
    [
        (None, ""),
        ("<p>Hello&nbsp;<b>world</b></p>", "Hello world"),
        ("&lt;p&gt;Hi&lt;/p&gt;", "Hi"),
        ("a<script>x()</script>b<!-- c -->", "a b"),
        ("it&amp;#8217;s", "it’s"),
        ("é ​x‮", "é x"),
        ("<p>open <form>dropped", "open"),
    ],
)
def test_plain_text(raw, expected):
    assert X.plain_text(raw) == expected


def test_truncate(one):
    assert one(X.truncate(F.lit("short"), 10)) == "short"
    assert one(X.truncate(F.lit("alpha beta gamma, delta"), 18)) == "alpha beta gamma…"
    assert one(X.truncate(F.lit("abcdefghijklmnopqrstuvwxyz"), 10)) == "abcdefghi…"


def test_boilerplate(one):
    assert one(X.without_boilerplate(F.lit("News. The post News appeared first on Site."))) == "News."
    assert one(X.without_boilerplate(F.lit("News. Read More »"))) == "News."
    assert one(X.without_boilerplate(F.lit("News […]"))) == "News"


def test_fingerprint(one):
    a = one(X.title_fingerprint(F.lit("The Straße is open, again: today!")))
    assert a == one(X.title_fingerprint(F.lit("the STRASSE is open again today"))) and len(a) == 64
    assert one(X.title_fingerprint(F.lit("only five words are here"))) is None


def test_redact(one):
    assert one(X.redact(F.lit("x api_key=abc123 y"))) == "x api_key=[REDACTED] y"
    assert one(X.redact(F.lit("Authorization: Bearer abcdefghijk"))) == "Authorization: Bearer [REDACTED]"
    assert one(X.redact(F.lit("see hunter22 here"), ("hunter22", "abc"))) == "see [REDACTED] here"


def test_headline_and_categories(one):
    assert one(X.normalized_headline(F.lit(' "A  good   day." '))) == "A good day"
    assert one(X.category(F.lit("Startups & Funding"))) == "ENTREPRENEURSHIP"
    assert one(X.category(F.lit("Sports"))) is None
    assert one(X.html_escape(F.lit("<a href='x'>&\""))) == "&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;"


def test_numbers_and_domains(one):
    assert one(X.unsupported_numbers(F.lit("Up 1,200 and 7% #AI2026"), F.lit("it was 1200"))) == ["7"]
    assert one(X.unsupported_domains(F.lit("see evil.example and Node.js"), F.lit("about node.js"))) == ["evil.example"]


def plain_layout(words, width, most, lines):
    """The cheapest of all layouts on as few lines as fit, by trying every one."""
    from itertools import combinations

    for k in range(1, lines + 1):
        found = []
        for cuts in combinations(range(1, len(words)), k - 1):
            ends = [*cuts, len(words)]
            spans = list(zip([0, *cuts], ends, strict=True))
            wide = [width(" ".join(words[a:b])) for a, b in spans]
            if max(wide) <= most:
                found.append((max(w + (1200 if b < len(words) and layout.dangles(words[b - 1]) else 0) for w, (_, b) in zip(wide, spans, strict=True)), cuts[::-1]))
        if found:
            return min(found)[0], k
    return None


def test_layout_is_the_cheapest():
    import random

    r = random.Random(4)
    pool = "the a to plan tower building in announcement x of it into".split()
    for _ in range(300):
        words = [r.choice(pool) for _ in range(r.randint(1, 10))]
        cap = r.randint(4, 30)
        line = layout.Line(words, lambda t: [1] * len(t) and layout.np.ones(len(t), int))
        ends, want = line.balanced(cap, 1200, 4), plain_layout(words, len, cap, 4)
        if want is None:
            assert ends is None
            continue
        cost = max(len(line.text(a, b)) + (1200 if b < len(words) and layout.dangles(words[b - 1]) else 0) for a, b in zip([0, *ends[:-1]], ends, strict=True))
        assert (cost, len(ends)) == want, (words, cap, ends)


@pytest.mark.parametrize(
    "headline, size, lines, cut",
    [
        ("", 34, [], False),
        ("Short one", 76, ["Short one"], False),
        ("Startup raises $40 Million, plans to build a tower", 76, ["Startup raises", "$40 Million, plans", "to build a tower"], False),
        ("the plan to build a new tower in the old town of the north", 76, ["the plan to build", "a new tower in the old", "town of the north"], False),
        ("word " * 100, 34, ["word word word word word word word word word word"] * 3 + ["word word word word word word word word word word…"], True),
        ("y" * 60, 34, ["y" * 49 + "-", "y" * 11], False),
    ],
)
def test_fitted_headlines(headline, size, lines, cut):
    assert layout.fitted(headline, 390) == (size, lines, cut)


def test_layout_parts():
    assert layout.glued("Raises $40  Million, or 7 percent; 5 dogs") == ["Raises", "$40 Million,", "or", "7 percent;", "5", "dogs"]
    assert layout.glued("1,000 million billion") == ["1,000 million", "billion"]
    assert layout.ellipsized("one two, three", 9 * 600, layout.fixed_advance) == "one two…"
    assert layout.hyphenated(["abcdefghij"], 4 * 600, layout.fixed_advance) == ["abc-", "def-", "ghij"]
