"""Reading pages in linear time, and counting and dropping against a plain version on trees."""

import random
import time
from collections import Counter, defaultdict

import pytest

from sparkwire.llm import html
from sparkwire.llm.queries import queries
from sparkwire.llm.scratch import Scratch


@pytest.mark.parametrize(
    "unit",
    ["<a ", "</u>", "<i></u>", "<i>", "<a b=\"", "<a b='>", "<", "<!", "<!--", "<p>", "<div><p>", "<i><h1></h1>", "<ul><li>", "<td>", "<script>", "<textarea>x</textarea>", "<b><p></b>", "&amp;<", "<a href=x ", "<?x "],
)
def test_a_megabyte_takes_no_second(unit):
    page = unit * (1_000_000 // len(unit))
    began = time.process_time()
    html.read(page)
    assert time.process_time() - began < (1.0 if unit in ("<a ", "</u>") else 8.0)


def test_time_grows_with_the_page():
    def took(n):
        page = "<i>" * n + "<h1></h1>" * n + "</u>" * n + "</i>" * n
        began = time.process_time()
        html.read(page)
        return time.process_time() - began

    took(2000)
    assert took(40000) < 40 * max(took(4000), 0.01)


# --- sites as trees: (tag, class, children), a text or a child -------------------------------------
def markup(node):
    if isinstance(node, str):
        return node
    tag, cls, children = node
    return f"<{tag}{f' class={chr(34)}{cls}{chr(34)}' if cls else ''}>{''.join(map(markup, children))}</{tag}>"


def subtrees(node):
    if not isinstance(node, str):
        yield node
        for c in node[2]:
            yield from subtrees(c)


def said(node):
    return len((node if isinstance(node, str) else "".join(texts(node))).replace(" ", ""))


def texts(node):
    return [node] if isinstance(node, str) else [t for c in node[2] for t in texts(c)]


def plain(pages, least=5, share=0.3):
    """{page: text} of {page: (host, tree)}: subtrees and places are compared as they are, not by hashes."""

    def place(n):
        return ("place", n[0], n[1]) if n[1] and any(html._ends_in(t) in html._NAMES for t in n[1].split()) else None

    def countable(tree):
        found = [n for n in subtrees(tree) if texts(n)]
        return {*found, *(place(n) for n in found if place(n) and 2 * said(n) < said(tree))}

    def blocks(node, template):
        out = []
        for c in node[2]:
            out += [c] if isinstance(c, str) else [] if c in template or place(c) in template else blocks(c, template)
        return out

    different = defaultdict(dict)
    for host, tree in pages.values():
        different[host].setdefault(tuple(texts(tree)), tree)
    out = {}
    for i, (host, tree) in pages.items():
        n = len(different[host])
        held = Counter(x for t in different[host].values() for x in countable(t))
        template = {x for x, k in held.items() if n >= least and k >= least and k >= share * n}
        out[i] = "\n".join(blocks(tree, template))
    return out


def test_random_sites(spark):
    r, pages = random.Random(4), {}
    furniture = {h: [("div", r.choice(["", "top", "menu-bar", "brand"]), (f"Welcome to {h}", ("p", "", (f"Since {h}",)))), ("p", "", (f"All rights {h}",))] for h in range(4)}
    for i in range(160):
        h = i % 5 if i < 155 else 9  # host 4 has no furniture, host 9 too few pages
        story = [("p", "", (f"Story {i} part {k} " + "word " * r.randrange(9) + "end",)) for k in range(r.randint(1, 4))]
        parts = [*furniture.get(h, [])[: r.randint(0, 2)], ("div", r.choice(["story social", "text", ""]), tuple(story))]
        if r.random() < 0.7:
            parts.append(("div", ["promo", "share-box", "market-alerts"][h % 3], (f"Buy {i}",)))
        if r.random() < 0.3:
            parts.append(("p", "lead", (f"By the way {i}",)))
        r.shuffle(parts)
        pages[i] = h, ("div", "", tuple(parts))
    df = spark.createDataFrame([(i, f"https://h{h}.example/{i}", markup(t)) for i, (h, t) in pages.items()], "page_id long, url string, html string").repartition(3)
    got = {x["page_id"]: x["text"] for x in html.main_text(df, Scratch(spark, "t")).collect()}
    want = plain(pages)
    assert got == want
    assert all(f"Story {i} part 0" in t for i, t in got.items())
    assert sum("Buy" in t for t in got.values()) < 20 and any("By the way" in t for t in got.values())


def test_text_and_blocks_of_a_template_go_together(spark):
    rows = [(i, f"https://x.example/{i}", f"<div class=top>Welcome <p>to us</p> all</div><p>Story {i}</p>") for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {x["text"] for x in html.main_text(df, Scratch(spark, "t")).collect()} == {f"Story {i}" for i in range(8)}


def test_query(spark, tmp_path):
    rows = [(i, f"https://x.example/{i}", f"<nav>n</nav><article><p>Text {i}</p></article><footer>f</footer>") for i in range(7)] + [(9, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {x["page_id"]: (x["text"], x["n_chars"]) for x in queries()["op10_site_templates"](spark, str(tmp_path)).collect()}
    assert got == {i: (f"Text {i}", 6) for i in range(7)} | {9: ("", 0)}
