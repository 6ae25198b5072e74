"""Main text of web pages, with site templates removed.

One pass reads a page as a stream of tags with a stack, and hashes each element's subtree (tag,
class, text and children) when it closes. Subtrees are counted per host in Spark, over the
host's different pages; those on a large share of them are the site's template and are deleted in a
second pass. What HTML itself says is not the article (scripts, navigation, forms, hidden elements ...) is dropped as it is read.

Adverts, notices and readers' comments have a text of their own on every page, so counting texts does not find them. Two things do: a class or id that is
exactly one of a few names that mean nothing else (``_CERTAIN``), and a place that recurs: an element whose class or id ends in a
word for such things is deleted if the same element, whatever its text, is on a large share of the host's pages with less than half of their text. A
name alone that could be a story's deletes nothing. What stands outside ``article`` or ``main`` stays unless one of these finds it.

Reading takes time in proportion to the page: no part of it is scanned twice, however its tags are broken or nested.

Cases: a null or empty html gives an empty text; a null url is a host of its own; repeated pages count once
towards a template; a host with fewer different pages than ``Template.pages`` has no template, and what its tags and
certain names don't drop is kept; unclosed and crossing tags close as browsers close them; pages of any length are
read whole; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwire.llm.scratch import Scratch


@dataclass(frozen=True)
class Template:
    """A subtree is a template's when it is on so many different pages of a host, and on this share of them."""

    pages: int = 5
    share: float = 0.3


_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORDS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
_RAW = frozenset("script style textarea title xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROP = frozenset(
    "head script style noscript template iframe object svg canvas math nav footer aside form button select textarea title dialog menu audio video map".split()
)
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
#: Names of adverts, notices and readers' comments that mean nothing else, whole.
_CERTAIN = frozenset(
    "ad ads advert adverts advertisement advertisements adsbygoogle ad-slot ad-container ad-banner banner-ad comment comments comment-body comment-list commentlist comments-area "
    "reader-comments user-comments cookie-banner cookie-bar cookie-consent cookie-notice disqus_thread newsletter-signup sidebar".split()
)
#: What a name can end in that is no part of an article; it decides only where the element recurs on the host.
_NAMES = _CERTAIN | frozenset(
    "adv advertising adsense adslot sponsor sponsored sponsors promo promos promotion promotions banner banners cookie cookies consent gdpr notice notices alert alerts popup popups modal overlay "
    "newsletter newsletters subscribe subscription paywall signup signin login rail widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs masthead topbar header footer reply "
    "replies respond disqus share sharing social related recommended recommendations pagination pager toolbar search".split()
)
#: Words after which the name still means what the word before says: a share-box is for sharing, share-prices are not.
_SHELL = frozenset("area bar block body box button buttons container content form group holder icon icons inner item items link links list panel row section slot text unit wrap wrapper".split())


def _ends_in(token: str) -> str:
    """The last word of a name that is no mere shell and no number."""
    words = [w.lower() for w in _WORDS.findall(token)]
    while len(words) > 1 and (words[-1] in _SHELL or words[-1].isdigit()):
        words.pop()
    return words[-1] if words else ""


def _marks(tag: str, attributes: str) -> tuple[bool, int | None, str]:
    """(to be dropped, the place if its name is one that may recur, the class) from a tag's attributes."""
    drop = telling = False
    cls = ident = ""
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            for token in value.split():
                drop |= token.lower().rstrip("0123456789").rstrip("-_") in _CERTAIN
                telling |= _ends_in(token) in _NAMES
            if name == "class":
                cls = value
            else:
                ident = value
        elif name == "role":
            drop |= value.lower() in _ROLES
        elif name == "hidden":
            drop = True
        elif name == "aria-hidden":
            drop |= value.lower() == "true"
    if tag in ("html", "body", "main"):
        return False, None, cls
    place = int.from_bytes(blake2b("\0".join(["place", tag, cls, re.sub(r"\d+", "0", ident)]).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True) if telling else None
    return drop, place, cls


class _Stack:
    """Open elements, with where each tag is open, so that no search walks through them."""

    def __init__(self) -> None:
        # an entry: tag, first piece, dropped, in an article, class, what it holds, its place
        self.items: list[list] = [["", 0, False, False, "", [], None]]
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, entry: list) -> None:
        self.at.setdefault(entry[0], []).append(len(self.items))
        if entry[0] in _BLOCK:
            self.blocks.append(len(self.items))
        self.items.append(entry)

    def pop(self) -> list:
        entry = self.items.pop()
        self.at[entry[0]].pop()
        if entry[0] in _BLOCK:
            self.blocks.pop()
        return entry

    def top_of(self, *tags: str) -> int:
        """The place of the innermost open element with one of the tags; 0 for none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def lowest_above(self, bound: int, *tags: str) -> int:
        """The place of the outermost open element with one of the tags that is inside the bound; 0 for none."""
        found = (a[i] for t in tags if (a := self.at.get(t)) and (i := bisect_right(a, bound)) < len(a))
        return min(found, default=0)


def read(page: str, template: frozenset[int] = frozenset()) -> tuple[str, list[int]]:
    """The main text, and the hashes of the subtrees and places that are not dropped."""
    stack = _Stack()
    pieces: list[str | None] = []  # None is a border of blocks
    places: list[tuple[int, int, int]] = []  # place, first and last piece of elements that may recur by place
    hashes: list[int] = []

    def close() -> None:
        tag, first, dropped, _, cls, held, place = stack.pop()
        block = tag in _BLOCK
        if dropped:
            return
        if place is not None and held:
            places.append((place, first, len(pieces)))
        if block:
            pieces.append(None)
        if not held:
            return
        digest = blake2b("\0".join([tag, cls, *held]).encode("utf-8", "replace"), digest_size=8).digest()
        stack.items[-1][5].append(digest.hex())
        if block:
            h = int.from_bytes(digest, "little", signed=True)
            hashes.append(h)
            if h in template:
                del pieces[first:]
                pieces.append(None)
                while places and places[-1][1] >= first:
                    places.pop()

    def close_to(depth: int) -> None:
        while len(stack.items) > depth:
            close()

    def text(run: str) -> None:
        top = stack.items[-1]
        if top[2] or not run:
            return
        run = entities.unescape(run)
        pieces.append(run)
        if run and not run.isspace():
            top[5].append(" ".join(run.split()))

    at = start = 0  # what lies between is text that was not given on yet
    tags = _TAG
    while True:
        i = page.find("<", at)
        if i < 0 or i + 1 == len(page):
            break
        if page[i + 1] in "!?":
            comment = page.startswith("<!--", i)
            end = page.find("-->", i + 4) if comment else page.find(">", i)
            if end < 0 and not comment:
                break  # no tag ends any more
            text(page[start:i])
            at = start = len(page) if end < 0 else end + (3 if comment else 1)
            continue
        m = tags.match(page, i)
        if not m:
            if page[i + 1 : i + 2] != "/" and not _is_letter(page[i + 1]) or page[i + 1] == "/" and not _is_letter(page[i + 2 : i + 3]):
                at = i + 1
                continue
            tags = _PLAIN_TAG  # a quote stays open to the end: from here on a tag ends at the next >
            m = tags.match(page, i)
            if not m:
                break
        if i > start:
            text(page[start:i])
        at = start = m.end()
        slash, tag, attributes = m[1], m[2].lower(), m[3]
        if slash:
            depth = stack.top_of(tag)
            if depth and (tag in _BLOCK or not stack.blocks or stack.blocks[-1] <= depth):
                close_to(depth)
            continue
        if tag in _VOID:
            # a line break is a space; other empty elements, as wbr or img, stand inside words
            if tag in ("hr", "br") and not stack.items[-1][2]:
                pieces.append(None if tag == "hr" else " ")
            continue
        if tag in _BLOCK:
            closes, scope = _CLOSES.get(tag, (None, None))
            if closes:
                depth = stack.lowest_above(stack.top_of(*scope), "p", *closes)
            else:
                depth = stack.top_of("p")
                depth = depth if depth > stack.top_of("td", "th", "article", "section", "div", "button") else 0
            if depth:
                close_to(depth)
        top = stack.items[-1]
        dropped = top[2] or tag in _DROP or tag == "header" and not top[3]
        marked, place, cls = _marks(tag, attributes) if attributes and not dropped else (False, None, "")
        dropped = dropped or marked
        if tag in _BLOCK and not dropped:
            pieces.append(None)
        stack.push([tag, len(pieces), dropped, top[3] or tag in ("article", "main"), cls, [], place])
        if tag in _RAW:
            close_tag = _raw_end(tag).search(page, at)
            at = start = close_tag.start() if close_tag else len(page)
    text(page[start:])
    close_to(1)
    size = [0]
    for t in pieces:
        size.append(size[-1] + (len(t) - t.count(" ") if t else 0))
    # a place counts where it holds less than half of the page
    hashes += [p for p, first, last in places if 2 * (size[last] - size[first]) < size[-1]]
    return _joined(pieces, [(first, last) for p, first, last in places if p in template]), hashes


def _is_letter(c: str) -> bool:
    return c.isascii() and c.isalpha()


@cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])", re.I)


def _joined(pieces: list[str | None], gone: list[tuple[int, int]]) -> str:
    """Blocks of text, one to a line, without some ranges of pieces."""
    out = [False] * (len(pieces) + 1)
    done = 0
    for first, last in sorted(gone):
        if last > done:  # places may lie in one another
            out[max(first, done) : last] = [True] * (last - max(first, done))
            done = last
    blocks, now = [], []
    for t, dropped in zip([*pieces, None], out, strict=True):
        if t is None or dropped:
            if now:
                blocks.append(" ".join("".join(now).split()))
                now = []
        else:
            now.append(t)
    return "\n".join(b for b in blocks if b)


def _host(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            pages, held = [], []
            for page in b.column(1).slice(at, 256).to_pylist():
                text, hashes = read(page or "")
                pages.append(int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True))
                held.append(np.unique(np.array(hashes, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(at, 256), pa.array(pages, pa.int64()), pa.array(held, pa.list_(pa.int64()))], names=["host", "page", "hashes"]
            )


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            c = b.slice(at, 256)
            texts = [read(page or "", frozenset(t or ()))[0] for page, t in zip(c.column(2).to_pylist(), c.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [c.column(0), c.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )


def templates(pages: DataFrame, scratch: Scratch, t: Template, url_col: str, html_col: str) -> DataFrame:
    """(t_host, template): the hashes of each host's template, at most its pages' mean number of subtrees / share."""
    found = pages.select(_host(F.col(url_col)).alias("host"), F.col(html_col).alias("h")).mapInArrow(_subtrees, "host string, page long, hashes array<long>")
    # a page that is repeated counts once; of two with one text, but other elements, the lesser hashes count
    found = scratch.table(found.groupBy("host", "page").agg(F.min("hashes").alias("hashes")), "subtrees")
    sizes = scratch.table(found.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= t.pages), "hosts")
    counts = found.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= t.pages)
    counts = counts.join(sizes.withColumnRenamed("host", "s_host"), F.col("host") == F.col("s_host")).where(F.col("n") >= t.share * F.col("pages"))
    out = scratch.table(counts.groupBy("host").agg(F.collect_list("hash").alias("template")).withColumnRenamed("host", "t_host"), "templates")
    scratch.drop(found, sizes)
    return out


def main_text(
    pages: DataFrame, scratch: Scratch, t: Template = Template(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """A row per page: page_id, url, text, n_chars.

    The templates are joined by host; Spark broadcasts them while they are below its limit, so that pages stay in place.
    """
    found = templates(pages, scratch, t, url_col, html_col)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), _host(F.col(url_col)).alias("host"))
    both = rows.join(found, F.col("host") == F.col("t_host"), "left").select("page_id", "url", "html", "template")
    kind = rows.schema["page_id"].dataType.simpleString()
    return both.mapInArrow(_texts, f"page_id {kind}, url string, text string, n_chars long")
