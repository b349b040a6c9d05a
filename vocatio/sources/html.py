"""Captured job pages as rows: search pages to cards, posting pages to details.

The pages are parsed by the standard library's tolerant parser into a light tree, in Arrow
batches. What is looked for is named by tag or class, as in the sites' markup (fixed names).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape
from html.parser import HTMLParser
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from vocatio.functions.text import clean_url, job_id_from_url

#: Characters of pages whose details a task keeps, about.
KNOWN_CHARS = 8_000_000

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CLOSED_BY_LIKE = {"li", "p", "option", "tr", "td", "th", "dt", "dd"}
REMOVED = {"script", "style", "svg", "path", "img", "icon", "button", "form"}

TITLE = (".top-card-layout__title", ".topcard__title", "h1", "h2")
FIELDS = {"company": (".topcard__org-name-link",), "location": (".topcard__flavor--bullet",), "posted": (".posted-time-ago__text",), "applicants": (".num-applicants__caption",)}
CRITERION, CRITERION_NAME, CRITERION_VALUE = ".description__job-criteria-item", ".description__job-criteria-subheader", ".description__job-criteria-text--criteria"
DESCRIPTION = ".show-more-less-html__markup"
CARD_LOCATION, CARD_LINK = ".job-search-card__location", "base-card__full-link"

CARD = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("title", "company", "location", "href")]))
POST = T.StructType([*[T.StructField(c, T.StringType()) for c in ("title", "company", "location", "posted", "applicants")], T.StructField("criteria", T.MapType(T.StringType(), T.StringType())), T.StructField("sections", T.StringType())])


_NO_CLASSES: frozenset[str] = frozenset()


class Node:
    __slots__ = ("attrs", "children", "classes", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []
        own = attrs.get("class")
        self.classes = frozenset(own.split()) if own else _NO_CLASSES

    def walk(self):
        """Nodes below, in document order."""
        stack = list(reversed(self.children))
        while stack:
            n = stack.pop()
            if isinstance(n, Node):
                yield n
                stack.extend(reversed(n.children))

    def first(self, *selectors: str) -> Node | None:
        """The first node that is any of the tags or ``.classes``."""
        return next((n for n in self.walk() if any(s[1:] in n.classes if s[0] == "." else n.tag == s for s in selectors)), None)

    def all(self, selector: str) -> list[Node]:
        return [n for n in self.walk() if (selector[1:] in n.classes if selector[0] == "." else n.tag == selector)]

    def strings(self) -> list[str]:
        out, stack = [], list(reversed(self.children))
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in REMOVED:
                stack.extend(reversed(n.children))
        return out


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in CLOSED_BY_LIKE:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag == tag:
                    del self.open[i:]
                    break
                if self.open[i].tag in ("ul", "ol", "table", "div", "section"):
                    break
        n = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(n)
        if tag not in VOID:
            self.open.append(n)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


#: A tag that needs no tolerance: lower case, attributes in double quotes. Its slash, name and attributes.
_TAG = re.compile(r'<(/?)([a-z][a-z0-9]*)((?: [a-z][a-z0-9-]*="(?:[^"<>&\0]|&amp;)*")*)>')
_ATTRIBUTE = re.compile(r' ([a-z0-9-]+)="([^"]*)"')
#: What these hold isn't markup.
_RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}


def _plain(html: str) -> Node | None:
    """The tree of a page all of whose tags are plain ones, several times faster; else none."""
    parts = _TAG.split(html)
    texts, closes, names, attrs = parts[::4], parts[1::4], parts[2::4], parts[3::4]
    if any("<" in t or "\0" in t for t in texts) or not _RAW.isdisjoint(names) or any(a for c, a in zip(closes, attrs, strict=True) if c):
        return None
    p = _Tree()
    for text, close, name, own in zip(texts, closes, names, attrs, strict=False):
        if text:
            p.handle_data(unescape(text) if "&" in text else text)
        if close:
            p.handle_endtag(name)
        else:
            p.handle_starttag(name, [(k, v.replace("&amp;", "&")) for k, v in _ATTRIBUTE.findall(own)] if own else ())
    if texts[-1]:
        p.handle_data(unescape(texts[-1]))
    return p.root


def tree(html: str | None) -> Node:
    plain = _plain(html or "")
    if plain is not None:
        return plain
    p = _Tree()
    p.feed(html or "")
    p.close()
    return p.root


def tidy(text: str) -> str:
    return re.sub(r"[ \t]+", " ", text.replace("\xa0", " ")).strip()


def cards_of(html: str | None) -> list[dict]:
    """title, company, location, href of every list item that has the first two and a link."""
    text = lambda n: (" ".join(s for x in n.strings() if (s := x.strip())) or None) if n else None
    out = []
    for li in tree(html).all("li"):
        found: dict[str, Node] = {}  # the first of each, in one walk
        for n in li.walk():
            if n.tag in ("h3", "h4"):
                found.setdefault(n.tag, n)
            if n.classes:
                if CARD_LOCATION[1:] in n.classes:
                    found.setdefault("location", n)
                if n.tag == "a" and CARD_LINK in n.classes:
                    found.setdefault("link", n)
        link = found.get("link")
        card = {"title": text(found.get("h3")), "company": text(found.get("h4")), "location": text(found.get("location")), "href": (link.attrs.get("href") or None) if link else None}
        if card["title"] and card["company"] and card["href"]:
            out.append(card)
    return out


def post_of(html: str | None) -> dict:
    root = tree(html)
    text = lambda n: tidy("".join(n.strings())) if n else None
    out = {"title": text(root.first(*TITLE)), **{k: text(root.first(*s)) for k, s in FIELDS.items()}, "criteria": {}, "sections": ""}
    for item in root.all(CRITERION):
        name, value = item.first(CRITERION_NAME), item.first(CRITERION_VALUE)
        if name and value:
            out["criteria"][text(name)] = text(value)
    body = root.first(DESCRIPTION)
    if body:
        for br in body.all("br"):
            br.children = ["\n"]
        out["sections"] = tidy("\n".join(s for x in body.strings() if (s := x.strip())))
    return out


@F.arrow_udf(CARD)
def _cards(html: pa.Array) -> pa.Array:
    return pa.array([cards_of(h) for h in html.to_pylist()], to_arrow_type(CARD))


def posts_of(pages: Iterable[str | None]) -> Iterator[dict]:
    """``post_of`` of each page, with its criteria as pairs. A page that is captured again isn't parsed
    again, as long as the pages known come to KNOWN_CHARS at most; then they are forgotten."""
    known: dict[str | None, dict] = {}
    held = 0
    for html in pages:
        post = known.get(html)
        if post is None:
            post = post_of(html)
            post["criteria"] = list(post["criteria"].items())
            if held > KNOWN_CHARS:
                known.clear()
                held = 0
            known[html] = post
            held += len(html or "")
        yield post


@F.arrow_udf(POST)
def _post(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    sizes: list[int] = []

    def pages() -> Iterator[str | None]:
        for b in batches:
            sizes.append(len(b))
            yield from b.to_pylist()

    posts = posts_of(pages())
    for first in posts:
        yield pa.array([first, *islice(posts, sizes.pop() - 1)], to_arrow_type(POST))


def search_cards(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row for each card of a search page, with the page's other columns: job_id, title,
    company, location, source_url. Pages without cards, and null ones, give none."""
    kept = [c for c in pages.columns if c not in (html, "job_id", "title", "company", "location", "source_url")]
    found = pages.select(*kept, F.explode(_cards(F.col(html))).alias("c"))
    url = clean_url(F.col("c.href"))
    return found.select(*kept, job_id_from_url(url).alias("job_id"), "c.title", "c.company", "c.location", url.alias("source_url"))


def job_posts(pages: DataFrame, html: str = "html") -> DataFrame:
    """The details of each posting page, with the page's other columns."""
    kept = [c for c in pages.columns if c not in (html, *[f.name for f in POST.fields])]
    return pages.select(*kept, _post(F.col(html)).alias("p")).select(*kept, "p.*")


def merged(cards: DataFrame, posts: DataFrame, stored: DataFrame, run: str | None = None, post_run: str | None = None) -> DataFrame:
    """Bronze postings: cards whose job isn't stored yet, with their pages' details. Title, company,
    location and link are the card's. Cards without a job id have no page. ``run`` names a column of
    the cards that is kept, and in which a page (there called ``post_run``) must agree. Stored jobs and pages, of
    which there may be any number, aren't sent through the driver."""
    own = [run] if run else []
    c = cards.where("job_id is not null").withColumn("job_id", F.col("job_id").cast("long")).join(stored.select("job_id").distinct().hint("merge"), "job_id", "left_anti")
    p = posts.select(*([F.col(post_run).alias(run)] if run else []), F.col("job_id").cast("long").alias("job_id"), "posted", "applicants", "criteria", "sections")
    at = lambda k: F.try_element_at("criteria", F.lit(k))
    return c.join(p.hint("merge"), [*own, "job_id"]).select(
        *own, "job_id", "source_url", F.col("title").alias("title_raw"), F.col("company").alias("company_raw"), F.col("location").alias("location_raw"), F.col("posted").alias("posted_raw"), F.col("applicants").alias("applicants_raw"),
        at("Seniority level").alias("seniority_level_raw"), at("Employment type").alias("employment_type_raw"), at("Job function").alias("job_function_raw"), at("Industries").alias("industry_raw"), F.col("sections").alias("description_raw"),
    )
