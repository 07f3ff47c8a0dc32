"""Main text of web pages by site template removal.

Each page is parsed into a tree; element subtrees get hashes, Spark counts for each host with how many
different articles a hash occurs, and subtrees that recur across many of them are deleted, before anything
else is decided. Two hashes are counted:

* of the content (tag, marks, text, children): boilerplate that says the same on many pages. Headings, table
  cells and inline elements inside an article are exempt; its paragraphs, quotations and list items are
  deleted only if their share of the host's articles is large, these are different texts, and the share
  among all other hosts' articles is small: what articles say everywhere is no template of a site.
* of the shape (tag, marks without page numbers, the kinds of children): blocks of the site, such as menus,
  adverts and footers, whose texts change from page to page. Only subtrees count that have a name (a class, an
  id, a role or a tag that says more than div), hold no first heading, and lie beside the host's main place:
  the path on which most words of the host's pages are. They must be on half of the host's articles,
  and hold few words next to the main place.

In what is left, elements go whose tag, role or class says that they are no part of the article (menus, forms,
adverts, comments, ...). The text is that of the marked article, or of the body where none is marked.

Pages whose articles have one heading count once: an article may be published, as it is or with
changes, on many pages of one host, and what recurs in its copies is no template. A heading over mostly
different texts (a site's or section's name) names no article; there, the texts are counted. Where no
article is marked, what recurs mostly in texts with one sketch counts as copied, unless it goes with the share.

Null or empty html gives the empty text. A null url counts as a host of its own. A null page_id is kept,
others stay whole beside it. Repeated rows give repeated results. Pages of any length and depth are parsed
whole, in time linear in their length. An empty table gives an empty result. Only page_id, url and html
are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm import textcore
from quillsift.llm.runtime import dropped, steady, stored

#: A subtree is template if it goes with so many of the host's articles at least, and with this share of them,
#: or with MANY_ARTICLES, whatever their share.
LEAST_ARTICLES, LEAST_SHARE, MANY_ARTICLES = 4, 0.3, 10
#: Of a paragraph's share of the host's articles, the most that its share of other hosts' articles may be.
ELSEWHERE = 0.1
#: A shape is template if it goes with LEAST_ARTICLES and this share of the host's articles, and holds at most so
#: large a share of the words of the main place. A place is more main than its parent if it holds so much of it.
SHAPE_SHARE, SHAPE_WORDS, MAIN_SHARE = 0.5, 0.25, 0.7
#: Pages with one heading hold different articles if so large a share of them differ in their texts' sketches.
LEAST_DIFFERENT = 0.5
#: Up to so many (host, hash) rows, of some 60 bytes each, are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 50_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD_ONLY = frozenset("title meta link script style base noscript template".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li b i em strong a span u s small sub sup code q cite mark figcaption dd dt td th tr".split())
#: Prose that may be template inside an article too.
PARAGRAPHS = frozenset("p li blockquote pre figcaption dd dt".split())
#: Containers whose tag gives them no name; elements whose text is none.
NAMELESS = frozenset("html body head div center font table tbody thead tfoot caption ul ol dl fieldset details summary hgroup picture svg option optgroup select".split())
SILENT = frozenset("head title script style noscript template".split())
#: Numbers of pages in marks, such as post-123.
NUMBERS = re.compile(r"(?<=[-_])\d+(?=\s|$)")
ARTICLE = frozenset(("article", "main"))
#: Elements that are never part of an article's text.
UNWANTED = frozenset("head nav footer aside form script style noscript template iframe object button select textarea input svg canvas menu dialog audio video map".split())
#: Words in class, id or role that say the same.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo complementary cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion related respond responses search share sharing sidebar skip social sponsor sponsored subscribe toolbar topbar widget".split()
)
#: First parts of class names that speak of the page, such as has-sidebar.
QUALIFIERS = frozenset("has no with without is js".split())
#: Open elements that the start of another one ends.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS, LISTS = ("h1", "h2", "h3", "h4", "h5", "h6"), "html body table ul ol dl select".split()
SCOPES = frozenset("html body table td th ul ol dl article section div main nav aside footer header form blockquote".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "inside", "hash", "shape", "path", "words", "text")

    def __init__(self, tag: str, attrs: str = "", parent: Node | None = None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.inside = parent is not None and (parent.inside or parent.tag in ARTICLE)


NAME, SKIP, ATTRIBUTE, BARE = (re.compile(x) for x in (r"[^\t\n\r\f />\x00]+", r"[\s/]*", r"([^\s/>][^\s/=>]*)(\s*=+\s*)?", r"[^>\s]*"))
#: Elements whose content is no markup, with what ends it; numbers of characters too long to be one.
RAW = {t: re.compile(rf"</\s*{t}\s*>", re.I) for t in ("script", "style")}
LONG_NUMBER = re.compile(r"&#0*[1-9][0-9]{7,};?")


def decoded(text: str) -> str:
    """Character references in a text, those of numbers beyond all characters too."""
    return unescape(LONG_NUMBER.sub("\ufffd", text)) if "&" in text else text


class Builder:
    """A forgiving tree: unclosed elements end with their parents, stray end tags are ignored. The depths
    at which each tag is open are kept, so that nothing climbs the tree.

    What begins like a tag, a comment or a declaration but has no > behind it is text up to the next <. A
    comment that isn't closed, a marked section or another declaration ends at the next >. A quotation mark
    without its partner is part of a value. Where a tag's quotations reach to the end of the page, quotations
    count no more from there on. What was looked for in vain isn't looked for again: the work is linear."""

    def __init__(self):
        self.root = Node("")
        self.path, self.depths = [self.root], {}

    def read(self, html: str) -> None:
        i, n, find, quotes = 0, len(html), self.finder(html), True
        while i < n:
            j = find("<", i)
            if j < 0 or j > i:
                self.handle_data(decoded(html[i : j if j >= 0 else n]))
            if j < 0:
                return
            i, after = j, html[j + 1 : j + 2]
            if "a" <= after <= "z" or "A" <= after <= "Z":
                end, said = self.start_tag(html, i, find, quotes) if find(">", i) >= 0 else (-1, None)
                if end < 0 and quotes and find(">", i) >= 0:
                    quotes = False
                    end, said = self.start_tag(html, i, find, quotes)
                if said:
                    tag, attrs, empty = said
                    (self.handle_startendtag if empty else self.handle_starttag)(tag, attrs)
                    if tag in RAW and not empty:
                        close = RAW[tag].search(html, end)
                        self.handle_data(html[end : close.start() if close else n])
                        end = close.start() if close else n
            elif after in ("/", "!", "?") and after:
                closed = find("-->", i + 2) if html.startswith("<!--", i) and html[i + 4 : i + 5] != ">" else -1
                end = closed + 3 if closed >= 0 else find(">", i) + 1 or -1
                if after == "/" and end > 0 and (name := NAME.match(html, i + 2)):
                    self.handle_endtag(name[0].lower())
            else:
                end = i + 1
                self.handle_data("<")
            if end < 0:
                end = find("<", i + 1)
                end = n if end < 0 else end
                self.handle_data(decoded(html[i:end]))
            i = end

    @staticmethod
    def finder(html: str) -> Callable[[str, int], int]:
        """Finds a string from a place on; what isn't found is remembered."""
        absent: set[str] = set()

        def find(what: str, at: int) -> int:
            if what in absent:
                return -1
            found = html.find(what, at)
            if found < 0:
                absent.add(what)
            return found

        return find

    @staticmethod
    def start_tag(html: str, i: int, find: Callable[[str, int], int], quotes: bool) -> tuple[int, tuple[str, list, bool] | None]:
        """Behind a start tag, its name, marks and whether it ends in />; -1 where the page ends in it."""
        name = NAME.match(html, i + 1)
        k, n, attrs = name.end(), len(html), []
        while True:
            k = SKIP.match(html, k).end()
            if k >= n:
                return -1, None
            if html[k] == ">":
                return k + 1, (name[0].lower(), attrs, html[k - 1] == "/")
            found = ATTRIBUTE.match(html, k)
            k = found.end()
            if not found[2]:
                continue
            close = find(html[k], k + 1) if quotes and html[k : k + 1] in ("'", '"') and k < n else -1
            value = html[k + 1 : close] if close >= 0 else BARE.match(html, k)[0]
            k = close + 1 if close >= 0 else k + len(value)
            if (attribute := found[1].lower()) in ("class", "id", "role"):
                attrs.append((attribute, decoded(value)))

    def close_from(self, depth: int) -> None:
        while len(self.path) > depth:
            self.depths[self.path.pop().tag].pop()

    def innermost(self, tags: Iterable[str]) -> int:
        depth, depths = 0, self.depths
        for t in tags:
            if (d := depths.get(t)) and d[-1] > depth:
                depth = d[-1]
        return depth

    def close_open(self, tags: Iterable[str], stop: Iterable[str]) -> None:
        depth = self.innermost(tags)
        if depth and depth >= self.innermost(stop):
            self.close_from(depth)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.depths.get("head") and tag not in HEAD_ONLY and tag != "head":
            self.close_from(self.depths["head"][-1])
        if tag in BLOCKS:
            if self.depths.get("p"):
                self.close_open(("p",), SCOPES)
            if tag in HEADINGS:
                self.close_open(HEADINGS, SCOPES)
        if tag in IMPLIED:
            self.close_open(IMPLIED[tag], LISTS)
        said = " ".join(v for _, v in attrs if v)
        node = Node(tag, said, self.path[-1])
        self.path[-1].children.append(node)
        if tag not in VOID:
            self.depths.setdefault(tag, []).append(len(self.path))
            self.path.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.close_from(len(self.path) - 1)

    def handle_endtag(self, tag: str) -> None:
        if depths := self.depths.get(tag):
            self.close_from(depths[-1])

    def handle_data(self, data: str) -> None:
        self.path[-1].children.append(data)


def parse(html: str | None) -> Node:
    b = Builder()
    b.read(html or "")
    return b.root


def unwanted(n: Node, in_article: bool) -> bool:
    if n.tag in UNWANTED or n.tag == "header" and not in_article:
        return True
    if not n.attrs or n.tag in ("html", "body", "main"):
        return False
    for name in n.attrs.lower().split():
        parts = [name] if n.tag == "article" else re.split(r"[^a-z]+", name)
        if parts[0] not in QUALIFIERS and not MARKS.isdisjoint(parts):
            return True
    return False


def inner(n: Node) -> list[Node]:
    return [c for c in n.children if isinstance(c, Node)]


def hash_of(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def hashed(root: Node) -> list[Node]:
    """Every element, parents first, with its text, words, content hash (of tag, marks, text and children) and,
    for containers, its shape (of tag, marks and the kinds of its children) and path (of tags and marks from
    the root). Works without recursion, so depth has no limit."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        if n.tag not in PROSE:
            n.path = hash_of(f"{n.parent.path if n.parent else ''}/{n.tag}\0{NUMBERS.sub('', n.attrs)}") if n is root or n.parent.tag not in PROSE else 0
        else:
            n.path = 0
        stack += reversed(inner(n))
    for n in reversed(order):
        h, text, words, kinds = xxhash.xxh3_64(f"{n.tag}\0{n.attrs}\0".encode("utf-8", "surrogatepass")), False, 0, set()
        for c in n.children:
            if isinstance(c, Node):
                h.update((c.hash + (1 << 63)).to_bytes(8, "little"))
                text |= c.text
                words += c.words
                if c.text and (c.tag not in PROSE or c.tag in BLOCKS):
                    kinds.add(c.shape)
            elif parts := c.split():
                h.update(" ".join(parts).encode("utf-8", "surrogatepass") + b"\1")
                text = True
                words += len(parts)
        n.hash, n.text, n.words = h.intdigest() - (1 << 63), text, 0 if n.tag in SILENT else words
        n.shape = n.tag if n.tag in PROSE else str(hash_of(f"{n.tag}\0{NUMBERS.sub('', n.attrs)}\0{','.join(sorted(kinds))}"))
    return order


def holders(order: list[Node], held: Callable[[Node], bool]) -> set[int]:
    """The elements that hold one of these, and these."""
    out: set[int] = set()
    for n in reversed(order):
        if id(n) in out or held(n):
            out.add(id(n))
            if n.parent is not None:
                out.add(id(n.parent))
    return out


def template_candidates(order: list[Node]) -> tuple[list[Node], list[Node]]:
    """Subtrees that may be template by their content: outside articles, none that holds one; and
    paragraphs inside articles."""
    around = holders(order, lambda n: n.tag in ARTICLE)
    outside = [n for n in order[1:] if n.text and id(n) not in around and not (n.tag in PROSE and n.inside)]
    return outside, [n for n in order if n.text and n.inside and n.tag in PARAGRAPHS]


def main_place(root: Node) -> Node:
    """The innermost container of most of a page's words."""
    n = root
    while True:
        best = max((c for c in inner(n) if c.tag not in PROSE and c.words), key=lambda c: c.words, default=None)
        if best is None or best.words < MAIN_SHARE * n.words:
            return n
        n = best


def shaped_candidates(order: list[Node], main: Callable[[Node], bool]) -> list[Node]:
    """Subtrees that may be template by their shape: outermost containers with a name beside the main place."""
    around, out = holders(order, lambda n: main(n) or n.tag in ARTICLE or n.tag == "h1"), []
    inside = {id(order[0])} if main(order[0]) else set()
    for n in order[1:]:
        if id(n.parent) in inside or main(n):
            inside.add(id(n))
        elif n.words and n.path and id(n) not in around and not n.inside and (n.attrs or n.tag not in NAMELESS):
            out.append(n)
            inside.add(id(n))
    return out


def text_of(n: Node) -> str:
    out, stack = [], [n]
    while stack:
        x = stack.pop()
        if isinstance(x, Node):
            stack += reversed(x.children)
        else:
            out.append(x)
    return " ".join(" ".join(out).split())


def article_of(root: Node) -> Node | None:
    stack = [root]
    while stack:
        n = stack.pop()
        if n.tag in ARTICLE:
            return n
        stack += reversed(inner(n))
    return None


def body_sketch(root: Node) -> int:
    """The least hash of three words in a row of the paragraphs (of all text, if there is none): texts
    that share most of their words have one sketch, mostly."""
    said, stack = [], [root]
    while stack:
        n = stack.pop()
        if n.tag == "p":
            said.append(text_of(n))
        else:
            stack += reversed(inner(n))
    h = textcore.word_hashes(textcore.raw(" ".join(said) or text_of(root)))
    if len(h) > 2:
        h = (h[:-2] * textcore.WORD_BASE + h[1:-1]) * textcore.WORD_BASE + h[2:]
    return int(textcore.mix(h).min().astype(np.int64)) if len(h) else 0


def article_key(root: Node) -> tuple[bool, int, int]:
    """Names what a page publishes: whether an article is marked; its first heading, else its first
    words; a sketch of its text. Without a marked article, the page's sketch and its whole text."""
    article = article_of(root)
    if article is None:
        return False, body_sketch(root), hash_of(text_of(root))
    said = ""
    stack = [article]
    while stack and not said:
        n = stack.pop()
        if len(n.tag) == 2 and n.tag[0] == "h" and n.tag[1].isdigit():
            said = text_of(n)
        stack += reversed(inner(n))
    said = said or " ".join(text_of(article).split()[:8]) or text_of(root)
    return True, hash_of(said), body_sketch(article)


@dataclass(frozen=True)
class Template:
    """What is known of a host: hashes of recurring subtrees outside articles and of paragraphs inside them,
    shapes of recurring blocks, the path of the main place."""

    outside: frozenset[int] = frozenset()
    paragraphs: frozenset[int] = frozenset()
    shapes: frozenset[int] = frozenset()
    main: int = 0


def deleted(root: Node, template: Template) -> set[int]:
    """The subtrees of a page that belong to its host's template."""
    order = hashed(root)
    outside, paragraphs = template_candidates(order)
    gone = {id(n) for n in outside if n.hash in template.outside} | {id(n) for n in paragraphs if n.hash in template.paragraphs}
    is_main = lambda n: n.path == template.main
    if template.shapes and any(map(is_main, order)):
        gone |= {id(n) for n in shaped_candidates(order, is_main) if int(n.shape) in template.shapes}
    return gone


def main_text(html: str | None, template: Template | None = None) -> str:
    """The text of a page, given its host's template."""
    root = parse(html)
    gone = deleted(root, template) if template else set()
    found: dict[tuple[str, bool], list[Node]] = {}
    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        n, out = stack.pop()
        if n.tag in ARTICLE and not unwanted(n, False):
            found.setdefault((n.tag, out), []).append(n)
            if n.tag == "article":
                continue
        out = out or id(n) in gone or unwanted(n, False)
        stack += [(c, out) for c in reversed(inner(n))]
    # an article inside an unwanted element (a menu that was never closed) counts if there is no other
    articles: list[Node] = next((found[k] for k in (("article", False), ("article", True), ("main", False)) if k in found), [])
    blocks: list[str] = []
    piece: list[str] = []

    def flush() -> None:
        if s := " ".join("".join(piece).split()):
            blocks.append(s)
        piece.clear()

    todo: list = [("in", a) for a in reversed(articles or [root])]
    inside, chosen = bool(articles), {id(a) for a in articles}
    while todo:
        kind, n = todo.pop()
        if kind == "text":
            piece.append(n)
        elif kind == "out":
            flush()
        elif id(n) in gone or id(n) not in chosen and unwanted(n, inside):
            continue
        elif n.tag in ("br", "wbr"):
            piece.append(" " if n.tag == "br" else "")
        else:
            if n.tag in BLOCKS or not n.tag:
                flush()
                todo.append(("out", n))
            todo += [("in" if isinstance(c, Node) else "text", c) for c in reversed(n.children)]
    flush()
    return "\n\n".join(blocks)


def host_of(url: F.Column) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


#: What a hash is of: the page itself, a subtree outside articles, a paragraph inside one, a shape, a main place.
PAGE, OUTSIDE, PARAGRAPH, SHAPE, MAIN = range(5)


def counted_hashes(html: str | None) -> tuple[list[tuple[int, int, int]], tuple[bool, int, int]]:
    """kind, hash, words of what is counted of a page; what names its article."""
    root = parse(html)
    order = hashed(root)
    outside, paragraphs = template_candidates(order)
    place = main_place(root)
    shapes: dict[int, int] = {}
    for n in shaped_candidates(order, lambda n: n is place):
        shapes[int(n.shape)] = shapes.get(int(n.shape), 0) + n.words
    rows = {(OUTSIDE, n.hash, 0) for n in outside} | {(PARAGRAPH, n.hash, 0) for n in paragraphs} | {(SHAPE, h, k) for h, k in shapes.items()}
    return [*rows, (MAIN, place.path, place.words), (PAGE, 0, 0)], article_key(root)


def site_templates(pages: DataFrame) -> DataFrame:
    """host, outside, paragraphs, shapes, main: the template of each host that has any. Each subtree is on
    MANY_ARTICLES pages or a fixed share of them, so their number is bounded by the host's subtrees
    over MANY_ARTICLES."""

    def subtrees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for host, html in zip(b.host, b.html, strict=True):
                found, (marked, key, body) = counted_hashes(html)
                # copies of an article with another heading are told by their text: the paragraphs' articles are named by it
                rows += [(host, *x, *((True, body, key) if x[0] == PARAGRAPH else (marked, key, body))) for x in found]
            yield pd.DataFrame(rows, columns=["host", "kind", "hash", "words", "marked", "key", "body"])

    found = pages.mapInPandas(subtrees, "host string, kind int, hash long, words long, marked boolean, key long, body long")
    what = ["host", "kind", "hash"]
    bodies = found.groupBy(*what, "marked", "key", "body").agg(F.count("*").alias("pages"), F.sum("words").alias("words"))
    named = bodies.groupBy(*what, "marked", "key").agg(F.count("*").alias("bodies"), F.sum("pages").alias("pages"), F.sum("words").alias("words"))
    differ = ~F.col("marked") | (F.col("bodies") >= LEAST_ARTICLES) & (F.col("bodies") >= LEAST_DIFFERENT * F.col("pages"))
    differ = differ & (F.col("kind") != PARAGRAPH)
    counts = named.groupBy(*what).agg(
        F.sum(F.when(differ, F.col("bodies")).otherwise(1)).alias("n"), F.sum(F.when(differ & F.col("marked"), F.col("bodies")).otherwise(1)).alias("apart"),
        F.sum("pages").alias("pages"), F.sum("words").alias("words"),
    )
    counts = stored(counts.where((F.col("n") >= LEAST_ARTICLES) | F.col("kind").isin(PAGE, MAIN, PARAGRAPH)), "subtrees")
    mains = counts.where(F.col("kind") == MAIN).groupBy("host").agg(F.max_by(F.struct("hash", "words"), F.struct("words", "hash")).alias("main"))
    hosts = stored(counts.where(F.col("kind") == PAGE).select("host", F.col("n").alias("articles")).join(mains, "host"), "hosts")
    least = lambda share: F.col("n") >= share * F.col("articles")
    recurs = (
        F.when(F.col("kind") == OUTSIDE, least(LEAST_SHARE) | (F.col("apart") >= MANY_ARTICLES) & (F.col("apart") >= LEAST_DIFFERENT * F.col("n")))
        .when(F.col("kind") == PARAGRAPH, least(LEAST_SHARE) & (F.col("n") >= LEAST_DIFFERENT * F.col("pages")))
        .when(F.col("kind") == SHAPE, least(SHAPE_SHARE) & (F.col("words") <= SHAPE_WORDS * F.col("main.words")))
    )
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("hash"))))
    recurring = stored(counts.where(F.col("n") >= LEAST_ARTICLES).join(hosts, "host").where(recurs), "recurring")
    said = recurring.where(F.col("kind") == PARAGRAPH).select("hash").distinct()
    everywhere = counts.where(F.col("kind") == PARAGRAPH).join(said, "hash").groupBy("kind", "hash").agg(F.sum("n").alias("n_everywhere"))
    articles = hosts.agg(F.coalesce(F.sum("articles"), F.lit(0))).first()[0]
    own = (F.col("n_everywhere") - F.col("n")) * F.col("articles") <= ELSEWHERE * F.col("n") * (F.lit(articles) - F.col("articles"))
    chosen = recurring.join(everywhere, ["kind", "hash"], "left").where((F.col("kind") != PARAGRAPH) | own)
    templates = chosen.groupBy("host").agg(of(OUTSIDE).alias("outside"), of(PARAGRAPH).alias("paragraphs"), of(SHAPE).alias("shapes"), F.min("main.hash").alias("main"))
    templates = stored(templates, "templates")
    dropped(counts, hosts, recurring)
    return templates


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, host for each page."""
    steady(pages.sparkSession)
    kind = dict(pages.dtypes)["page_id"]
    # ids travel as text: pandas would make floats of a column with nulls
    pages = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    templates = site_templates(pages)
    sizes = F.size("outside") + F.size("paragraphs") + F.size("shapes")
    rows = templates.agg(F.coalesce(F.sum(sizes), F.lit(0))).first()[0]
    small = F.broadcast(templates) if rows <= BROADCAST_ROWS else templates

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Template | None] = {}
        for b in batches:
            texts = []
            for host, html, outside, paragraphs, shapes, main in zip(b.host, b.html, b.outside, b.paragraphs, b.shapes, b.main, strict=True):
                if host not in known:
                    if len(known) >= 64:
                        known.clear()
                    known[host] = None if outside is None else Template(frozenset(outside.tolist()), frozenset(paragraphs.tolist()), frozenset(shapes.tolist()), int(main))
                texts.append(main_text(html, known[host]))
            yield pd.DataFrame({"page_id": b.page_id, "url": b.url, "text": texts, "n_chars": [len(t) for t in texts], "host": b.host})

    # a path as a number would become a float beside hosts without a template
    joined = pages.join(small.withColumn("main", F.col("main").cast("string")), "host", "left")
    found = joined.mapInPandas(extract, "page_id string, url string, text string, n_chars long, host string")
    return found.withColumn("page_id", F.col("page_id").cast(kind))
