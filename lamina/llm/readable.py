"""Main text of web pages by tree scoring.

The page is read into a tree that forgives missing and stray end tags. Elements that are
not reading matter by their name, role or class are cut out: scripts, styles, forms,
menus, page headers and footers, sidebars, notices, adverts, reader comments. A class or id
cuts by itself only if all its words say so, as in ``cookie-notice``; one word of several
(``related-work``, ``ad-hoc-tests``), or an id that may be a section's subject
(``discussion``), needs more: that much of the element is links or that it stands outside of
the page's article. Headings are not cut by class or id. Each paragraph then passes points to its ancestors, one for itself, one for each comma and up
to three for its length: all to the parent, half to the grandparent, a third to the next.
A container's points are discounted by its share of link text. The container with most
points is kept, and with it what stands beside it and beside each container around it, up to
the outermost article, else the main element or the body: headings, paragraphs, containers
and loose text, unless much of it is links; in an article headings and paragraphs stay
whatever they link to, and of several articles all stay that hold prose and are not mostly links. Outside of an article or main element a
container needs the points of one paragraph, and loose text a paragraph's length. How long
the best container is does not matter.

All of the kept elements' text is returned, block by block: character references are
decoded, white space inside a block becomes one space, blocks are joined by a line break.

Edge cases: a null or empty page, and a page without text, give the empty string; a page
without markup is one block; ends are implied as browsers imply them; equal scores go to
the first container in page order; end tags that close nothing are ignored; an unclosed
comment, tag or script runs to the end of the page. Depth is not limited by recursion.
"""

from __future__ import annotations

import html as references
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody "
    "td tfoot th thead tr ul".split()
)
CUT = frozenset(
    "script style noscript template head title nav aside footer form button select option textarea input iframe "
    "object embed applet canvas svg annotation annotation-xml audio video dialog menu noembed noframes xmp".split()
)
CUT_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split()
)
#: Words in a class or id that tell what an element is for.
CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner banners sponsor sponsored promo "
    "promotion menu menus nav navbar navigation navigator breadcrumb breadcrumbs sidebar sidebars rail aside "
    "footer foot masthead topbar header cookie cookies consent gdpr notice notices notification popup modal "
    "overlay newsletter subscribe subscription signup login share sharing shares social related recommended "
    "recommendations comment comments commentlist disqus reply replies respond discussion pagination pager "
    "widget widgets toolbar search copyright skip hidden alert disclaimer".split()
)
#: Words beside the above that only tell where or what kind of box an element is.
BOX_WORDS = frozenset(
    "main top left right bottom list box bar container wrapper wrap section area block site page global item items "
    "unit slot inner outer primary secondary mobile desktop form link links button buttons icon icons post entry "
    "article story the in".split()
)
#: Words above that are subjects of articles too, so that they may be a section's id.
SUBJECTS = frozenset(
    "ad ads advert adverts advertisement advertising banner banners sponsor sponsors promotion menu menus navigation "
    "header cookie cookies consent gdpr notice notices notification notifications newsletter subscription share "
    "sharing shares social related recommended recommendations comment reply replies discussion search copyright "
    "alert login overlay hidden disclaimer".split()
)
#: Words that speak for an element although others speak against it, if most text is in it.
KEEP_WORDS = frozenset("article body content main post entry story text page".split())
#: Elements that an opening element of the given name ends, up to the nearest boundary.
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Paragraphs end where any block begins, but not across these.
SCOPES = frozenset("table td th caption button object html body".split())
SCORED = frozenset("p pre blockquote td li dd h2 h3 h4 h5 h6 figcaption".split())
#: Elements that belong to an article whatever part of their text is in links.
PROSE = frozenset("p pre blockquote dd dt figcaption h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
TAG_PART = re.compile(r"""=\s*["']|>""")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|$)", re.I) for name in RAW}
#: End tags that close across a table's cells.
TABLE_PARTS = frozenset("tr table tbody thead tfoot body html".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Element:
    """A node of the tree; its children are elements and strings."""

    __slots__ = ("name", "attributes", "parent", "children")

    def __init__(self, name: str, attributes: dict[str, str], parent: Element | None):
        self.name, self.attributes, self.parent = name, attributes, parent
        self.children: list[Element | str] = []


def attributes_of(source: str) -> dict[str, str]:
    found = {}
    for name, *values in ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), references.unescape(next((v for v in values if v), "")))
    return found


def parse(page: str) -> Element:
    """The page's tree, under a nameless root."""
    tree, pos, end = Tree(page), 0, len(page)
    while pos < end:
        opened = page.find("<", pos)
        if opened < 0:
            tree.text(page[pos:])
            break
        if opened > pos:
            tree.text(page[pos:opened])
        following = page[opened + 1 : opened + 2]
        if page.startswith("<!--", opened):
            closed = page.find("-->", opened + 4)
            pos = closed + 3 if closed >= 0 else end
        elif following in ("!", "?"):
            closed = page.find(">", opened)
            pos = closed + 1 if closed >= 0 else end
        elif (name := NAME.match(page, opened + 1)) is None:
            tree.text("<")
            pos = opened + 1
        else:
            pos = tree.end_of_tag(name.end())
            source = page[name.end() : pos - 1]
            if following == "/":
                tree.close(name[1].lower())
            else:
                pos = tree.open(name[1].lower(), source, pos)
    return tree.root


class Tree:
    """The tree while it is read, with the depths of the open elements of each name.

    No tag climbs the tree: what it ends is found by the depths, and an element is left once.
    """

    def __init__(self, page: str):
        self.page = page
        self.root = Element("", {}, None)
        self.stack = [self.root]
        self.depths: dict[str, list[int]] = {}
        self.last_quote = {quote: page.rfind(quote) for quote in "\"'"}

    def text(self, text: str) -> None:
        self.stack[-1].children.append(text)

    def end_of_tag(self, pos: int) -> int:
        """Behind the tag's ``>``, those in quoted values left aside; a quote without an end is none."""
        while (found := TAG_PART.search(self.page, pos)) is not None:
            quote = found[0][-1]
            if quote == ">":
                return found.end()
            pos = found.end()
            if self.last_quote[quote] >= pos:
                pos = self.page.index(quote, pos) + 1
        return len(self.page)

    def open(self, name: str, source: str, pos: int) -> int:
        if name in BLOCKS:
            self._end({"p"}, SCOPES)
        if name in HEADINGS:
            self._end(HEADINGS, BLOCKS - HEADINGS)
        if name in IMPLIED_ENDS:
            self._end(*IMPLIED_ENDS[name])
        at = self.stack[-1]
        element = Element(name, attributes_of(source) if source else {}, at)
        at.children.append(element)
        if name in RAW:
            closed = RAW_ENDS[name].search(self.page, pos)
            element.children.append(self.page[pos : closed.start() if closed else len(self.page)])
            after = self.page.find(">", closed.end()) if closed else -1
            return after + 1 if after >= 0 else len(self.page)
        if not (name in VOID or source.endswith("/") and name not in BLOCKS and name != "a"):
            self.depths.setdefault(name, []).append(len(self.stack))
            self.stack.append(element)
        return pos

    def close(self, name: str) -> None:
        """Leaves the nearest open element of the name; one beyond a table's cell only for parts of tables."""
        depth = self._deepest({name})
        cell = 0 if name in TABLE_PARTS else self._deepest({"td", "th", "table"} - {name})
        if depth > cell:
            self._leave(depth)

    def _end(self, names: set[str] | frozenset[str], scopes: set[str] | frozenset[str]) -> None:
        """Leaves the outermost open element of the names inside the nearest scope."""
        if any(self.depths.get(name) for name in names):
            scope = self._deepest(scopes)
            inside = []
            for name in names:
                depths = self.depths.get(name, [])
                inside += depths[bisect_right(depths, scope) :][:1]
            if inside:
                self._leave(min(inside))

    def _deepest(self, names: set[str] | frozenset[str]) -> int:
        return max((self.depths[name][-1] for name in names if self.depths.get(name)), default=0)

    def _leave(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.depths[self.stack.pop().name].pop()


def walk(root: Element) -> Iterator[tuple[Element | str, bool]]:
    """Every node in page order, as (node, entering); elements come again when left."""
    stack: list[tuple[Element | str, bool]] = [(root, True)]
    while stack:
        node, entering = stack.pop()
        yield node, entering
        if entering and isinstance(node, Element):
            stack.append((node, False))
            stack.extend((child, True) for child in reversed(node.children))


def words_of(token: str) -> set[str]:
    return {word.lower() for word in WORDS.findall(token)}


def marks_of(element: Element) -> set[str]:
    return words_of(f"{element.attributes.get('class', '')} {element.attributes.get('id', '')}")


def _says_so(element: Element) -> bool:
    """Whether a whole token of the class, or the id, names what is cut, and not only one word of it."""
    for token in element.attributes.get("class", "").split():
        words = words_of(token)
        if words & CUT_WORDS and words <= CUT_WORDS | BOX_WORDS:
            return True
    words = words_of(element.attributes.get("id", ""))
    cut = words & CUT_WORDS
    return words <= CUT_WORDS | BOX_WORDS and (len(cut) > 1 or bool(cut - SUBJECTS))


def prune(root: Element) -> None:
    """Takes out what is not reading matter; a wrapper of most of the text stays if it says so."""
    for node, entering in walk(root):
        if entering and isinstance(node, Element):
            node.children = [c for c in node.children if isinstance(c, str) or c.name not in CUT]
    text, links, holders = _extents(root)
    pending = [(root, False)]
    while pending:
        parent, in_article = pending.pop()
        in_article = in_article or parent.name == "article"
        kept = []
        for child in parent.children:
            if isinstance(child, Element):
                mostly_links = 2 * links[id(child)] >= text[id(child)]
                of_most = 2 * text[id(child)] > text[id(root)]
                outside = bool(holders) and id(child) not in holders and not in_article
                if _unwanted(child, in_article, outside, mostly_links, of_most):
                    continue
                pending.append((child, in_article))
            kept.append(child)
        parent.children = kept


def _extents(root: Element) -> tuple[dict[int, int], dict[int, int], set[int]]:
    """Of each element the characters below and those in links; and which are articles or around one."""
    text, links, holders, in_link = {}, {}, set(), 0
    stack: list[Element] = []
    for node, entering in walk(root):
        if isinstance(node, str):
            length = len(node.strip())
            text[id(stack[-1])] += length
            links[id(stack[-1])] += length if in_link else 0
        elif entering:
            in_link += node.name == "a"
            text[id(node)] = links[id(node)] = 0
            stack.append(node)
        else:
            in_link -= node.name == "a"
            stack.pop()
            if node.name == "article":
                holders.add(id(node))
            if stack:
                text[id(stack[-1])] += text[id(node)]
                # Of a link itself all text counts as link text only for what is around it.
                links[id(stack[-1])] += text[id(node)] if node.name == "a" and not in_link else links[id(node)]
                if id(node) in holders:
                    holders.add(id(stack[-1]))
    return text, links, holders


def _unwanted(element: Element, in_article: bool, outside: bool, mostly_links: bool, of_most: bool) -> bool:
    """``outside``: the page has articles, and the element is neither in nor around one."""
    given = element.attributes
    if element.name in ("html", "body", "main", "article"):
        return False
    if element.name == "header":
        return not in_article
    if not given:
        return False
    if "hidden" in given or given.get("aria-hidden") == "true" or HIDDEN.search(given.get("style", "")):
        return True
    if given.get("role", "").lower() in CUT_ROLES:
        return True
    words = marks_of(element)
    if element.name in HEADINGS or not words & CUT_WORDS:
        return False
    if not (_says_so(element) or outside or mostly_links):
        return False
    return not (words & KEEP_WORDS and of_most)


def blocks_of(element: Element) -> list[str]:
    """The texts of the blocks below, each with single spaces."""
    found, pieces = [], []

    def end() -> None:
        if text := " ".join(references.unescape("".join(pieces)).split()):
            found.append(text)
        pieces.clear()

    for node, _ in walk(element):
        if isinstance(node, str):
            pieces.append(node)
        elif node.name in BLOCKS:
            end()
        elif node.name == "br":
            pieces.append(" ")
    end()
    return found


class Measures:
    """For each element the text below, that in links, and the points."""

    def __init__(self, root: Element):
        self.text: dict[int, int] = {}
        self.links: dict[int, int] = {}
        self.points: dict[int, float] = {}
        self.order: list[Element] = []
        commas: dict[int, int] = {}
        in_link = 0
        for node, entering in walk(root):
            if isinstance(node, str):
                continue
            if entering:
                in_link += node.name == "a"
                self.order.append(node)
                own = [c for c in node.children if isinstance(c, str)]
                length = sum(len(" ".join(c.split())) for c in own)
                self.text[id(node)], self.links[id(node)] = length, length if in_link else 0
                commas[id(node)] = sum(c.count(",") for c in own)
            else:
                in_link -= node.name == "a"
                if (up := node.parent) is not None:
                    self.text[id(up)] += self.text[id(node)]
                    self.links[id(up)] += self.links[id(node)]
                    commas[id(up)] += commas[id(node)]
                self._pass_on(node, commas[id(node)])

    def _pass_on(self, node: Element, commas: int) -> None:
        """Points of a paragraph, or of a container's own text, for the ancestors."""
        length = self.text[id(node)]
        if node.name in SCORED and length:
            gained = 1 + commas + min(length / 100, 3)
            target = node.parent
        else:
            own = [c for c in node.children if isinstance(c, str) and c.strip()]
            length = sum(map(len, own))
            if node.name not in BLOCKS | {""} or not length:
                return
            gained = 1 + sum(c.count(",") for c in own) + min(length / 100, 3)
            target = node
        share = 1
        while target is not None:
            self.points[id(target)] = self.points.get(id(target), 0) + gained / share
            target, share = target.parent, share + 1
            if share > 5:
                break

    def holds_prose(self, element: Element) -> bool:
        """Whether a paragraph, or loose text, passed points to the element."""
        return self.points.get(id(element), 0.0) > 0

    def density(self, element: Element) -> float:
        text = self.text[id(element)]
        return self.links[id(element)] / text if text else 0.0

    def score(self, element: Element) -> float:
        return self.points.get(id(element), 0.0) * (1 - self.density(element))


def main_text(page: str | None) -> str:
    """The page's main text, its blocks joined by line breaks."""
    if not page:
        return ""
    root = parse(page)
    prune(root)
    measures = Measures(root)
    best = max(measures.order, key=measures.score, default=None)
    if best is None or not measures.score(best):
        return "\n".join(blocks_of(root))
    if best.parent is None:
        return "\n".join(blocks_of(best))
    top, inside = _top_of(best)
    node = best
    while node is not top:
        node.parent.children = _reading(node.parent.children, node, measures, inside)
        node = node.parent
    if top.name != "article":
        return "\n".join(blocks_of(top))
    return "\n".join(block for article in _articles(root, top, measures) for block in blocks_of(article))


def _articles(root: Element, best: Element, measures: Measures) -> list[Element]:
    """The outermost articles in page order: the best one, and the others that hold prose and not mostly links."""
    found, depth = [], 0
    for node, entering in walk(root):
        if isinstance(node, Element) and node.name == "article":
            if entering and depth == 0 and (node is best or measures.holds_prose(node) and measures.density(node) < 0.5):
                found.append(node)
            depth += 1 if entering else -1
    return found


def _top_of(best: Element) -> tuple[Element, bool]:
    """The outermost article around the container, else its main element or body, and whether it is not the body."""
    around = [best]
    while around[-1].parent is not None:
        around.append(around[-1].parent)
    for name in ("article", "main"):
        if found := [e for e in around if e.name == name]:
            return found[-1], True
    found = [e for e in around if e.name == "body"]
    return (found or [e for e in around if e.name not in ("html", "")] or around)[-1], False


def _reading(children: list[Element | str], best: Element, measures: Measures, inside: bool) -> list[Element | str]:
    """The children without those that do not belong to the one given; text and inline elements in a row are one."""
    kept, row = [], []
    for child in [*children, None]:
        if isinstance(child, str) or child is not None and child is not best and child.name not in BLOCKS:
            row.append(child)
            continue
        if _row_belongs(row, measures, inside):
            kept += row
        row = []
        if child is best or child is not None and _belongs(child, measures, inside):
            kept.append(child)
    return kept


def _row_belongs(row: list[Element | str], measures: Measures, inside: bool) -> bool:
    text = sum(len(" ".join(c.split())) if isinstance(c, str) else measures.text[id(c)] for c in row)
    links = sum(measures.links[id(c)] for c in row if isinstance(c, Element))
    return text >= (1 if inside else 80) and links < (0.5 if inside else 0.25) * text


def _belongs(sibling: Element, measures: Measures, inside: bool) -> bool:
    if inside and sibling.name in PROSE:
        return measures.text[id(sibling)] > 0
    if sibling.name in HEADINGS:
        return measures.density(sibling) < 0.5
    if sibling.name in SCORED and not inside:
        return measures.density(sibling) < 0.25 and measures.text[id(sibling)] > 0
    if inside:
        return measures.density(sibling) < 0.5 and measures.text[id(sibling)] > 0
    return measures.score(sibling) >= 2 and measures.density(sibling) < 0.5


def extracted(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Adds the main text of each page, replacing a column of that name."""

    @F.pandas_udf("string")
    def of(pages_html: pd.Series) -> pd.Series:
        return pd.Series([main_text(page) for page in pages_html], dtype=object)

    return pages.withColumn(text, of(F.col(html)))


def page_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    rows = extracted(pages.select("page_id", "url", "html"))
    return rows.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
