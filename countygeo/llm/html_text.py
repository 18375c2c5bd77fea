"""Main text of web pages by tree scoring (operator 10)."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countygeo.llm.text import blocks

# Elements of HTML by their part in a page.
RAW = frozenset("script style noscript template iframe object svg math canvas title textarea xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp "
                    "small span strike strong sub sup time tt u var").split())
DROPPED = frozenset("nav footer aside form button select menu dialog fieldset head audio video map datalist".split())
ARTICLE = frozenset(("article", "main"))
PARAGRAPH = frozenset("p pre td blockquote li dd figcaption h1 h2 h3 h4 h5 h6 div section article main center".split())
#: Elements that end when one of the named ones begins inside the same list, table or paragraph.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody")}
SCOPES = frozenset("ul ol dl table html body article main section div blockquote td th".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: Words in a class or id that tell what is no part of an article; those of comments count whatever stands beside them.
BAD = frozenset(("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
                 "sidebar footer header masthead cookie cookies consent gdpr notice notices newsletter subscribe subscription popup "
                 "modal overlay share sharing social related recommended recommendations breadcrumb breadcrumbs widget toolbar pager "
                 "pagination login signup paywall skip hidden outbrain taboola disclaimer").split())
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond discussion".split())
#: First words of a class that tells what is beside a block, not what it is.
RELATIVE = frozenset("has with no without show hide".split())
INLINE_BAD = frozenset("ad ads advert adverts advertisement sponsor sponsored promo hidden share sharing social".split())
#: End tags that close nothing outside the article they stand in, and scopes that hold rows and items.
HELD = frozenset("p li td tr dd dt".split())
WALLS = SCOPES - {"td", "th"}
GOOD = frozenset("article content main post entry story body text page".split())

# Points: one for a paragraph of MIN_CHARS, one a comma, one for each CHARS characters up to MOST.
MIN_CHARS, CHARS, MOST = 25, 100, 3.0
# A sibling is kept with this share of the best score, or as a paragraph with few links.
SIBLING, LINKS = 0.2, 0.25

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*>""")
_ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)(?:"|$)|'([^']*)(?:'|$)|([^\s"'>][^\s>]*)))?""")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "parent", "parts", "score", "dropped", "doubtful", "chars", "linked", "links", "commas", "own")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.parts: list[str | Node] = []
        self.dropped = self.doubtful = False
        self.clear()

    def clear(self) -> None:
        self.score = 0.0
        self.chars = self.linked = self.links = self.commas = self.own = 0


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), a or b or c)
    return found


def _out_of_sight(found: dict[str, str]) -> bool:
    return ("hidden" in found or found.get("aria-hidden", "").strip().lower() == "true"
            or _UNSEEN.search(found.get("style", "")) is not None)


def _names(found: dict[str, str]) -> list[list[str]]:
    """Words of each class and of the id; what follows "has", "no" and the like names no block."""
    names = [[w.lower() for w in _WORDS.findall(name)] for k in ("class", "id") for name in found.get(k, "").split()]
    return [n for n in names if n and n[0] not in RELATIVE]


def _judge(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether a block is no part of an article, and whether that depends on how much of the page's text it holds.

    A class or id with both kinds of words is what its last word says, as
    ``post-share`` is for sharing; the block goes unless most text is in it.
    """
    if tag in DROPPED or tag == "header" and not in_article:
        return True, False
    if not attributes or tag in ("html", "body"):
        return False, False
    found = _attributes(attributes)
    if _out_of_sight(found) and tag not in ARTICLE:
        return True, False
    if found.get("role", "").lower() in ROLES:
        return True, False
    names = _names(found)
    words = {w for n in names for w in n}
    if words & COMMENTS and not (tag in ARTICLE and words & GOOD):
        return True, False
    if tag in ARTICLE or not words & BAD:
        return False, False
    if not words & GOOD:
        return True, False
    return False, any(n[-1] in BAD for n in names)


def _unwanted_inline(attributes: str) -> bool:
    found = _attributes(attributes)
    return _out_of_sight(found) or any(n[-1] in INLINE_BAD for n in _names(found))


class _Open:
    """Open elements, with the places of each tag and of the barriers among them."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.places: dict[str, list[int]] = {}
        self.in_article = 0

    def last(self, tags: Iterable[str]) -> int:
        """Place of the innermost open element of one of the tags; 0 if none is open."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)
        self.in_article += node.tag in ARTICLE

    def close(self, to: int) -> None:
        while len(self.stack) > to:
            node = self.stack.pop()
            self.places[node.tag].pop()
            self.in_article -= node.tag in ARTICLE


def parse(page: str) -> Node:
    """Tree of block elements; inline elements only mark text as linked, raw and unwanted elements stay empty."""
    root = Node("html", None)
    opened = _Open(root)
    stack, in_link, at = opened.stack, False, 0
    unclosed = False
    n = len(page)

    def add(text: str) -> None:
        if not text:
            return
        node = stack[-1]
        if in_link:
            node.parts.append("\0")
        node.parts.append(html.unescape(text).replace("\0", " "))
        if in_link:
            node.parts.append("\0")

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        add(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt)
        if not m:
            add("<")
            at = lt + 1
            continue
        plain = page.find(">", m.end())
        if plain < 0:
            break  # the page ends inside a tag
        end = plain + 1
        if not unclosed and ('"' in page[m.end():plain] or "'" in page[m.end():plain]):
            rest = _REST.match(page, m.end())
            if rest:
                end = rest.end()
            else:
                unclosed = True
        closing, tag, attributes = m[1] == "/", m[2].lower(), page[m.end():end - 1]
        at = end
        if closing:
            if tag == "a":
                in_link = False
            if tag in INLINE and not opened.places.get(tag):
                continue
            place = opened.last((tag,))
            if place and not (tag in HELD and opened.last(ARTICLE) > place):
                opened.close(place)
                in_link = False
            if tag in INLINE:
                continue
            stack[-1].parts.append(" ")
            continue
        if tag in RAW:
            found = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(page, at)
            if attributes.rstrip().endswith("/") and tag in ("svg", "math"):
                continue
            stop = page.find(">", found.end() - 1) if found else -1
            at = n if stop < 0 else stop + 1
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                stack[-1].parts.append(" ")
            continue
        if tag in INLINE:
            # Only unwanted inline elements are nodes, and those of the same tag inside them.
            unwanted = bool(attributes) and _unwanted_inline(attributes)
            if unwanted or opened.places.get(tag):
                node = Node(tag, stack[-1])
                node.dropped = unwanted
                stack[-1].parts.append(node)
                opened.push(node)
            in_link = in_link or tag == "a"
            continue
        in_link = False
        paragraph = opened.last(("p",))
        if paragraph > opened.last(SCOPES):
            opened.close(paragraph)
        ended = CLOSES.get(tag, ())
        if ended and (place := opened.last(ended)) > opened.last(WALLS):
            opened.close(place)
        if tag in ("html", "body") and not stack[-1].parts:
            continue
        parent = stack[-1]
        node = Node(tag, parent)
        node.dropped, node.doubtful = _judge(tag, attributes, opened.in_article > 0)
        parent.parts.append(node)
        opened.push(node)
    return root


def _post_order(root: Node) -> list[Node]:
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [p for p in node.parts if isinstance(p, Node) and not p.dropped]
    return order[::-1]


def _measure(order: list[Node]) -> None:
    """Characters, linked characters and commas of each node, own text and below."""
    for node in order:
        linked = False
        for part in node.parts:
            if isinstance(part, Node):
                if not part.dropped:
                    node.chars += part.chars
                    node.linked += part.linked
                    node.links += part.links
            elif part == "\0":
                linked = not linked
                node.links += linked
            else:
                size = sum(map(len, part.split()))
                node.chars += size
                node.own += size
                node.linked += size * linked
                node.commas += part.count(",") + part.count("،") + part.count("、") + part.count("，")


def _measured(root: Node) -> list[Node]:
    """Nodes from below, measured, without doubtful blocks unless they hold most of the text."""
    order = _post_order(root)
    _measure(order)
    doubtful = [x for x in order if x.doubtful and 2 * x.chars <= root.chars]
    if not doubtful:
        return order
    for node in doubtful:
        node.dropped = True
    for node in order:
        node.clear()
    order = _post_order(root)
    _measure(order)
    return order


def best_nodes(root: Node) -> list[Node]:
    """The best container, or its article, and the siblings kept with it."""
    order = _measured(root)
    for node in order:
        if node.tag in PARAGRAPH and node.own:
            points = (node.own >= MIN_CHARS) + node.commas + min(node.own / CHARS, MOST)
        else:
            points = 0.0
        # A parent has all points of its paragraphs, and each level above half of what the one below has.
        points += node.score / 2
        if node.parent is not None:
            node.parent.score += points
    for node in order:
        node.score *= 1 - node.linked / max(node.chars, 1)
    best = max(reversed(order), key=lambda x: x.score)
    up = best
    while up is not None and up.tag not in ARTICLE:
        up = up.parent
    if up is not None:
        best = up
    elif best.score == 0:
        best = next((x for x in reversed(order) if x.tag in ARTICLE), root)
    if best.parent is None:
        return [best]
    kept = []
    for part in best.parent.parts:
        if not isinstance(part, Node) or part.dropped:
            continue
        density = part.linked / max(part.chars, 1)
        same = part.tag == best.tag and part.score >= max(1.0, SIBLING * best.score)
        prose = part.tag == "p" and part.chars >= MIN_CHARS and density < LINKS
        heading = part.tag in ("h1", "h2") and density < LINKS
        if part is best or same or prose or heading:
            kept.append(part)
    return kept


def _menu(node: Node) -> bool:
    """Whether a list holds links only, under MIN_CHARS on average, with no more than a separator beside each."""
    return node.tag in ("ul", "ol") and node.links > 1 and node.chars - node.linked <= node.links and node.linked < MIN_CHARS * node.links


def _gather(node: Node, out: list[str]) -> None:
    todo: list[str | Node] = [node]
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            if part != "\0":
                out.append(part)
            continue
        out.append(" ")
        if part.dropped:
            continue
        if part is not node and _menu(part):
            continue
        todo.append(" ")
        todo += reversed(part.parts)


def main_text(page: str | None) -> str:
    """Text of the article in a page: its blocks in page order, white space as one space."""
    if not page:
        return ""
    out: list[str] = []
    for node in best_nodes(parse(page)):
        _gather(node, out)
    return " ".join("".join(out).split())


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, "html"):
        found = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()),
                                          pa.array([len(x) for x in found], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page, from its whole html.

    Paragraphs pass points for length and commas to their ancestors, half as
    many at each level above the parent, and a sum is discounted by the share of linked text. The best container is kept with
    like siblings; if it lies in an article element, the article is. Menus,
    headers, footers, sidebars, notices, adverts, forms and comments are left
    out by element, role, class or id, and lists inside the article that hold
    nothing but short links as menus. Null and empty pages, and pages without
    text, give an empty text. Each repeated row has its own result; columns of
    other names are ignored.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html_column).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")
