"""HTML extraction by tree scoring.

A tolerant tokenizer builds the element tree of a page. Paragraphs pass points
for length and commas to their ancestors, halved at each level; an element's
points are discounted by its link density. The best container and its siblings
are kept, at the lowest level where it has any, and their blocks, minus
furniture (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles, reader comments), make up the text in page order. Tags and roles decide
on furniture; names in class and id are only a penalty: a named element is
scored on its own. Outside the article around the best container (or, without
one, outside the container and its siblings) it goes; inside, headings, ids and
sections are often named after their subject, so names decide there only where
they cannot mean it (``goes``), or where most of the text is links. A sibling
that is mostly links or a copyright line goes as a menu, unless it is a list under a heading or a
text, and so does, directly below the body, a plain box with less text than a
paragraph.

One row in, one row out, no shuffle; memory follows one batch of pages.

Edge cases: a page of any length is parsed whole. Null or empty html, or a page without text, gives an empty text.
Broken markup (unclosed elements, a page cut inside a tag or a character
reference) is read as far as it goes. Of equally good containers the outermost
is taken, and the first. Repeated rows are extracted each on its
own; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, picked

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in ("script", "style", "textarea", "title", "xmp", "noframes")}

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
#: Elements never part of the main text.
FURNITURE = frozenset(
    "nav footer aside header form script style noscript template head button select textarea input iframe object "
    "svg canvas menu dialog search option datalist audio video map".split()
)
#: Words in class, id or role that mark furniture.
FURNITURE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation "
    "menu breadcrumb breadcrumbs footer sidebar aside comment comments commentlist disqus respond reply replies "
    "cookie cookies consent gdpr notice notices notification alert banner popup modal newsletter subscribe signup "
    "share sharing social related recommended masthead toolbar pagination pager widget search login skip "
    "complementary contentinfo dialog form header discussion feedback paywall".split()
)
#: An end tag of these closes what is still open inside.
CLOSED_BY = {
    "p": BLOCK - {"body", "html"},
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "tfoot"}),
    "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "option": frozenset({"option", "optgroup"}),
}
SCOPE = frozenset("ul ol dl table div article section main body html blockquote td th".split())
SPACE = re.compile(r"[\s ]+")
WORDS = re.compile(r"[A-Za-z]+")
#: Those of them that a section, heading or paragraph of an article is hardly named after.
STRONG_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored nav navbar breadcrumb breadcrumbs sidebar "
    "comment comments commentlist disqus respond cookie cookies consent gdpr newsletter subscribe signup masthead "
    "toolbar pagination pager widget popup modal banner paywall footer".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements that go inside an article only by a strong name that stands alone.
TEXTS = frozenset("p li dl dt dd pre blockquote figure figcaption table tr td th details section ol".split())
#: Words before a name that says what an element has or lacks, not what it is.
HAVING = frozenset("has have having no not non with without hide show".split())
#: Words beside "header" for the head of an article.
CONTENT_WORDS = frozenset("entry post article story content text body title news chapter section".split())
#: What a named element's points count: all words of one of its names are furniture, or some.
ALL_NAMED, PART_NAMED = 0.05, 0.3
#: Least characters of a paragraph, and of a plain box beside the best container.
PARAGRAPH = 25
#: Elements that are content by their kind, however short.
CONTENT_TAGS = frozenset("article main section p h1 h2 h3 h4 h5 h6 hgroup header ul ol dl table pre blockquote figure details".split())
#: How a footer of its own begins.
COPYRIGHT = re.compile(r"\s*(?:©|&copy;|&#169;|\(c\)|copyright\b)", re.I)
#: Parts of run-together names that mark furniture.
FURNITURE_PARTS = re.compile(r"comment|sidebar|advert|cookie|newsletter|breadcrumb|sponsor|disqus|navigation")


class Node:
    """An element; children are nodes and strings in page order."""

    __slots__ = ("tag", "attrs", "kids", "up", "score", "size", "linked", "skip", "named", "weight")

    def __init__(self, tag: str, attrs: str = "", up: Node | None = None):
        self.tag, self.attrs, self.up = tag, attrs, up
        self.kids: list[Node | str] = []
        self.score, self.size, self.linked, self.skip = 0.0, 0, 0, False
        self.named, self.weight = False, 1.0


def parse(html: str) -> Node:
    """The element tree; unknown or stray end tags are ignored."""
    root = Node("html")
    top, pos, n = root, 0, len(html)
    while pos < n:
        m = TOKEN.search(html, pos)
        if m is None:
            top.kids.append(html[pos:])
            break
        if m.start() > pos:
            top.kids.append(html[pos : m.start()])
        pos = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            node = top
            while node is not None and node.tag != tag:
                if tag in ("b", "i", "em", "strong", "a", "span", "u", "font", "small") and node.tag in BLOCK:
                    node = None
                    break
                node = node.up
            if node is not None and node.up is not None:
                top = node.up
            continue
        if tag in ("html", "body"):
            continue
        if tag in BLOCK or tag in CLOSED_BY:
            node = top
            while node is not None and node.up is not None:
                if tag in CLOSED_BY.get(node.tag, ()):
                    top = node.up
                    if node.tag != "p":
                        break
                if node.tag in SCOPE and node.tag not in CLOSED_BY:
                    break
                node = node.up
        node = Node(tag, m.group(3), top)
        top.kids.append(node)
        if tag in VOID or m.group(3).endswith("/"):
            continue
        if tag in RAW_END:
            end = RAW_END[tag].search(html, pos)
            raw = html[pos : end.start() if end else n]
            pos = end.end() if end else n
            if tag not in ("script", "style"):
                node.kids.append(raw)
            continue
        top = node
    return root


def is_furniture(node: Node) -> bool:
    """Whether tag, role or style mark the element as no main text."""
    if node.tag in FURNITURE and node.tag != "header":
        return True
    if node.tag == "header":
        up = node.up
        while up is not None and up.tag not in ("article", "main"):
            up = up.up
        if up is None:
            return True
    if not node.attrs or node.tag in ("article", "main"):
        return False
    for name, value in ATTRIBUTE.findall(node.attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and (not FURNITURE_NAMES.isdisjoint(WORDS.findall(value)) or FURNITURE_PARTS.search(value)):
            return True
    return False


def furniture_words(token: str) -> tuple[list[str], list[str]]:
    """The words of a class token or id, and those of them that mark furniture."""
    words = WORDS.findall(token)
    for i, w in enumerate(words):
        if w in HAVING:
            words = words[:i]
            break
    marks = [w for w in words if w in FURNITURE_NAMES or FURNITURE_PARTS.search(w)]
    return words, [] if marks == ["header"] and not CONTENT_WORDS.isdisjoint(words) else marks


def names(node: Node) -> list[tuple[str, str]]:
    """Pairs of "class" or "id" and a single name."""
    found = [(k.lower(), v.strip("\"'").lower()) for k, v in ATTRIBUTE.findall(node.attrs)]
    return [(k, t) for k, v in found if k in ("class", "id") for t in v.split()]


def names_weight(node: Node) -> float:
    """What an element's names leave of its points; 1 if none marks furniture."""
    if not node.attrs or node.tag in ("article", "main"):
        return 1.0
    least = 1.0
    for _, token in names(node):
        words, marks = furniture_words(token)
        if marks:
            least = min(least, ALL_NAMED if all(w in FURNITURE_NAMES for w in words) else PART_NAMED)
    return least


def goes(node: Node) -> bool:
    """Whether a named element inside the article is furniture nevertheless.

    A heading never is. Others are if most of their text is links, or by a strong name
    that stands alone; boxes also by a class that is a furniture word, or a
    strong word beside others. An id counts only on boxes and sections.
    """
    if node.tag in HEADINGS:
        return False
    if density(node) >= 0.5:
        return True
    for kind, token in names(node):
        words, marks = furniture_words(token)
        if not marks:
            continue
        alone = len(marks) == len(words)
        strong = any(w in STRONG_NAMES or FURNITURE_PARTS.search(w) for w in marks)
        if node.tag in TEXTS:
            if alone and strong and (kind == "class" or node.tag == "section"):
                return True
        elif strong or (alone and kind == "class"):
            return True
    return False


def walk(root: Node) -> list[Node]:
    """All elements outside furniture, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        for k in node.kids:
            if not isinstance(k, str):
                k.skip = k.tag in FURNITURE and k.tag != "header" or is_furniture(k)
                if not k.skip and k.tag != "title":
                    own = names_weight(k)
                    k.named, k.weight = own < 1, node.weight * own
                    todo.append(k)
                else:
                    k.skip = True
    return out


def measure(nodes: list[Node]) -> None:
    """Text sizes, linked text sizes and propagated paragraph scores."""
    for node in reversed(nodes):
        own, commas = 0, 0
        for k in node.kids:
            if isinstance(k, str):
                size = len(k.strip())
                own += size
                commas += k.count(",")
            elif not k.skip and not k.named:
                node.size += k.size
                node.linked += k.linked
                if k.tag not in BLOCK:
                    own += k.size
        node.size += sum(len(k.strip()) for k in node.kids if isinstance(k, str))
        if node.tag == "a":
            node.linked = node.size
        if node.tag in BLOCK and own >= PARAGRAPH:
            # A paragraph: its points go to the ancestors, halved at each level,
            # up to the first that is named as furniture.
            points = (1 + commas + min(own / 100, 3)) * (1 - min(1.0, node.linked / max(1, node.size)))
            leaf = node.tag in ("p", "li", "td", "pre", "blockquote", "dd") and not node.named
            up, share = node.up if leaf else node, node.weight
            while up is not None and share > 0.01 * node.weight:
                up.score += points * share
                up, share = None if up.named else up.up, share / 2


def density(node: Node) -> float:
    return node.linked / node.size if node.size else 0.0


def blocks(node: Node) -> list[str]:
    """The texts of the blocks below, white space folded, in page order."""
    out: list[str] = []
    piece: list[str] = []

    def flush() -> None:
        text = SPACE.sub(" ", unescape("".join(piece))).strip()
        piece.clear()
        if text:
            out.append(text)

    todo: list[Node | str | None] = [node]
    while todo:
        k = todo.pop()
        if k is None:
            flush()
        elif isinstance(k, str):
            piece.append(k)
        elif k.skip:
            continue
        elif k.tag in ("br", "wbr"):
            piece.append(" " if k.tag == "br" else "")
        else:
            block = k.tag in BLOCK
            if block:
                flush()
                todo.append(None)
            todo.extend(reversed(k.kids))
    flush()
    return out


def beside(container: Node) -> Node:
    """The container with its siblings, as an element of its own, without menus."""
    out = Node("div")
    inline: list[Node | str] = []
    body = container.up.up is None

    def take(kids: list[Node | str]) -> None:
        """A run of inline text counts as a paragraph if it is one; below the body that takes some length."""
        size = sum(len(k.strip()) if isinstance(k, str) else k.size for k in kids)
        linked = sum(k.linked for k in kids if not isinstance(k, str))
        if size >= (PARAGRAPH if body else 1) and 2 * linked < size:
            out.kids.append(Node("p"))
            out.kids[-1].kids = kids

    def menu(k: Node) -> bool:
        """Mostly links, or a short copyright line; a list right under a heading or text is one of sources or the like."""
        if k.size < PARAGRAPH and k.tag not in CONTENT_TAGS and COPYRIGHT.match("".join(x for x in k.kids if isinstance(x, str))):
            return True
        under = bool(out.kids) and out.kids[-1].tag in HEADINGS | {"p"}
        return density(k) >= 0.5 and not (k.tag in ("ul", "ol", "dl") and under)

    for k in container.up.kids:
        if isinstance(k, str) or (k.tag not in BLOCK and k is not container):
            inline.append(k)
            continue
        take(inline)
        inline = []
        if k is container or (not k.skip and not menu(k) and (not body or k.tag in CONTENT_TAGS or k.size >= PARAGRAPH)):
            out.kids.append(k)
    take(inline)
    return out


def main_text(html: str | None) -> str:
    """Main text of one page, blocks joined by a blank line."""
    if not html:
        return ""
    root = parse(html)
    nodes = walk(root)
    measure(nodes)
    best = max(nodes, key=lambda x: x.score * (1 - density(x)), default=root)
    # Text under furniture names has to outweigh all text outside them.
    if best.weight < 1 and best.size * best.weight <= root.size:
        best = max((x for x in nodes if x.weight == 1), key=lambda x: x.score * (1 - density(x)), default=root)
    if best.score <= 0:
        best = root
    around, up = set(), best
    while up is not None:
        around.add(id(up))
        up = up.up
    # The article or main element around the best container holds its heading.
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.up
    best = up if up is not None else best
    # What is named as furniture goes, but for the elements around the best container.
    inside = {id(best if up is not None else best.up or best)}
    for node in nodes:  # parents first
        if id(node.up) in inside:
            inside.add(id(node))
        if node.named and id(node) not in around:
            node.skip = node.skip or id(node) not in inside or goes(node)
    # A wrapper that holds nothing else is no level of its own.
    while best.up is not None and best.tag != "main":
        found = beside(best)
        if len(found.kids) > 1 or best.up.up is None:
            return "\n\n".join(blocks(found))
        best = best.up
    return "\n\n".join(blocks(best))


def html_extraction(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return map_arrow(
        picked(pages, page_id="long", url="string", html="string"),
        extract,
        "page_id long, url string, text string, n_chars long",
    )
