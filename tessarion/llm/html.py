"""HTML extraction by tree scoring.

A page becomes a tree of elements.  Paragraphs earn points for length and commas and pass them to their
parent and, halved, to their grandparent; a container's points are discounted by its link density.  The
container with the most points and its like siblings are kept, without boilerplate inside them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

# Element names as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes template noscript svg".split())
DROPPED = frozenset(
    "script style template noscript iframe noembed noframes xmp svg annotation annotation-xml head title nav header footer aside menu dialog "
    "button input select option optgroup textarea label legend datalist output object embed applet canvas audio video map".split()
)
#: Dropped as well, unless the article is inside: some pages are one form.
FORMS = frozenset(("form", "fieldset"))
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table caption colgroup thead tbody tfoot tr td th ul".split()
)
#: Start tags that close an open paragraph.
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
#: Start tags that close an open element of these names, up to one of those names.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr"}),
    "th": ({"td", "th"}, {"tr"}),
    "option": ({"option"}, {"select"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
SCOPES = frozenset(("table", "td", "th", "button", "object"))
ENDS = {name: re.compile(rf"</{name}[\s/>]", re.I) for name in sorted(RAW)}
PARAGRAPH = frozenset("p pre td blockquote li dd".split())
#: Words of class and id that name boilerplate, and those that speak for content.
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice|alert|popup|modal|overlay|nav\w*|menu\w*|"
    r"breadcrumbs?|sidebar|side|widget\w*|rail|footer|foot|header|masthead|topbar|toolbar|share\w*|sharing|social|related|recommend\w*|"
    r"newsletter|subscri\w*|signup|login|comments?|comment-?list|disqus|replies|reply|respond|pagination|pager|tags?|meta|byline|copyright|legal|skip\w*|search\w*|hidden)(?:$|[\s_-])",
    re.I,
)
#: Words that name a link to more as well as the part of an article that is folded away.
MORE = re.compile(r"(?:^|[\s_-])more(?:$|[\s_-])", re.I)
#: Words that name what belongs to an article beside its body.
LEAD = re.compile(r"(?:^|[\s_-])(?:lead|lede|intro\w*|standfirst|dek|deck|teaser|abstract|summary|excerpt|subtitle|subhead\w*|section|part|chapter|epilogue|conclusion)(?:$|[\s_-])", re.I)
CONTENT = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|content|main|body|text|blog|page)(?:$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())

#: A quote opens a value after "=" only, and closes it only before white space, a slash or the end of the tag;
#: else the value is what stands there up to white space.
VALUE = r"""(?:"[^"]*"(?=[\s/>]|\Z)|'[^']*'(?=[\s/>]|\Z)|[^\s>]*)"""
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]++|[^\s>/][^\s>/=]*+(?:\s*=\s*" + VALUE + r")?)*+)>?", re.S)
ATTRIBUTE = re.compile(r"([^\s>/][^\s>/=]*)(?:\s*=\s*(" + VALUE + "))?", re.S)
DEEPEST = 512  # open elements; what opens below them is their sibling, so no page costs more than its length
SPACE = re.compile(r"\s+")
SENTENCE = re.compile(r"[.!?…](?:[\s\"'”’)]|$)")


class Node:
    __slots__ = ("name", "parent", "children", "attrs", "points", "_size", "_links", "_holds")

    def __init__(self, name: str, parent: Node | None, attrs: str = ""):
        self.name, self.parent, self.attrs = name, parent, attrs
        self.children: list[Node | str] = []
        self.points = 0.0

    def names(self) -> dict[str, str]:
        if not self.attrs:
            return {}
        bare = lambda v: v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'" else v.lstrip("\"'")
        return {k.lower(): unescape(bare(v)) for k, v in ATTRIBUTE.findall(self.attrs)}


class OpenElements:
    """Where the next node goes, and how many elements of each name are open above it."""

    def __init__(self, root: Node):
        self.root = self.here = root
        self.n, self.names, self.flat = 0, Counter(), Counter()

    def push(self, node: Node) -> None:
        if self.n < DEEPEST:
            self.here, self.n = node, self.n + 1
            self.names[node.name] += 1
        else:
            self.flat[node.name] += 1

    def pop_to(self, parent: Node) -> None:
        while self.here is not parent:
            self.names[self.here.name] -= 1
            self.here, self.n = self.here.parent, self.n - 1

    def end(self, name: str) -> None:
        """Close the nearest element of that name, if one is open."""
        if self.flat[name]:
            self.flat[name] -= 1
        elif self.names[name]:
            at = self.here
            while at.name != name:
                at = at.parent
            self.pop_to(at.parent)

    def close(self, names: frozenset[str] | set[str], until: frozenset[str] | set[str], nearest: bool = False) -> None:
        """Close open elements of these names that stand within the nearest one of ``until``: the outermost, or the nearest."""
        left = sum(self.names[n] for n in names)
        at, found = self.here, None
        while left and at is not self.root and at.name not in until:
            if at.name in names:
                left, found = left - 1, at
                if nearest:
                    break
            at = at.parent
        if found is not None:
            self.pop_to(found.parent)


def parse(html: str) -> Node:
    """The tree of a page.  Comments are left out; forgotten end tags are supplied; end tags without a
    start are skipped; an end tag closes what is open within its element."""
    root = Node("#root", None)
    open_, at, n = OpenElements(root), 0, len(html)
    while at < n:
        m = TOKEN.search(html, at)
        if m is None:
            open_.here.children.append(unescape(html[at:]))
            break
        if m.start() > at:
            open_.here.children.append(unescape(html[at : m.start()]))
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                open_.here.children.append(m[0][9:].removesuffix("]]>"))
            continue
        name = m[2].lower()
        if m[1]:
            open_.end(name)
            continue
        if name in CLOSES_P:
            open_.close({"p"}, SCOPES, nearest=True)
        if name in CLOSES:
            open_.close(*CLOSES[name])
        node = Node(name, open_.here, m[3] or "")
        open_.here.children.append(node)
        closed = (m[3] or "").endswith("/")
        if name in RAW and not closed:
            end = ENDS[name].search(html, at)
            stop = end.start() if end else n
            if name not in DROPPED:
                node.children.append(html[at:stop])
            at = n if end is None else (html.find(">", stop) + 1 or n)
        elif name not in VOID and not closed:
            open_.push(node)
    return root


def class_names(node: Node) -> str:
    a = node.names()
    return f"{a.get('class', '')} {a.get('id', '')}"


def dropped(node: Node, page_size: int) -> bool:
    """Whether an element is boilerplate by its name, role, class or id.

    A class that sounds like boilerplate does not condemn what holds the headline or the article, nor
    most of the page if the class speaks for content as well.
    """
    if node.name in DROPPED:
        # a header within an article that holds the headline is part of the article
        return not (node.name == "header" and any(a.name in ("article", "main") for a in _above(node)))
    if node.name in FORMS and not (node._holds or 2 * node._size > page_size):
        return True
    if not node.attrs:
        return False
    a = node.names()
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or a.get("role", "").lower() in ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return True
    if node.name in ("main", "body", "html", "a", "p", "h1") or node._holds:
        return False
    named = class_names(node)
    if MORE.search(named) and node._size and node._links > 0.3 * node._size:
        return True
    return bool(NOISE.search(named)) and not (CONTENT.search(named) and 2 * node._size > page_size)


def _above(node: Node) -> Iterator[Node]:
    while node.parent is not None:
        node = node.parent
        yield node


def below(root: Node) -> list[Node]:
    """The elements of a tree in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in reversed(node.children) if not isinstance(c, str))
    return order


def clean(root: Node) -> list[Node]:
    """Take boilerplate out of the tree; the remaining elements in page order, measured."""
    measure(below(root))
    stack = [root]
    while stack:
        node = stack.pop()
        node.children = [c for c in node.children if isinstance(c, str) or not dropped(c, root._size)]
        stack.extend(c for c in node.children if not isinstance(c, str))
    measure(order := below(root))
    return order


def measure(order: list[Node]) -> None:
    """Text sizes of elements, of the links within them, and whether they hold a headline or an article."""
    for node in reversed(order):
        size = links = 0
        holds = node.name in ("h1", "main") or node.name == "article" and not (node.attrs and NOISE.search(class_names(node)))
        for c in node.children:
            if isinstance(c, str):
                size += len(c.strip())
            elif c.name not in DROPPED:
                size += c._size
                links += c._links
                holds |= c._holds
        node._size, node._links, node._holds = size, size if node.name == "a" else links, holds


def inner_text(node: Node) -> str:
    parts, stack = [], list(reversed(node.children))
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            parts.append(c)
        else:
            stack.extend(reversed(c.children))
    return SPACE.sub(" ", " ".join(parts)).strip()


def own_text(node: Node) -> str:
    """Text of an element outside the blocks within it."""
    parts, stack = [], list(reversed(node.children))
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            parts.append(c)
        elif c.name not in BLOCK:
            stack.extend(reversed(c.children))
    return "".join(parts).strip()


def best_container(order: list[Node]) -> Node:
    """The element with the most points after the discount for links."""
    scored: dict[int, Node] = {}
    for node in order:
        if node.name not in PARAGRAPH and node.name not in ("div", "section", "article"):
            continue
        text = own_text(node)
        if not text:
            continue
        points = 1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)
        for share, above in zip((1.0, 0.5, 0.25), _above(node), strict=False):
            above.points += points * share
            scored[id(above)] = above
        if node.name in ("div", "section", "article"):
            node.points += points
            scored[id(node)] = node
    if not scored:
        return order[0]
    weight = {"article": 1.5, "main": 1.3}

    def value(node: Node) -> float:
        density = node._links / node._size if node._size else 0.0
        named = CONTENT.search(" ".join((node.names().get("class", ""), node.names().get("id", ""))))
        return node.points * (1 - density) * weight.get(node.name, 1.0) * (1.25 if named else 1.0)

    place = {id(n): k for k, n in enumerate(order)}
    best = max(scored.values(), key=lambda n: (value(n), -place[id(n)]))
    articles = [a for a in (best, *_above(best)) if a.name in ("article", "main")]
    return articles[0] if articles else best


def kept_roots(best: Node) -> list[Node]:
    """The container and those siblings that read like more of it."""
    if best.parent is None or best.name in ("body", "html", "#root"):
        return [best]
    least = max(10.0, best.points * 0.2)
    named = class_names(best).strip()
    out = []
    for c in best.parent.children:
        if c is best:
            out.append(c)
        elif not isinstance(c, str) and c._size:
            density = c._links / c._size
            like = c.points * (1 - density) >= least and c.name == best.name
            text = inner_text(c) if c.name in ("p", "div", "section") and density < 0.25 else ""
            says = bool(SENTENCE.search(text))
            prose = c.name == "p" and (len(text) > 80 or density == 0 and says)
            # a lead, or a further part of the same make, however short
            kin = c.name == best.name and class_names(c).strip() == named and (named or c.name == "section")
            part = says and (kin or bool(LEAD.search(class_names(c))))
            if like or prose or part or c.name in ("h1", "h2", "h3") and density < 0.5:
                out.append(c)
    return out


def blocks(roots: list[Node]) -> Iterator[str]:
    """Texts of the blocks in page order, white space turned into single spaces."""
    parts: list[str] = []

    def flush() -> Iterator[str]:
        text = SPACE.sub(" ", "".join(parts)).strip()
        parts.clear()
        if text:
            yield text

    for root in roots:
        stack: list[Node | str | None] = [None, root]  # None ends a block
        while stack:
            c = stack.pop()
            if c is None:
                yield from flush()
            elif isinstance(c, str):
                parts.append(c)
            elif c.name == "br":
                parts.append(" ")
            elif c.name in BLOCK:
                yield from flush()
                stack.append(None)
                stack.extend(reversed(c.children))
            else:
                stack.extend(reversed(c.children))
        yield from flush()


def main_text(html: str | None) -> str:
    """The article of a page; empty for null, empty or textless pages."""
    if not html:
        return ""
    order = clean(parse(html))
    return "\n\n".join(blocks(kept_roots(best_container(order))))


def extract_pages(pages: DataFrame) -> DataFrame:
    """Per page row: page_id, url, text.

    pages (page_id, url, html).  A null html counts as empty, and its text is empty; repeated rows give
    equal texts; other columns are ignored; an empty table gives an empty result.  A page of any length
    is read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html", 1 << 22):
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id bigint, url string, text string")
