"""Main text of HTML pages by tree scoring.

The page becomes a tree. Every paragraph gives points, for its length and its
commas, to its ancestors, less the further up they are; a container's points
are discounted by its link density. The best container is kept, with those of
its siblings that score well beside it; menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments are left out
before the points are given. What a class word leaves out comes back when less
than a fifth of the page's points would remain without it.

Cases: a null page is an empty one with empty text; a page cut off anywhere,
with tags unclosed or closed twice, is read to its end; a page without markup
is one paragraph; a quote that opens no attribute's value ends none; very long
and very deep pages take time in proportion to their length; of equal containers
the first in the page is kept; repeated rows each give a row; an empty table
gives none; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from codeloom.llm._tables import bound_batches, table

#: Elements that HTML never closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never the article's.
DROPPED = frozenset("script style noscript template head title nav header footer aside form button select option textarea label fieldset iframe object svg canvas audio video menu dialog math".split())
#: Elements inside a line; all others part blocks.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that hold raw text up to their own end tag.
RAW = frozenset("script style textarea title iframe noscript template".split())
#: An open element of the key ends when an element of the value starts.
BLOCK_IN_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME_END = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table div article section main body html td th blockquote".split())
#: Words of a class, id or role that mark what is not the article.
UNLIKELY = re.compile(
    r"(?<![a-z])(?:ads?|ad-?(?:box|slot|unit|space|wrap|container)|adverts?|advertisements?|advertising|adsense|banner|sponsor(?:ed)?|promo(?:tion)?s?|breadcrumbs?|comments?|commentlist|disqus|replies|reply|responses|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|menus?|menubar|nav|navbar|navigation|pager|pagination|sidebars?|side-?bar|widgets?|related|recommended|share|sharing|social|footer|foot|header|masthead|toolbar|skip|login|search|contentinfo|complementary|discussion|feedback|outbrain|taboola|shoutbox)(?![a-z])"
)
#: Those of them that may as well name an article's subject: what they leave out comes back when nearly all of the page's points are in it.
WEAK = re.compile(r"(?<![a-z])(?:alert|discussion|feedback|foot|notices?|promo(?:tion)?s?|related|replies|reply|responses|search|share|sharing|skip|social|subscription|widgets?)(?![a-z])")
#: Words of a class that tell a state or a layout of the element, not what it holds.
STATE = re.compile(r"(?:has|no|with|without|hide|show|layout)-.*|.*-(?:open|opened|closed|enabled|disabled)")
#: What these leave out comes back only around an article's own marks.
NEVER = re.compile(r"(?<![a-z])(?:comments?|commentlist|disqus|sidebars?|side-?bar|adverts?|ads?)(?![a-z])")
MARKS = frozenset(("h1", "article", "main"))
#: Words of a class that mark the opening of an article.
LEAD = re.compile(r"(?<![a-z])(?:lead|lede|intro|introduction|summary|standfirst|dek|deck|subtitle|abstract|excerpt)(?![a-z])")
#: The part of the page's points that a left-out element must hold to come back.
BACK_SHARE = 0.8
LIKELY = re.compile(r"(?<![a-z])(?:article|body|content|entry|main|post|story|text)(?![a-z])")
#: Never left out for their class: they hold the whole page.
WHOLE = frozenset(("html", "body", "article", "main"))
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: Points: a paragraph of at least so many characters gives any; it gives one, one a comma and one for each so many characters up to a limit.
LEAST_CHARS, CHARS_A_POINT, MOST_POINTS = 25, 100, 3
#: The part of a paragraph's points that each ancestor gets, nearest first.
SHARES = (1.0, 0.5, 1 / 3, 0.25)
#: A sibling is kept when it has this part of the best container's points, or when it reads like a paragraph.
SIBLING_SHARE, SIBLING_LINKS = 0.2, 0.25
#: What weak words left out comes back when the best container then has so many times the points.
WEAK_GAIN = 5
#: Elements that are paragraphs: their text counts for the element around them.
PARAGRAPHS = frozenset("p pre h1 h2 h3 h4 h5 h6 li td blockquote dd dt figcaption".split())


class Node:
    """An element: children are nodes and, as strings, text."""

    __slots__ = ("at", "chars", "children", "container", "kept", "lead", "left", "linked", "mass", "order", "parent", "points", "tag")

    def __init__(self, tag: str, parent: Node | None, order: int, at: int = 0, left: str = "", lead: bool = False):
        self.tag, self.parent, self.order = tag, parent, order
        #: Where it begins in the page, why its class would leave it out, and whether it opens the article.
        self.at, self.left, self.lead = at, left, lead
        self.children: list[Node | str] = []
        #: The nearest element around it that is no part of a line.
        self.container = None if parent is None else parent if parent.tag not in INLINE else parent.container
        #: Points, all points given inside, and the characters in it and those of them in links.
        self.points, self.mass, self.chars, self.linked, self.kept = 0.0, 0.0, 0, 0, False

    def score(self) -> float:
        return self.points * (1 - self.linked / self.chars) if self.chars else 0.0


class Open:
    """The open elements' tags, with how many there are of each."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.count: dict[str, int] = {}

    def push(self, tag: str) -> None:
        self.tags.append(tag)
        self.count[tag] = self.count.get(tag, 0) + 1

    def pop(self) -> str:
        tag = self.tags.pop()
        self.count[tag] -= 1
        return tag

    def __contains__(self, tag: str) -> bool:
        return self.count.get(tag, 0) > 0


def _unlikely(tag: str, attributes: str) -> tuple[str, bool]:
    """Why an element and all in it is left out (``always``, or for its class ``never``, ``strong`` or ``weak``; else empty), and whether it opens the article."""
    if tag in DROPPED:
        return "always", False
    if not attributes or tag in WHOLE:
        return "", False
    why, lead = "", False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id", "role", "itemprop", "data-role"):
            words = value.replace("_", "-")
            if name in ("class", "id"):
                lead = lead or LEAD.search(words) is not None
                words = " ".join(w for w in words.split() if not STATE.fullmatch(w))
            if UNLIKELY.search(words) and not (LIKELY.search(words) and name != "role" and not re.search(r"comment|sidebar|advert|(?<![a-z])ads?(?![a-z])", words)):
                if name == "role":
                    return "always", False
                own = "never" if NEVER.search(words) else "strong" if UNLIKELY.search(WEAK.sub("", words)) else "weak"
                why = max(why, own, key=("", "weak", "strong", "never").index)
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value):
            return "always", False
    return why, lead


def parse(page: str, keep: frozenset[str] = frozenset(), back: frozenset[int] = frozenset()) -> tuple[list[Node], set[str]]:
    """The elements of a page in order, the root first, without what is never the article's; and why classes left any out.

    ``keep`` names reasons that leave nothing out, ``back`` places in the page whose elements stay.
    """
    nodes, reasons = [Node("#root", None, 0)], set()
    at, here, end = 0, nodes[0], len(page)
    stack, known = [here], Open()
    skip = Open()  # open elements inside a left-out one, itself first
    while at < end:
        found = TOKEN.search(page, at)
        if found is None:
            if not skip.tags:
                here.children.append(page[at:])
            break
        if found.start() > at and not skip.tags:
            here.children.append(page[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            if skip.tags:
                if tag in skip:
                    while skip.pop() != tag:
                        pass
                elif tag in SCOPE and tag in known:  # the left-out element was never closed
                    skip = Open()
            if not skip.tags and tag in known:
                while known.pop() != tag:
                    stack.pop()
                stack.pop()
                here = stack[-1]
            continue
        attributes = found[3] or ""
        closed = tag in VOID
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>|</{tag}\Z", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if skip.tags:
            if not closed:
                skip.push(tag)
            continue
        if tag in BLOCK_IN_P or tag in SAME_END:
            ends = {"p"} if tag in BLOCK_IN_P else SAME_END[tag]
            if any(t in known for t in ends):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in ends:
                        for _ in range(len(stack) - i):
                            stack.pop()
                            known.pop()
                        break
                    if stack[i].tag in SCOPE:
                        break
            here = stack[-1]
        if closed:
            if tag in ("br", "hr"):
                if tag == "hr":
                    nodes.append(Node(tag, here, len(nodes)))
                here.children.append("\n" if tag == "br" else nodes[-1])
            continue
        why, lead = _unlikely(tag, attributes)
        if why not in ("", "always"):
            reasons.add(why)
        if why and why not in keep and found.start() not in back:
            skip.push(tag)
            continue
        node = Node(tag, here, len(nodes), found.start(), why, lead)
        nodes.append(node)
        here.children.append(node)
        stack.append(node)
        known.push(tag)
        here = node
    return nodes, reasons


def _blocks(top: Node) -> list[tuple[Node, str, int]]:
    """The blocks below an element in page order: their element, text, and characters of it in links."""
    out: list[tuple[Node, str, int]] = []
    parts: list[str] = []
    linked = 0

    def flush(owner: Node) -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((owner, text, min(linked, len(text))))
            parts.clear()
            linked = 0

    # Depth first without recursion, since pages nest without limit.
    work: list[tuple[Node, Iterator, Node, bool]] = [(top, iter(top.children), top, top.tag == "a")]
    while work:
        node, children, owner, in_link = work[-1]
        child = next(children, None)
        if child is None:
            work.pop()
            if node.tag not in INLINE:
                flush(owner)
        elif isinstance(child, str):
            parts.append(child)
            linked += len(child.strip()) if in_link else 0
        else:
            block = child.tag not in INLINE
            if block:
                flush(owner)
            work.append((child, iter(child.children), child if block else owner, in_link or child.tag == "a"))
    return out


def weigh(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> None:
    """Give every element its points and characters."""
    for owner, text, linked in blocks:
        owner.chars += len(text)
        owner.linked += linked
        if len(text) < LEAST_CHARS:
            continue
        points = (1 + text.count(",") + min(len(text) / CHARS_A_POINT, MOST_POINTS)) * (1 - linked / len(text))
        owner.mass += points
        # A text of its own in a container counts for the container itself.
        node = owner.container if owner.tag in PARAGRAPHS and owner.parent else owner
        for share in SHARES:
            if node is None:
                break
            node.points += points * share
            node = node.container
    # Elements come after those around them.
    for node in reversed(nodes[1:]):
        node.parent.chars += node.chars
        node.parent.linked += node.linked
        node.parent.mass += node.mass


def article(nodes: list[Node]) -> tuple[str, float]:
    """The article's text, its blocks in page order joined by one space, and the points of its best container."""
    blocks = _blocks(nodes[0])
    weigh(nodes, blocks)
    best = max((n for n in nodes if n.points), key=lambda n: (n.score(), -n.order), default=None)
    if best is None:
        return " ".join(text for _, text, _ in blocks), 0.0
    points = best.score()
    # An article or main element around the best container is the container.
    up = best
    while up is not None:
        if up.tag in ("article", "main"):
            best = up
            break
        up = up.parent
    best.kept, own = True, None
    marked = best.tag in ("article", "main")
    if best.parent is not None and best.tag not in ("body", "html", "#root"):
        inside = best.parent.tag not in ("body", "html", "#root")
        for other in best.parent.children:
            if isinstance(other, Node) and other is not best and other.chars:
                reads = (other.lead or other.tag in ("p", "pre", "blockquote", "h1", "h2", "h3", "ul", "ol")) and other.linked / other.chars < SIBLING_LINKS and (inside or not marked)
                # Beside an article only other articles and sections are taken for their points.
                alike = other.score() >= SIBLING_SHARE * best.score() and (not marked or other.tag in ("article", "main", "section"))
                if reads or alike:
                    other.kept = True
                    own = own if marked else best.parent
        # Sections further up belong to it when they score like its siblings.
        inner, outer = best.parent, None if marked else best.parent.parent
        while outer is not None and inner.tag not in ("body", "html", "#root"):
            for other in outer.children:
                if isinstance(other, Node) and other is not inner and other.tag in ("section", "div") and other.score() >= SIBLING_SHARE * best.score() and other.linked < SIBLING_LINKS * other.chars:
                    other.kept = True
            inner, outer = outer, outer.parent
    for node in nodes[1:]:
        node.kept = node.kept or node.parent.kept
    return " ".join(text for owner, text, linked in blocks if owner.kept or owner is own and linked < SIBLING_LINKS * len(text)), points


def wrappers(page: str, mass: float) -> frozenset[int]:
    """Where those elements begin that a class leaves out though nearly all of the page's points lie in them.

    ``mass`` is what remains without them. Words such as ``comments`` and
    ``sidebar`` bring nothing back but around a title or an article.
    """
    nodes, _ = parse(page, frozenset(("weak", "strong", "never")))
    weigh(nodes, _blocks(nodes[0]))
    whole = nodes[0].mass
    if not whole or mass >= (1 - BACK_SHARE) * whole:
        return frozenset()
    heads = {id(n) for n in nodes if n.tag in MARKS}
    for node in reversed(nodes[1:]):  # what holds a mark
        if id(node) in heads:
            heads.add(id(node.parent))
    return frozenset(n.at for n in nodes if n.left and n.mass >= BACK_SHARE * whole and (n.left != "never" or id(n) in heads))


def main_text(page: str) -> str:
    """The article's text."""
    nodes, reasons = parse(page)
    text, points = article(nodes)
    back = wrappers(page, nodes[0].mass) if reasons & {"strong", "never"} else frozenset()
    if back:
        nodes, reasons = parse(page, back=back)
        text, points = article(nodes)
    if "weak" in reasons:
        other, gained = article(parse(page, frozenset(("weak",)), back)[0])
        if gained > WEAK_GAIN * points:
            return other
    return text


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of (page_id, url, html)."""
    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page or "") for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extract the main text of every page."""
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
