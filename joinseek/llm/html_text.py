"""Main text of HTML pages by scoring a tree of blocks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinseek.session import quoted

#: Elements of HTML that begin and end a block of text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements without an end tag.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup, or is never shown as text.
RAW_TAGS = frozenset("script style textarea title noscript noembed noframes iframe xmp template svg math object select".split())
#: Elements that are never part of an article.
OUTSIDE_TAGS = frozenset("nav footer aside form menu dialog button fieldset head".split())
#: Words in a class, id or role that mark what is not part of an article.
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist "
    "complementary consent contentinfo cookie cookies discussion disqus footer gdpr masthead menu modal nav navbar navigation newsletter "
    "notice notification overlay pagination pager popup privacy promo promoted promotion recommended related replies reply respond "
    "search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar warning widget widgets".split()
)
#: A name that holds one of these says what its element has, not what it is.
MODIFIER_WORDS = frozenset("has no with without".split())
#: Words that say nothing about what an element is.
NEUTRAL_WORDS = frozenset("area block body box container content inner items list main outer section wrap wrapper".split())
#: Degrees to which an element may be outside. One that is doubted goes unless it turns out to hold the article.
INSIDE, WRAPPER, NAMED, NEVER = range(4)
#: Start tags that end an open element of the same kind.
CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
#: An open element of this kind keeps the ones above it open.
BORDERS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}

#: Where markup may begin; and a tag, whose quoted values may hold any character.
MARKUP = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)>")
#: The same without regard to quotes, once some quote was left open to the end of a page.
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
#: Raw elements of foreign markup, which a final slash closes at once; no slash closes the others.
FOREIGN_TAGS = frozenset(("svg", "math"))
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.IGNORECASE)
SPLIT_NAME = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


@dataclass(frozen=True)
class ExtractParams:
    """A paragraph of ``min_chars`` scores a point, one per comma and one per 100 characters up to ``max_points``.

    Its parent gets the points, each further ancestor ``decay`` of the one below,
    for ``levels`` levels.
    """

    min_chars: int = 25
    max_points: float = 3.0
    decay: float = 0.5
    levels: int = 4
    sibling_share: float = 0.2
    max_link_density: float = 0.5


@dataclass
class _Node:
    tag: str
    parent: int
    outside: bool
    home: int = 0  # the nearest block, itself included
    doubt: int = 0
    named: bool = False
    unlinked: int = 0
    holds_article: bool = False
    score: float = 0.0
    chars: int = 0
    linked: int = 0
    links: int = 0


def _name_doubt(value: str) -> int:
    """How far the names in a class, id or role mark what is not part of an article."""
    doubt = INSIDE
    for name in value.split():
        found = {word.lower() for word in SPLIT_NAME.split(name) if word}
        if found & OUTSIDE_WORDS and not found & MODIFIER_WORDS:
            doubt = max(doubt, NAMED if found <= OUTSIDE_WORDS | NEUTRAL_WORDS else WRAPPER)
    return doubt


def _doubt(tag: str, attributes: str, in_article: bool) -> int:
    """NEVER for what is no part of an article whatever it holds.

    WRAPPER for forms and elements of which one word of a name says so, NAMED for
    elements whose whole name does.
    """
    if tag not in ("form", "fieldset") and tag in OUTSIDE_TAGS or (tag == "header" and not in_article):
        return NEVER
    doubt = WRAPPER if tag in ("form", "fieldset") else INSIDE
    if not attributes or tag in ("html", "body", "article", "main"):
        return doubt
    for attribute, quoted_twice, quoted_once, bare in ATTRIBUTE.findall(attributes):
        attribute, value = attribute.lower(), quoted_twice or quoted_once or bare
        if attribute == "hidden" and value.lower() not in ("false", "until-found"):
            return NEVER
        if attribute == "aria-hidden" and value.lower() == "true":
            return NEVER
        if attribute == "style" and NO_DISPLAY.search(value):
            return NEVER
        if attribute in ("class", "id", "role"):
            if "hidden" in value.lower().split():
                return NEVER
            doubt = max(doubt, _name_doubt(value))
    return doubt


def _settle(nodes: list[_Node], blocks: list[tuple[int, str, int, int]], params: ExtractParams) -> None:
    """Decide which doubted elements are outside.

    An element with a doubtful name, or a form, stays if it holds an article or
    most of the page's unlinked text. One whose whole name marks it stays only if
    the page has no article or paragraph beside such elements.
    """
    if not any(n.doubt in (WRAPPER, NAMED) for n in nodes):
        return
    for node in nodes[1:]:
        node.outside = node.doubt == NEVER or nodes[node.parent].outside
    total = 0
    filled = [False] * len(nodes)  # holds text
    for owner, text, linked, _ in blocks:
        if not nodes[owner].outside:
            total += len(text) - linked
            nodes[owner].unlinked += len(text) - linked
            filled[owner] = True
    under_article = [nodes[0].tag in ("article", "main")] * len(nodes)
    for k in range(1, len(nodes)):
        under_article[k] = under_article[nodes[k].parent] or nodes[k].tag in ("article", "main")
    for k in range(len(nodes) - 1, 0, -1):  # children come after their parents
        node, above = nodes[k], nodes[nodes[k].parent]
        above.unlinked += node.unlinked
        filled[node.parent] |= filled[k]
        # An article's text: a teaser without text holds no article.
        above.holds_article |= node.holds_article or (filled[k] and node.tag in ("article", "main") and not node.named)

    def spread(spare: int) -> None:
        """Mark what is outside if elements up to the degree ``spare`` may stay."""
        marked = [False] * len(nodes)  # below an article or main that stays
        in_article = [False] * len(nodes)
        for k, node in enumerate(nodes):
            if k == 0:
                continue
            up = node.parent
            node.outside = nodes[up].outside or node.doubt == NEVER
            if not node.outside and node.doubt:
                holds = node.holds_article and not in_article[up]
                most = 2 * node.unlinked > total and (marked[up] or not beside)
                node.outside = node.doubt > spare or not (holds or most)
            marked[k] = marked[up] or node.tag in ("article", "main")
            in_article[k] = in_article[up] or node.tag == "article"

    def stands() -> tuple[bool, bool]:
        """Whether an article or main with text stays, and whether any paragraph does."""
        article = paragraph = False
        for owner, text, linked, _ in blocks:
            if not nodes[owner].outside:
                paragraph |= len(text) >= params.min_chars and 2 * linked < len(text)
                article |= under_article[owner]
        return article, paragraph

    beside = True
    spread(INSIDE)
    beside, _ = stands()
    spread(WRAPPER)
    article, paragraph = stands()
    if not article and not paragraph:
        beside = False
        spread(NAMED)
    elif not article and any(n.doubt == NAMED and n.holds_article for n in nodes):
        beside = True
        spread(NAMED)


def parse(html: str) -> tuple[list[_Node], list[tuple[int, str, int, int]]]:
    """Nodes in page order and blocks (node, text, linked characters, links).

    Missing end tags are supplied: a new block ends an open paragraph, list items
    and cells end their like, and an end tag closes what is open inside it.
    """
    nodes = [_Node("html", -1, False)]
    blocks: list[tuple[int, str, int, int]] = []
    stack = [0]
    open_tags: Counter[str] = Counter()
    pieces: list[str] = []
    in_link, linked, links, articles = 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked, links
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                blocks.append((nodes[stack[-1]].home, text, min(linked, len(text)), links))
        linked = links = 0

    def close(depth: int) -> None:
        nonlocal in_link, articles
        while len(stack) > depth:
            node = nodes[stack.pop()]
            open_tags[node.tag] -= 1
            in_link -= node.tag == "a"
            articles -= node.tag in ("article", "main")

    def add_text(piece: str) -> None:
        nonlocal linked
        pieces.append(piece)
        if in_link:
            linked += len(piece.strip())

    at = 0
    match = TAG.match
    while True:
        start = MARKUP.search(html, at)
        if not start:
            break
        if html.startswith(("<!", "<?"), start.start()):
            comment = html.startswith("<!--", start.start())
            end = html.find("-->" if comment else ">", start.end())
            if start.start() > at:
                add_text(html[at : start.start()])
            if end < 0 and not comment:
                at = start.start()
                break
            at = len(html) if end < 0 else end + (3 if comment else 1)
            continue
        token = match(html, start.start())
        if not token and match is not PLAIN_TAG.match:
            match = PLAIN_TAG.match
            token = match(html, start.start())
        if not token:
            break  # no tag ends any more
        if token.start() > at:
            add_text(html[at : token.start()])
        at = token.end()
        tag = token.group(2)
        tag = tag.lower()
        if token.group(1):
            if tag in BLOCK_TAGS:
                flush()
            elif tag == "br":
                pieces.append(" ")
            for depth in range(len(stack) - 1, 0, -1) if open_tags[tag] else ():
                open_tag = nodes[stack[depth]].tag
                if open_tag == tag:
                    close(depth)
                    break
                if open_tag in BLOCK_TAGS and tag not in BLOCK_TAGS:
                    break
            continue
        attributes = token.group(3)
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in RAW_TAGS:
            if tag not in FOREIGN_TAGS or not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(html, at)
                at = end.end() if end else len(html)
            continue
        if tag in BLOCK_TAGS:
            flush()
            for depth in range(len(stack) - 1, 0, -1) if open_tags["p"] else ():
                open_tag = nodes[stack[depth]].tag
                if open_tag == "p":
                    close(depth)
                    break
                if open_tag in BLOCK_TAGS:
                    break
            if tag in CLOSES and any(open_tags[t] for t in CLOSES[tag]):
                for depth in range(len(stack) - 1, 0, -1):
                    open_tag = nodes[stack[depth]].tag
                    if open_tag in BORDERS[tag]:
                        break
                    if open_tag in CLOSES[tag]:
                        close(depth)
                        if tag != "tr" or open_tag == "tr":
                            break
        if tag in VOID_TAGS:
            continue
        if attributes.endswith("/") and tag not in BLOCK_TAGS:
            continue
        if tag == "a":
            links += 1
        parent = stack[-1]
        doubt = _doubt(tag, attributes, articles > 0)
        home = len(nodes) if tag in BLOCK_TAGS else nodes[parent].home
        nodes.append(_Node(tag, parent, nodes[parent].outside or doubt == NEVER, home, doubt))
        if tag in ("article", "main") and attributes:
            named = (x or y or z for name, x, y, z in ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id"))
            nodes[-1].named = any(_name_doubt(value) for value in named)
        stack.append(len(nodes) - 1)
        open_tags[tag] += 1
        in_link += tag == "a"
        articles += tag in ("article", "main")
    if at < len(html):
        add_text(html[at:])
    flush()
    return nodes, blocks


def main_text(html: str, params: ExtractParams | None = None) -> str:
    """The blocks of the best container and its siblings, one per line; empty if none."""
    params = params or ExtractParams()
    nodes, blocks = parse(html)
    _settle(nodes, blocks, params)
    for owner, text, linked, links in blocks:
        if nodes[owner].outside:
            continue
        nodes[owner].chars += len(text)
        nodes[owner].linked += linked
        nodes[owner].links += links
        if len(text) >= params.min_chars:
            density = linked / len(text)
            points = 1 + text.count(",") + min(len(text) / 100, params.max_points)
            points *= 1 - density
            up = nodes[owner].parent if nodes[owner].tag not in ("body", "html", "article", "main", "section", "div", "td") else owner
            for _ in range(params.levels):
                if up < 0:
                    break
                nodes[up].score += points
                points *= params.decay
                up = nodes[up].parent

    for node in reversed(nodes[1:]):  # children come after their parents
        above = nodes[node.parent]
        above.chars += node.chars
        above.linked += node.linked
        above.links += node.links

    def total(k: int) -> float:
        node = nodes[k]
        return node.score * (1 - node.linked / node.chars) if node.chars else 0.0

    live = [k for k, n in enumerate(nodes) if not n.outside and n.chars]
    if not live:
        return ""
    scored = [k for k in live if nodes[k].score > 0]
    best = max(scored, key=lambda k: (total(k), -k)) if scored else None
    marked = [k for k in live if nodes[k].tag in ("article", "main")]
    if best is None:
        best = max(marked or live, key=lambda k: (nodes[k].chars - nodes[k].linked, -k))
    # A container that its page calls the article is taken as a whole.
    up = best
    while up >= 0:
        if nodes[up].tag in ("article", "main"):
            best = up
            if nodes[up].tag == "article":
                break
        up = nodes[up].parent
    chosen = {best}
    need = max(10.0, params.sibling_share * total(best))
    for k in live:
        if nodes[k].parent != nodes[best].parent or k == best or nodes[best].parent < 0:
            continue
        node = nodes[k]
        density = node.linked / node.chars
        long_paragraph = node.tag == "p" and node.chars >= 80 and density < 0.25
        if nodes[best].tag not in ("article", "main") and (total(k) >= need or long_paragraph) or (
            node.tag == "article" and total(k) >= need
        ):
            chosen.add(k)

    whole = nodes[best].tag in ("article", "main")

    # What a page calls its article keeps its lists of links.
    inside = [False] * len(nodes)
    for k, node in enumerate(nodes):
        heavy = not whole and node.tag in ("ul", "ol", "div", "section", "table") and node.links >= 3
        heavy = heavy and node.linked > params.max_link_density * node.chars
        inside[k] = k in chosen or (k > 0 and not heavy and inside[node.parent])
    return "\n".join(text for owner, text, _, _ in blocks if not nodes[owner].outside and inside[owner])


def extract(pages: DataFrame, params: ExtractParams | None = None, html: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the main text in ``into`` and without ``html``.

    A null or empty page has an empty text. Rows stay as they are otherwise; a
    column already called ``into`` is replaced. The time for a page grows with its
    length, however deeply its elements are nested and whatever is left open.
    """
    params = params or ExtractParams()
    rest = [c for c in pages.columns if c not in (html, into)]
    slim = pages.select(*(F.col(quoted(c)) for c in rest), F.coalesce(F.col(quoted(html)), F.lit("")).alias("__html"))
    schema = slim.select(*(F.col(quoted(c)) for c in rest)).withColumn(into, F.lit("")).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(page.as_py(), params) for page in batch.column(len(rest))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], texts], names=[*rest, into])

    return slim.mapInArrow(read, schema)
