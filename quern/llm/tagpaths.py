"""Main text of web pages by tag-path ratios.

Text nodes are gathered by their root-to-leaf path of block tags. A path's text length and punctuation per node, less
what is in links, are fused into one score, smoothed over neighbouring nodes in page order, and paths above a share of
the page's length-weighted mean are content. The element that holds the content then brings its own headings and short
blocks with it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import in_batches, table

TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|</?([a-zA-Z][^\s/>]*+)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math canvas object audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags that end an open element of the second set, up to the nearest of the third.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
#: A <p> ends at these.
BLOCK = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
OUTSIDE = frozenset("head nav footer aside form button select fieldset dialog menu figcaption".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion cookie cookies consent notice notices gdpr popup modal overlay"
    " sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead share sharing social related recommended recommendations newsletter subscribe subscription"
    " signup login comment comments commentlist disqus respond reply replies discussion pagination pager toolbar widget search skip alert disclaimer".split()
)
CONTENT_WORDS = frozenset("article content post entry story main body text".split())
PUNCTUATION = re.compile(r"[.,;:!?。，！？؟،…]")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
KEEP_SHARE = 0.3


class Node:
    """An open element: path, whether its text is outside the article, and whether it is in an article or main.

    `vetoes` are the elements from here up whose class or id has a word of `OUTSIDE_WORDS`; `lifted` decides on them.
    `named` is -1 if such a word is a whole name, and 1 more if a word of `CONTENT_WORDS` is one.
    """

    __slots__ = ("tag", "path", "outside", "header", "article", "link", "key", "vetoes", "named")

    def __init__(self, tag: str, up: Node | None, attributes: str, key: int):
        self.tag, self.key = tag, key
        self.outside = bool(up and up.outside)
        self.header = bool(up and up.header)
        self.article = bool(up and up.article) or tag in ("article", "main")
        self.link = bool(up and up.link) or tag == "a"
        name = tag
        words: set[str] = set()
        names: set[str] = set()
        if attributes:
            for k, v in ATTRIBUTE.findall(attributes):
                k, v = k.lower(), v.strip("\"'")
                if k == "hidden" or (k == "aria-hidden" and v.lower() == "true") or (k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v, re.I)):
                    self.outside = True
                elif k == "role":
                    self.outside |= v.lower() in OUTSIDE_ROLES
                    self.article |= v.lower() in ("main", "article")
                elif k in ("class", "id"):
                    words.update(w.lower() for w in WORDS.findall(v))
                    names.update(v.lower().split())
                    name += "." + re.sub(r"\d+", "", v)
        if tag in OUTSIDE and not (tag == "figcaption" and self.article):
            self.outside = True
        self.vetoes: tuple[Node, ...] = up.vetoes if up else ()
        self.named = bool(names & CONTENT_WORDS) - bool(names & OUTSIDE_WORDS)
        if words & OUTSIDE_WORDS and tag not in ("html", "body", "article", "main"):
            self.vetoes += (self,)
        if tag == "header" or (words & {"header", "head"} and tag not in ("html", "body", "article", "main", *HEADING)):
            self.header = True
        self.path = (up.path if up else ()) if tag in INLINE else ((up.path if up else ()) + (name,))


def blocks(page: str) -> list[tuple[str, Node, list[Node], int]]:
    """(text, node, open elements, characters in links) of every block of text, in page order."""
    out: list[tuple[str, Node, list[Node], int]] = []
    stack: list[Node] = []
    parts: list[str] = []
    linked = 0
    home: tuple[Node, list[Node]] | None = None
    root = Node("#", None, "", 0)
    keys = 0

    def flush() -> None:
        nonlocal linked, home
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                node, opened = home  # type: ignore[misc]
                out.append((text, node, opened, linked))
            parts.clear()
        linked, home = 0, None

    def text(raw: str) -> None:
        nonlocal linked, home
        if not raw:
            return
        s = html.unescape(raw) if "&" in raw else raw
        top = stack[-1] if stack else root
        if s.strip():
            if home is None:
                block = next((n for n in reversed(stack) if n.tag not in INLINE), root)
                home = (block, [n for n in stack if n.tag not in INLINE])
            if top.link:
                linked += len(s)
            # inline elements that are outside the article (adverts in a span, hidden text) drop out of the block
            if top.outside and not home[0].outside or len(top.vetoes) > len(home[0].vetoes):
                return
        parts.append(s)

    at = 0
    size = len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = m[1] or m[3]
        if not tag:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:-3])
            continue
        tag = tag.lower()
        if m[0][1] == "/":
            if tag == "br":
                parts.append(" ")
                continue
            if tag not in INLINE:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    # an inline end tag does not reach out of its block
                    if tag not in INLINE or all(n.tag in INLINE for n in stack[i + 1 :]):
                        del stack[i:]
                    break
            continue
        attributes = m[2] or m[4] or ""
        if tag in RAW:
            if not attributes.endswith("/") or tag in ("script", "style", "textarea", "title"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else size
            parts.append(" ")
            continue
        if tag in INLINE:
            keys += 1
            stack.append(Node(tag, stack[-1] if stack else root, attributes, keys))
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in ("img", "input", "link", "meta", "source", "track", "param", "area", "base", "col", "embed"):
            continue
        flush()
        if tag in BLOCK:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag not in INLINE:
                    break
        if tag in ENDS:
            ended, scope = ENDS[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in scope:
                    break
                if stack[i].tag in ended:
                    del stack[i:]
                    break
        if tag not in VOID:
            if tag in ("html", "body") and any(n.tag == tag for n in stack):
                continue
            keys += 1
            stack.append(Node(tag, stack[-1] if stack else root, attributes, keys))
    flush()
    return out


def path_scores(found: list[tuple[str, Node, list[Node], int]]) -> dict[tuple, float]:
    """Score of each path: fused ratios, smoothed over the nodes in page order and averaged by path."""
    count: dict[tuple, int] = {}
    length: dict[tuple, float] = {}
    marks: dict[tuple, int] = {}
    links: dict[tuple, int] = {}
    for s, node, _, linked in found:
        p = node.path
        count[p] = count.get(p, 0) + 1
        length[p] = length.get(p, 0) + len(s)
        marks[p] = marks.get(p, 0) + len(PUNCTUATION.findall(s))
        links[p] = links.get(p, 0) + linked
    raw = {p: (length[p] / n) * (1 + marks[p] / n) * max(0.0, 1 - links[p] / length[p]) for p, n in count.items()}
    row = [raw[node.path] * (4 if node.article else 1) for _, node, _, _ in found]
    smooth = [0.25 * row[max(0, i - 1)] + 0.5 * x + 0.25 * row[min(len(row) - 1, i + 1)] for i, x in enumerate(row)]
    total: dict[tuple, float] = {}
    for (_, node, _, _), x in zip(found, smooth):
        total[node.path] = total.get(node.path, 0) + x
    return {p: total[p] / n for p, n in count.items()}


def lifted(found: list[tuple[str, Node, list[Node], int]]) -> set[int]:
    """Keys of the vetoed elements that hold the page's text all the same: by the name of a content element and a third of the
    text, or, if not named as one that is outside, by over half of it with an article or with little text elsewhere."""
    text: dict[int, int] = {}
    articles: set[int] = set()
    nodes: dict[int, Node] = {}
    total = 0
    for s, node, opened, linked in found:
        own = max(0, len(s) - linked)
        total += own
        for n in node.vetoes:
            nodes[n.key] = n
            text[n.key] = text.get(n.key, 0) + own
            if any(x.tag in ("article", "main") and n in x.vetoes for x in opened):
                articles.add(n.key)
    return {k for k, n in nodes.items() if n.named > 0 and 3 * text[k] >= total or n.named == 0 and 2 * text[k] > total and (k in articles or 5 * text[k] >= 4 * total)}


def main_text(page: str | None) -> str:
    """The article's blocks, one per line; empty for a null or empty page or one without article text."""
    if not page:
        return ""
    every = blocks(page)
    free = [b for b in every if not b[1].outside]
    held_by = lifted(free)
    found = [b for b in free if all(n.key in held_by for n in b[1].vetoes) and (not b[1].header or b[1].article and b[1].tag in HEADING)]
    if not found:
        return ""
    score = path_scores(found)
    weight = sum(len(s) for s, *_ in found)
    mean = sum(len(s) * score[node.path] for s, node, *_ in found) / weight
    chosen = {p for p, x in score.items() if x >= KEEP_SHARE * mean}
    content = [b for b in found if b[1].path in chosen and (b[3] < 0.7 * len(b[0]) or b[1].article)]
    if not content:
        return ""
    # The element that holds most content: its article or main, else the deepest with four fifths of the text.
    held: dict[int, int] = {}
    nodes: dict[int, tuple[Node, int]] = {}
    for s, _, opened, _ in content:
        for depth, n in enumerate(opened):
            held[n.key] = held.get(n.key, 0) + len(s)
            nodes[n.key] = (n, depth)
    all_ = sum(len(s) for s, *_ in content)
    articles = [k for k, (n, _) in nodes.items() if n.tag in ("article", "main") and held[k] >= 0.5 * all_]
    if articles:
        holder = max(articles, key=lambda k: (held[k], nodes[k][1]))
    else:
        deep = [k for k, (n, _) in nodes.items() if held[k] >= 0.8 * all_ and n.tag not in ("p", *HEADING)]
        holder = max(deep, key=lambda k: nodes[k][1], default=0)
    def inside(opened: list[Node]) -> bool:
        return any(n.key == holder for n in opened)

    whole = bool(articles)
    kept = []
    for b in found:
        s, node, opened, linked = b
        if whole and not inside(opened):
            continue
        if node.path in chosen and (linked < 0.7 * len(s) or node.article) or (inside(opened) and linked < 0.5 * len(s)):
            kept.append(s)
    return "\n".join(kept)


def extract_pages(pages: DataFrame) -> DataFrame:
    """`pages` (page_id, url, html) with `text` in place of `html`, and its code points `n_chars`.

    A null or empty page gives an empty text; repeated rows give equal rows; broken markup is read as far as it goes; an
    empty table gives an empty result; other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p.as_py()) for p in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return in_batches(pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))).mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op1_tag_paths(spark, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
