"""Main-text extraction by minimum-cut labelling of a page's text blocks.

A page is read as a run of blocks (stretches of text between block-level tags), each
with its open elements. A classifier's score for a block, from its elements, their
class and id words, its links and its length, is the capacity to one terminal:
content or boilerplate. Neighbouring blocks, and blocks in one element, are tied by
smoothness edges. The cut of least cost labels all blocks together; those whose score
outweighs all their edges are settled beforehand (which changes no least cut), the
rest by maximum flow.

Defined results: null or empty html, or a page without content, gives ""; unclosed
and truncated markup is read as far as it goes; an unclosed script, style or comment
runs to the end; rows are independent, so ties and repeats are simply repeated; pages
of any length are read whole; other columns pass through, and one named like the result
is replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read

# Element names and the words in class, id and role that speak for or
# against content.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template svg math textarea select object iframe"
DROPPED = frozenset("head title button select textarea option label legend input".split())
OUTSIDE = frozenset("nav header footer aside form menu dialog fieldset".split())
INSIDE = frozenset("article main".split())
AGAINST = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright disqus dialog feedback foot footer form gdpr header hidden legal login masthead menu menus modal nav navbar navigation newsletter notice notices overlay pager pagination paywall popup privacy promo promoted promotion promotions recommend recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription tags toolbar topbar widget widgets".split()
)
FOR = frozenset("article articlebody body content entry main maincontent post story text".split())
#: Closing rules: an opening tag ends an open element of these kinds first.
ENDS = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
P_ENDERS = BLOCKS - {"body", "html", "head", "title", "button", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend"}
BESIDE, TOGETHER = 0.7, 0.5

_TOKEN = re.compile(
    r"<!--[\s\S]*?(?:-->|\Z)"
    r"|<(" + RAW.replace(" ", "|") + r")\b(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>[\s\S]*?(?:</\1\b[^>]*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_UNSEEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?false)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Element:
    __slots__ = ("name", "parent", "score", "last")

    def __init__(self, name: str, parent: Element | None, attributes: str):
        self.name, self.parent = name, parent
        self.last = -1  # the last block in it
        here = 0.0
        if name in OUTSIDE:
            # a heading part of an article is weaker evidence than the page's own
            here -= 2.5 if name == "header" and parent is not None and parent.within(INSIDE) else 8.0
        elif name in INSIDE:
            here += 3.0
        if attributes:
            if _UNSEEN.search(attributes):
                here -= 9.0
            names = {w.lower() for m in _NAMES.findall(attributes) for w in _WORDS.findall("".join(m))}
            if names & AGAINST and name not in ("body", "html"):
                here -= 8.0
            elif names & FOR:
                here += 2.0
        above = parent.score if parent is not None else 0.0
        # what is boilerplate stays so inside; an article in it only weakens that
        self.score = above + here if here < 0 or above > -6 else above + min(here, 1.0)

    def within(self, names: frozenset[str]) -> bool:
        e: Element | None = self
        while e is not None:
            if e.name in names:
                return True
            e = e.parent
        return False


class Block:
    __slots__ = ("element", "text", "linked", "letters")

    def __init__(self, element: Element, text: str, linked: float, letters: int):
        self.element, self.text, self.linked, self.letters = element, text, linked, letters


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, each white space run one space."""
    root = Element("html", None, "")
    stack, out = [root], []
    parts: list[str] = []
    link, in_links = 0, 0
    owner = root

    def flush() -> None:
        nonlocal in_links, parts
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text and not owner.within(DROPPED):
                out.append(Block(owner, text, min(1.0, in_links / len(text)), len(text)))
            parts = []
        in_links = 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            raw = page[at : m.start()]
            if not parts:
                owner = stack[-1]
            parts.append(raw)
            if link:
                in_links += len(raw.strip())
        at = m.end()
        closing, name, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not name:
            if m[1] and m[1].lower() in ("textarea", "select", "iframe", "object"):
                flush()
            continue
        name = name.lower()
        if name == "br":
            parts and parts.append(" ")
            continue
        block = name in BLOCKS
        if block:
            flush()
        if closing:
            if name == "a":
                link = max(0, link - 1)
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
                if block is False and stack[k].name in BLOCKS:
                    break  # an inline end tag does not end blocks
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        if name == "a":
            link += 1
        if not block:
            continue
        link = 0
        ends = ENDS.get(name, ())
        if name in P_ENDERS and stack[-1].name == "p":
            stack.pop()
        while len(stack) > 1 and stack[-1].name in ends:
            stack.pop()
        stack.append(Element(name, stack[-1], attributes))
    if at < len(page):
        if not parts:
            owner = stack[-1]
        parts.append(page[at:])
    flush()
    return out


def score(b: Block) -> float:
    """Evidence for content, against boilerplate where negative."""
    z = b.element.score - 0.6
    words = b.text.count(" ") + 1
    z += min(2.0, 0.55 * math.log1p(words)) - 0.4
    name = b.element.name
    if name in ("p", "pre", "blockquote"):
        z += 0.8
    elif name in ("h1", "h2", "h3") and b.element.score > 0:
        z += 1.2
    if b.text[-1] in ".!?:;\"”»…":
        z += 0.4
    if b.linked > 0.5:
        z -= 2.5 * b.linked
    if "©" in b.text and words < 40:
        z -= 3.0
    return z


def labelled(found: list[Block]) -> list[bool]:
    """Which blocks are content: the least cut between the terminals."""
    n = len(found)
    z = [score(b) for b in found]
    edges: list[dict[int, float]] = [{} for _ in range(n)]

    def tie(i: int, j: int, w: float) -> None:
        edges[i][j] = edges[i].get(j, 0.0) + w
        edges[j][i] = edges[j].get(i, 0.0) + w

    for i, b in enumerate(found):
        e = b.element
        if i:
            tie(i - 1, i, BESIDE if found[i - 1].element.parent is e.parent or found[i - 1].element is e else BESIDE / 4)
        box = e.parent or e
        if 0 <= box.last < i - 1:
            tie(box.last, i, TOGETHER)
        box.last = i
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:  # blocks that outweigh their edges; each one settled shifts its neighbours
        i = queue.popleft()
        if label[i] is None and abs(z[i]) > sum(edges[i].values()):
            label[i] = z[i] > 0
            for j, w in edges[i].items():
                z[j] += w if label[i] else -w
                del edges[j][i]
                queue.append(j)
    left = [i for i in range(n) if label[i] is None]
    if left:
        reach = _source_side(left, z, edges)
        for i in left:
            label[i] = i in reach
    return [bool(x) for x in label]


def _source_side(nodes: list[int], z: list[float], edges: list[dict[int, float]]) -> set[int]:
    """The nodes on the source's side of a least cut, by shortest augmenting paths."""
    rest = {i: dict(edges[i]) for i in nodes}
    source, sink = {i: max(0.0, z[i]) for i in nodes}, {i: max(0.0, -z[i]) for i in nodes}
    while True:
        came: dict[int, int] = {i: -1 for i in nodes if source[i] > 1e-12}
        queue, end = deque(came), -1
        while queue and end < 0:
            i = queue.popleft()
            if sink[i] > 1e-12:
                end = i
                break
            for j, w in rest[i].items():
                if w > 1e-12 and j not in came:
                    came[j] = i
                    queue.append(j)
        if end < 0:
            return set(came)
        path = [end]
        while came[path[-1]] >= 0:
            path.append(came[path[-1]])
        path.reverse()
        flow = min([source[path[0]], sink[end], *(rest[a][b] for a, b in zip(path, path[1:]))])
        source[path[0]] -= flow
        sink[end] -= flow
        for a, b in zip(path, path[1:]):
            rest[a][b] -= flow
            rest[b][a] += flow


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return " ".join(b.text for b, content in zip(found, labelled(found)) if content)


def extract(df: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """df without its html column, with the main text."""
    schema = df.drop(html).withColumn(text, F.lit("")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rest = [c for c in b.schema.names if c not in (html, text)]
            made = pa.array([main_text(p) for p in b.column(html).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), made], [*rest, text])

    order = [f for f in schema if f.name != text] + [schema[text]]
    return df.mapInArrow(work, type(schema)(order))


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).withColumn("n_chars", F.char_length("text").cast("long"))


SQL: dict[str, str] = {}
QUERIES = {"op5_html_extraction": op5_html_extraction}
