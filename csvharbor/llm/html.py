"""Main text of web pages as a maximum-scoring run of words and tags.

Words score above zero and tags below, by weights counted on pages whose article is marked up as such; one linear scan
finds the run with the largest sum. Elements that never hold an article's text (menus, adverts, reader comments and the
like) are left out wherever they stand. A name that articles use for parts of their own too (``DOUBTFUL``) leaves an element
out beside an article; inside one it does so unless the element holds running text. A form that holds most of a page's
words is its frame.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from csvharbor.llm.ranks import drawn

SAMPLE_PAGES = 300
# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "math", "select", "option", "object", "canvas")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
SECTIONS = frozenset("nav footer aside form head script style noscript template iframe svg math title textarea select option button dialog menu object canvas".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
# Names of classes and ids that mark what stands beside an article.
BESIDE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar"
    " footer comment comments reply replies respond disqus cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription"
    " signup signin login share sharing social related recommended recommendations widget toolbar masthead copyright disclaimer legal skip pagination pager"
    " paywall teaser".split()
)
# Those of them that parts of an article may have as well.
DOUBTFUL = frozenset("share sharing social related recommended recommendations legal disclaimer copyright teaser skip respond reply subscription promotion".split())
# Classes and ids, as a whole, of articles that are none: a reader's comment, an advert, a pointer to another page.
NO_ARTICLE = re.compile(r"(?:user|reader|post|child|nested)?[-_]*(?:comments?|reply|replies|response)(?:[-_]*(?:item|body|content|entry|\d+))*|ads?|adverts?|advertisement|sponsored|promo|teaser|related")
COMMENTS = frozenset("comment comments replies disqus".split())
HEADERS = frozenset(("header", "masthead"))
# Tags that articles are made of; they are taken to be cheap until pages say otherwise.
CONTENT = INLINE | frozenset("p br h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre hr figure figcaption picture table caption thead tbody tfoot tr td th section".split())
LEFT_OUT = -0.2
INSIDE = -0.2
FRAMED = frozenset("p h1 h2 h3 article main section".split())
RUNNING_WORDS = 12
GAP_TAGS = 4
PRIOR = 5.0
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Weights:
    """Score of a word outside and inside a link, of tags by name, and names of classes and ids found beside articles only."""

    word: float = 1.0
    linked: float = 0.1
    tags: dict[str, float] = field(default_factory=dict)
    beside: frozenset[str] = frozenset()
    within: frozenset[str] = frozenset()

    def of(self, item: Item) -> float:
        """Words count unless they are left out; tags of what is left out cost nothing in an article and little elsewhere.

        Other tags cost little in an article as well, since it is known to go on.
        """
        if item.text is not None:
            return 0.0 if item.out else (self.linked if item.linked else self.word) * len(item.text.split())
        if item.out:
            return 0.0 if item.inside else LEFT_OUT
        cost = self.tags.get(item.name, _cost(item.name, 0, 0))
        return max(INSIDE, cost) if item.inside else cost


def _cost(name: str, within: int, beside: int) -> float:
    """From -0.1 for a tag that is always in an article to -8 for one that never is; ``PRIOR`` sightings are taken for granted."""
    share = (within + PRIOR * (0.97 if name in CONTENT else 0.5)) / (within + beside + PRIOR)
    return -(0.1 + 7.9 * (1 - share))


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """``(kind, name, rest)``: "text" with the raw text, or "open" and "close" with a tag's name and attributes."""
    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        lead = m[0]
        if lead[0] != "<" or lead == "<":
            yield "text", "", lead
            continue
        name = m[2] or m[5]
        if not name:
            continue
        name, closing = name.lower(), m[1] or m[4]
        yield ("close" if closing else "open"), name, m[3] or m[6] or ""
        if not closing and name in RAW[:4] and not lead.endswith("/>"):  # nothing inside is markup
            stop = re.compile(f"</{name}", re.I).search(page, at)
            at = stop.start() if stop else end


def marks(attributes: str) -> tuple[set[str], set[str], set[str]]:
    """Names in class and id, roles, and classes and ids as they are but for their case."""
    names, roles, whole = set(), set(), set()
    for m in ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            roles.add(value.strip().lower())
        else:
            names |= {x.lower() for x in NAME.findall(value)}
            whole |= set(value.lower().split())
    return names, roles, whole


@dataclass
class Item:
    """A tag (``text`` is None) or a run of text with the block it belongs to; ``out`` where it is left out, ``inside`` an article."""

    name: str
    text: str | None = None
    block: int = 0
    linked: bool = False
    out: bool = False
    inside: bool = False
    names: frozenset[str] = frozenset()


@dataclass
class _Open:
    """An element that is not closed yet: where its items begin, whether they are left out, and whether that is still to be seen."""

    name: str
    out: bool
    start: int
    comments: bool = False
    doubtful: bool = False
    form: bool = False
    article: bool = False


def _left_out(items: list[Item], start: int, end: int) -> None:
    for item in items[start:end]:
        item.out = True


def _words(items: list[Item], start: int, end: int) -> tuple[int, int]:
    """Words outside and inside links of what is not left out."""
    n = [0, 0]
    for item in items[start:end]:
        if item.text is not None and not item.out:
            n[item.linked] += len(item.text.split())
    return n[0], n[1]


def read(page: str, weights: Weights) -> list[Item]:
    """The page's tags and texts in order. Elements that are never closed end with what they stand in.

    An article opens whatever was left open before it, such as a menu without an end, but for reader comments; articles
    among these, and those whose own class or id says that they are comments or adverts, are left out.
    """
    items: list[Item] = []
    stack: list[_Open] = []
    forms: list[tuple[int, int]] = []
    block = links = articles = 0

    def close(upto: int) -> None:
        nonlocal links, articles
        for e in reversed(stack[upto:]):
            links -= e.name == "a"
            articles -= e.article
            if e.doubtful:
                plain, linked = _words(items, e.start, len(items))
                if plain < RUNNING_WORDS or plain <= linked:
                    e.out = True
                    _left_out(items, e.start, len(items))
            if e.form:
                forms.append((e.start, len(items)))
        del stack[upto:]

    for kind, name, rest in tokens(page):
        out = bool(stack) and stack[-1].out
        if kind == "text":
            items.append(Item("", entities.unescape(rest) if "&" in rest else rest, block, links > 0, out, articles > 0))
            continue
        if name not in INLINE:
            block += 1
        if kind == "close":
            place = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].name == name), -1)
            ended = stack[place] if place >= 0 else None
            if ended:
                close(place)
                out = ended.out
            items.append(Item(name, None, block, False, out, articles > 0))
            if ended and ended.form:
                forms[-1] = (ended.start, len(items))
            continue
        names: frozenset[str] = frozenset()
        comments = doubtful = form = False
        found, roles, whole = marks(rest) if "=" in rest and not out or name == "article" else (set(), set(), set())
        if name in ("article", "main"):
            out = any(e.comments for e in stack) or (name == "article" and any(NO_ARTICLE.fullmatch(x) for x in whole))
            while not out and stack and stack[-1].out:  # whatever was left open before it
                close(len(stack) - 1)
        elif not out:
            names = frozenset(found)
            beside = (found & BESIDE) - weights.within
            comments = bool(found & COMMENTS - weights.within)
            form = name == "form" and not articles and not any(e.form for e in stack)
            apart = (name in SECTIONS and not form) or roles & ROLES or found & weights.beside
            out = bool(apart or (beside and (not articles or beside - DOUBTFUL)) or (not articles and (name == "header" or found & HEADERS)))
            doubtful = bool(beside) and not out
        items.append(Item(name, None, block, False, out, articles > 0, names))
        if name not in VOID and not rest.endswith("/"):
            stack.append(_Open(name, out, len(items) - 1, comments, doubtful, form and not out, name in ("article", "main") and not out))
            links += name == "a"
            articles += stack[-1].article
    close(0)
    for start, end in forms:
        inside, every = sum(_words(items, start, end)), sum(_words(items, 0, len(items)))
        if 2 * inside <= every or not any(item.text is None and item.name in FRAMED for item in items[start:end]):
            _left_out(items, start, end)
    return items


def count(page: str) -> Counter | None:
    """How often each word kind, tag and name stands in the article and beside it; None for a page without a marked article."""
    if "<article" not in page.lower():
        return None
    seen: Counter = Counter()
    for item in read(page, Weights()):
        if item.text is not None:
            if not item.out:
                seen["linked" if item.linked else "word", item.inside] += len(item.text.split())
        else:
            if not item.out:
                seen[f"<{item.name}>", item.inside] += 1
            for name in item.names:
                seen[f".{name}", item.inside] += 1
    return seen


def weigh(counts: Counter) -> Weights:
    """Tags cost more the oftener they stand beside articles; words gain the more the oftener they stand in them.

    A class or id name counts as beside (or within) articles when it was seen there only, five times at least.
    """
    share = lambda key: (counts[key, True] + 1) / (counts[key, True] + counts[key, False] + 1)
    names = {key for key, _ in counts}
    tags = {key[1:-1]: _cost(key[1:-1], counts[key, True], counts[key, False]) for key in names if key[0] == "<"}
    only = lambda here: frozenset(k[1:] for k in names if k[0] == "." and counts[k, here] >= 5 and not counts[k, not here])
    return Weights(max(0.05, share("word")), max(0.05, share("linked") - 0.5), tags, only(False), only(True))


def train(pages: DataFrame, html: str = "html", key: str = "page_id", sample_pages: int = SAMPLE_PAGES) -> Weights:
    """Weights from at most ``sample_pages`` pages that mark their article, chosen by a hash of key and page."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for page in batch.column(0).to_pylist():
                total += count(page) or Counter()
            rows = list(total.items())
            yield pa.RecordBatch.from_arrays([pa.array([k for (k, _), _ in rows], pa.string()), pa.array([i for (_, i), _ in rows], pa.bool_()), pa.array([n for _, n in rows], pa.int64())], ["k", "i", "n"])

    marked = pages.where(F.contains(F.lower(html), F.lit("<article"))).select(html, F.xxhash64(key, html).alias("draw"))
    sample = drawn(marked, "draw", sample_pages).select(html)
    rows = sample.mapInArrow(counted, "k string, i boolean, n long").groupBy("k", "i").agg(F.sum("n").alias("n")).collect()
    return weigh(Counter({(r.k, r.i): r.n for r in rows}))


def main_text(page: str, weights: Weights) -> str:
    """The blocks of the best run, one per line, white space inside them as one space. Line breaks end a block too."""
    items = read(page, weights)
    best, low, high, total, start = 0.0, 0, 0, 0.0, 0
    gap: Counter = Counter()
    for k, item in enumerate(items):
        if item.text is not None:
            if not item.out and item.text.strip():
                gap.clear()
            total += weights.of(item)
        else:  # tags without words between them are one border, however many they are
            gap[item.name] += 1
            if gap[item.name] <= (1 if item.inside else GAP_TAGS):
                total += weights.of(item)
        if total <= 0:
            total, start = 0.0, k + 1
        elif total > best:
            best, low, high = total, start, k + 1
    blocks: dict[int, list[str]] = {}
    for item in items[low:high]:
        if item.text is not None and not item.out:
            blocks.setdefault(item.block, []).append(item.text)
    return "\n".join(line for line in (" ".join("".join(parts).split()) for parts in blocks.values()) if line)


def extract(html: Column, weights: Weights) -> Column:
    """The main text of a column of pages; null pages and pages without words have an empty one."""

    def texts(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(page.as_py() or "", weights) for page in pages], pa.string())

    return F.arrow_udf(texts, "string")(html)
