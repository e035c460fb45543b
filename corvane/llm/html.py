"""Main text of HTML pages by two passes of block rules.

The page is read into blocks: text between tags that break the flow, with how much of it
is inside links and which elements hold it. Pass one looks at each block alone: blocks inside menus, headers,
footers, sidebars, notices, adverts, forms and reader comments are boilerplate by their container;
of the others, link density, length and stop-word density make a block good, bad or undecided. In
pass two an undecided block, mostly a short one, takes the label of its nearest
decided neighbours in the same content root (article, main or body); inside an article
or main element undecided means good where no neighbour is decided.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import map_batches

#: Elements whose content is no text of the page.
_SILENT = frozenset("script style noscript template iframe object svg math canvas audio video select textarea button datalist head title".split())
#: Elements that begin and end a block.
_BREAKS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are boilerplate whatever they hold.
_APART = frozenset("nav aside footer form menu dialog fieldset search".split())
#: Parts of class, id and role names that say the same. Whole words of a name, as names are cut at hyphens, underscores and humps.
_APART_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs comment comments commentlist commenting consent cookie cookies copyright
    disqus dialog footer gdpr header login masthead menu menubar menus modal nav navbar navigation navigations newsletter notice notices notification overlay pagination pager popup promo
    promoted promotion related recommended replies reply respond rail search share sharing shares sidebar signin signup skip social sponsor sponsored subscribe subscription toc toolbar
    topbar widget widgets alert contentinfo complementary""".split()
)
_NOT_APART = frozenset("html body article main".split())
#: Words that make a name one about the page or its state: what bears it isn't the sidebar, header and so on itself.
_MODIFIERS = frozenset("has have with without no not non".split())
_STATES = frozenset("open closed enabled disabled".split())
_WRAPS = frozenset("wrap wrapper container layout".split())
#: Parts that have articles of their own, which aren't the page's.
_OWN_ARTICLES = frozenset("ad ads advert adverts comment comments commentlist commenting disqus promo promoted promotion recommended related replies reply respond sidebar sponsor sponsored widget widgets".split())
_ROOTS = frozenset(("article", "main"))

#: Frequent short words of the languages at hand, for density only.
STOP_WORDS = frozenset(
    """a about after all also an and any are as at be because been before but by can could did do does for from had has have he her him his how i if in into is it its
    just like may me more most my no not now of on one only or other our out over she should so some such than that the their them then there these they this those through to under up us
    was we were what when where which who will with would you your
    aber als am an auch auf aus bei bin bis da das dass dem den der des die doch du durch ein eine einem einen einer eines er es für hat ich ihr im in ist ja kann mit nach nicht noch
    nur oder sein sich sie sind so um und uns von vor war was wenn wie wir wird zu zum zur über
    au aux avec ce ces cette dans de des du elle en est et eu il ils je la le les leur lui mais ne nous on ou où par pas plus pour qu que qui sa sans se ses son sont sur tu un une vous
    al algo con como cuando de del desde donde el ella ellos en entre era es esa ese eso esta este esto ha hay la las le lo los me mi muy más no o para pero por porque que se ser si sin sobre
    son su sus también te tiene un una uno y ya""".split()
)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z]+")
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}
_WORD = re.compile(r"[^\W\d_]+")

GOOD, BAD, OPEN = 1, 0, -1


@dataclass(frozen=True)
class Rules:
    """Thresholds of pass one."""

    most_links: float = 0.4
    few_words: int = 12
    many_words: int = 30
    some_stops: float = 0.12
    many_stops: float = 0.25


@dataclass
class Block:
    text: str
    links: int  # characters inside links
    apart: bool  # inside a boilerplate container
    root: int  # which content root, 0 for the body
    heading: bool = False
    label: int = field(default=OPEN)


@lru_cache(1 << 14)
def _apart_words(value: str) -> frozenset[str]:
    """The words of a class, id or role that say that an element is boilerplate. Each name in it is judged as a whole: has-sidebar,
    no-header, comments-open and content-sidebar-wrap are names of what surrounds the text."""
    found: set[str] = set()
    for name in value.split():
        words = [w.lower() for w in _HUMP.split(name) if w]
        if not words or not _MODIFIERS.isdisjoint(words) or len(words) > 1 and words[-1] in _STATES or words[0] == "content" and words[-1] in _WRAPS:
            continue
        found.update(_APART_WORDS.intersection(words))
    return frozenset(found)


def _is_apart(name: str, attributes: str, in_root: bool) -> bool:
    """Whether an element is boilerplate by its kind, or hidden."""
    if name in _APART or name == "header" and not in_root:
        return True
    if name in _NOT_APART or not attributes:
        return False
    for m in _NAMES.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _named_apart(name: str, attributes: str, in_root: bool) -> frozenset[str]:
    """The words by which an element's names make it boilerplate. In an article a header holds the title, whatever element it is."""
    found: frozenset[str] = frozenset()
    if name in _NOT_APART or not attributes:
        return found
    for m in _NAMES.finditer(attributes):
        if m[1].lower() in ("class", "id", "role"):
            found |= _apart_words(m[2] or m[3] or m[4] or "")
    return found - {"header"} if in_root else found


def blocks_of(html: str) -> list[Block]:
    """The blocks of a page in order; blocks without text are left out.

    What holds the page's article or main element isn't boilerplate by its name: the page is read again without such marks.
    An article in comments, a sidebar and the like is the page's if there is no other.
    """
    cleared: frozenset[int] = frozenset()
    while True:
        found, held, plain = _read(html, cleared)
        more = {at for name, marks in held for at, words in marks if name == "main" or not plain or words.isdisjoint(_OWN_ARTICLES)}
        if not more:
            return found
        cleared |= more


def _read(html: str, cleared: frozenset[int]) -> tuple[list[Block], list[tuple[str, list[tuple[int, frozenset[str]]]]], bool]:
    """(blocks, content roots in elements that are boilerplate by name only, with those elements' places and words, whether there are other roots).

    Elements at the places in `cleared` aren't boilerplate by name.
    """
    found: list[Block] = []
    held: list[tuple[str, list[tuple[int, frozenset[str]]]]] = []
    stack: list[tuple[str, bool, int, bool, int]] = []  # name, apart, root, link, silent elements
    standing: Counter[str] = Counter()  # open elements of each name, so that an end tag without any needs no search
    marks: list[tuple[int, int, frozenset[str]]] = []  # depth in the stack, place, words
    hard = 0  # depth of the first element that is boilerplate by kind, 0 for none
    parts: list[str] = []
    link_chars = roots = 0
    apart, root, link = False, 0, False
    heading = False
    silent = 0
    at, end = 0, len(html)

    def text(piece: str) -> None:
        nonlocal link_chars
        if silent or not piece:
            return
        piece = unescape(piece) if "&" in piece else piece
        parts.append(piece)
        if link:
            link_chars += len("".join(piece.split()))

    def flush() -> None:
        nonlocal parts, link_chars
        if parts:
            joined = " ".join("".join(parts).split())
            if joined:
                found.append(Block(joined, link_chars, apart, root, heading))
            parts = []
        link_chars = 0

    def restore() -> None:
        nonlocal apart, root, link, silent, hard
        while marks and marks[-1][0] > len(stack):
            marks.pop()
        hard = hard if hard <= len(stack) else 0
        _, apart, root, link, silent = stack[-1] if stack else ("", False, 0, False, 0)

    def cut(depth: int) -> None:
        for s in stack[depth:]:
            standing[s[0]] -= 1
        del stack[depth:]
        restore()

    while at < end:
        m = _TOKEN.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        if m[1] is not None and not silent:
            parts.append(m[1])
            continue
        if m[3] is None:
            continue
        name, closing = m[3].lower(), bool(m[2])
        if closing:
            if name in _BREAKS:
                flush()
                heading = False
            for i in range(len(stack) - 1, -1, -1) if standing[name] else ():
                if stack[i][0] == name:
                    cut(i)
                    break
                if name not in _BREAKS and stack[i][0] in _BREAKS:
                    break  # an inline end tag doesn't close blocks
            continue
        if name in _BREAKS:
            flush()
            heading = name in ("h1", "h2", "h3", "h4", "h5", "h6")
        if name == "br":
            text("\n")
            continue
        if name in _VOID or m[4].rstrip().endswith("/") and name not in _BREAKS and name not in _SILENT:
            continue
        if name in _CLOSE:
            shut = _CLOSE[name].search(html, at)
            at = shut.end() if shut else end
            continue
        if name in _BREAKS:
            # elements that end where the next of their kind begins, and what was left open inside a paragraph
            ends = {"p"} | ({name} if name in ("li", "option", "tr", "td", "th", "dt", "dd") else set())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    cut(i)
                    break
                if stack[i][0] in _BREAKS:
                    break
        if name in _ROOTS and not apart:
            roots += 1
            root = roots
        elif name in _ROOTS and not hard and not silent:
            held.append((name, [(place, words) for _, place, words in marks]))
        if not hard and _is_apart(name, m[4], root > 0):
            hard, apart = len(stack) + 1, True
        if not hard and m.start() not in cleared and (words := _named_apart(name, m[4], root > 0)):
            marks.append((len(stack) + 1, m.start(), words))
            apart = True
        link = link or name == "a"
        silent += name in _SILENT
        stack.append((name, apart, root, link, silent))
        standing[name] += 1
    flush()
    return found, held, roots > 0


def classify(blocks: list[Block], rules: Rules = Rules()) -> list[Block]:
    """Both passes; the blocks get their labels."""
    in_roots = any(b.root for b in blocks)
    for b in blocks:
        if b.apart or in_roots and not b.root:
            b.label = BAD
            continue
        words = _WORD.findall(b.text.lower())
        chars = len("".join(b.text.split()))
        links = b.links / chars if chars else 1.0
        stops = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
        if links > rules.most_links:
            b.label = BAD
        elif len(words) >= rules.many_words and (stops >= rules.some_stops or b.root):
            b.label = GOOD
        elif len(words) >= rules.few_words and stops >= rules.many_stops:
            b.label = GOOD
        elif not b.root and len(words) >= rules.many_words and stops < rules.some_stops / 4:
            b.label = BAD
    decided = [b.label for b in blocks]
    before: dict[int, int] = {}
    left: list[int] = []
    for b, label in zip(blocks, decided, strict=True):
        left.append(before.get(b.root, OPEN))
        if label != OPEN and not b.apart:
            before[b.root] = label
    after: dict[int, int] = {}
    for i in range(len(blocks) - 1, -1, -1):
        b = blocks[i]
        if decided[i] == OPEN:
            near = {left[i], after.get(b.root, OPEN)} - {OPEN}
            if b.root:
                b.label = BAD if near == {BAD} and b.links else GOOD
            elif b.heading:
                b.label = after.get(b.root, BAD) if after.get(b.root, BAD) != OPEN else BAD
            else:
                b.label = GOOD if near == {GOOD} else BAD
        elif not b.apart:
            after[b.root] = decided[i]
    return blocks


def main_text(html: str | None, rules: Rules = Rules()) -> str:
    """The main text of a page: good blocks in page order, joined by line feeds. Null and empty pages have none."""
    if not html:
        return ""
    return "\n".join(b.text for b in classify(blocks_of(html), rules) if b.label == GOOD)


EXTRACTED = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages. Null html gives an empty text; repeated rows stay; other columns aren't read."""

    def make() -> Callable:
        def work(batch: pa.RecordBatch):
            texts = [main_text(h, rules) for h in batch.column("html").to_pylist()]
            yield {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

        return work

    return map_batches(pages.select(F.col("page_id").cast("long"), "url", "html"), make, EXTRACTED)
