"""HTML extraction (operator 3): two-pass block rules.

A page is cut into blocks at block-level tags. The first pass looks at each block alone: blocks in
parts of the page that are never main text (menus, footers, asides, dialogs, told by tag, role or the ``hidden`` attribute; adverts, notices,
comments, told by a word of a class or id; forms) and blocks mostly of link text are boilerplate; long blocks
with enough stop words are main text, and on a page in none of the languages of the stop words long blocks with sentence marks; the
rest is ambiguous. In the second pass ambiguous blocks inherit the label of the nearest decided neighbours in their container (two that
disagree: the nearer one; equally near: main text). A container without decided blocks counts as main text if it is an article, else it asks
the nearest decided blocks of the page; blocks that are boilerplate by their place do not pass that on.

Wrappers are told from parts: a class that only names a state (``no-sidebar``, ``has-social``, ``comments-open``) says nothing; an
element that is boilerplate by class, id or as a form is pardoned if the page's only article or main element is in it. Where
a page would come out empty, one that holds several blocks and most of the text outside links is pardoned too, and if no block is decided then, all
blocks of plain text in good places are main text.

NULL and empty pages, and pages without main text, give the empty text. Whole pages are read; broken or cut markup is
read as far as it goes: an element of no text that is never closed ends with its parent (scripts and styles: with the page). Repeated rows give
repeated results; an empty table gives no rows. Only page_id, url and html are read, so further columns of any name do not matter. A tie of two
equally near neighbours is main text. Very long pages are read whole, one after the other.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# Frequent function words of the languages met.
STOP_WORDS = frozenset(
    """the of and to in is that it for was on are as with his they at be this from have or by one had not but what all were when we there can an your which
    der die das und in zu den von mit ist des im für auf sich nicht ein eine als auch an werden aus er hat dass sie nach wird bei
    le la les de des du et en un une que est pour qui dans par sur au plus ne pas se ce il sont avec son elle
    el los las del y a un una que es por con para su al lo como más o pero sus se no""".split()
)
BLOCK_TAGS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr
    html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul""".split()
)
SKIP_TAGS = frozenset("script style noscript template title textarea select svg iframe object head math button canvas audio video".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD_TAGS = frozenset("nav footer aside menu dialog".split())
WRAPPING_BAD_TAGS = frozenset(["form"])  # some servers wrap whole pages in one
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
BAD_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay
    menu nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead share sharing social related recommended comment comments reply replies disqus
    subscribe subscription newsletter login signup search toolbar widget copyright""".split()
)
# A class with one of these as its first or last part names a state of the element, not its kind.
STATE_FIRST = frozenset("no not has is with without hide show can".split())
STATE_LAST = frozenset("open opened closed enabled disabled active inactive visible allowed on off".split())
ARTICLE_TAGS = frozenset(["article", "main"])
RAW_TAGS = frozenset("script style textarea title".split())  # only their own end tag ends them

LONG = 70  # characters from which a block can be decided alone
STOP_DENSITY = 0.12
LINK_DENSITY = 0.5
OTHER_LANGUAGE = 0.04  # share of stop words in the plain text of a page below which its language is none of theirs
WRAPPER_BLOCKS = 3  # blocks that make an element a wrapper

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'">]|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTES = re.compile(r"""([^\s"'=/<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")
_SENTENCE = re.compile(r"[.!?…。！？؟।۔](?:\W|$)|[。！？]")
_STRIP = ".,;:!?\"'()"


class Block:
    __slots__ = ("parts", "linked", "hard", "soft", "bad", "container", "article", "label")

    def __init__(self, hard: bool, soft: tuple[int, ...], container: int, article: bool):
        self.parts: list[str] = []
        self.linked, self.hard, self.soft, self.bad = 0, hard, soft, hard or bool(soft)
        self.container, self.article, self.label = container, article, None


def _bad_name(token: str) -> bool:
    parts = [p for p in _PARTS.split(token) if p]
    if not parts or (len(parts) > 1 and (parts[0] in STATE_FIRST or parts[-1] in STATE_LAST)):
        return False
    return not BAD_NAMES.isdisjoint(parts)


def _bad_element(tag: str, attributes: str, in_article: bool) -> str:
    """"hard" if the element is boilerplate whatever it holds, "soft" if it may be a wrapper, else empty."""
    if tag in BAD_TAGS or (tag == "header" and not in_article):
        return "hard"
    found = "soft" if tag in WRAPPING_BAD_TAGS else ""
    if not attributes or attributes.isspace():
        return found
    whole = tag in ("body", "html", "article", "main")
    for name, value in _ATTRIBUTES.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "style" and _NO_DISPLAY.search(value)):
            return "hard"
        if whole:
            continue
        if name == "role" and not BAD_ROLES.isdisjoint(value.split()):
            return "hard"
        if name in ("class", "id") and any(map(_bad_name, value.split())):
            found = "soft"
    return found


def _skipped(html: str, pos: int, tag: str, parents: list[str]) -> int:
    """Where reading goes on after the start tag of an element without text of its own."""
    end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, pos)
    if tag in RAW_TAGS or tag == "head":
        return end.end() if end else pos if tag in ("head", "title") else len(html)
    if end and not re.compile(rf"<{re.escape(tag)}[\s>/]", re.I).search(html, pos, end.start()):
        return end.end()
    # Not closed, or closed by a later one: its parent's end ends it.
    names = "|".join({re.escape(t) for t in parents if t})
    parent = re.compile(rf"</(?:{names})\b", re.I).search(html, pos) if names else None
    if parent and not (end and end.start() < parent.start()):
        return parent.start()
    return end.end() if end else pos


def blocks(html: str) -> list[tuple[str, Block]]:
    """(text, block) in page order; only blocks with text."""
    out: list[Block] = []
    stack: list[tuple[str, bool, tuple[int, ...], int, bool]] = [("", False, (), 0, False)]  # tag, hard, soft elements, container, inside an article
    containers, anchor, now, pos = 0, 0, None, 0
    elements, holders, free = 0, set(), False  # soft elements; those with an article; an article outside them

    def add(text: str) -> None:
        nonlocal now
        if now is None:
            now = Block(*stack[-1][1:])
            out.append(now)
        now.parts.append(text)
        if anchor:
            now.linked += len(unescape(text).strip())

    while pos < len(html):
        m = _MARKUP.search(html, pos)
        if m is None:
            add(html[pos:])
            break
        if m.start() > pos:
            add(html[pos : m.start()])
        pos = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        kind = "" if closing or tag in SKIP_TAGS or tag in VOID_TAGS else _bad_element(tag, attributes, stack[-1][4])
        if tag in SKIP_TAGS:
            if not closing and not attributes.endswith("/"):
                pos = _skipped(html, pos, tag, [s[0] for s in stack])
        elif tag == "br":
            if now is not None:
                now.parts.append(" ")
        elif tag == "a":
            anchor = 0 if closing else 1
        elif tag in BLOCK_TAGS or kind:
            now = None
            anchor = 0 if closing else anchor
            if tag in VOID_TAGS or tag == "p":
                if kind:
                    _, hard, soft, container, article = stack[-1]
                    elements += 1
                    now = Block(hard or kind == "hard", (*soft, elements) if kind == "soft" else soft, container, article)
                    out.append(now)
            elif not closing:
                _, hard, soft, container, article = stack[-1]
                if tag in ("article", "main", "section", "div", "td", "body", "form", "header", *BAD_TAGS):
                    containers += 1
                    container = containers
                hard = hard or kind == "hard"
                if kind == "soft":
                    elements += 1
                    soft = (*soft, elements)
                if tag in ARTICLE_TAGS and not hard:
                    holders.update(soft)
                    free = free or not soft
                stack.append((tag, hard, soft, container, article or tag in ARTICLE_TAGS))
            else:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
        elif closing and any(s[0] == tag for s in stack[1:]):
            while stack.pop()[0] != tag:
                pass
            now = None
    for b in out:
        if not free:
            b.soft = tuple(e for e in b.soft if e not in holders)
        b.bad = b.hard or bool(b.soft)
    texts = [(" ".join(unescape("".join(b.parts)).split()), b) for b in out]
    return [(t, b) for t, b in texts if t]


def _width(text: str) -> int:
    """Characters, those of scripts written without spaces twice."""
    return len(text) if text.isascii() else sum(2 if c >= "⺀" else 1 for c in text)


def _stop_words(text: str) -> tuple[int, int]:
    words = [w.strip(_STRIP).lower() for w in text.split()]
    return sum(w in STOP_WORDS for w in words), len(words)


def classify(found: list[tuple[str, Block]]) -> list[bool]:
    """Main text or not, for each block."""
    plain = [(text, b) for text, b in found if not b.bad and b.linked <= LINK_DENSITY * len(text)]
    counts = {id(b): _stop_words(text) for text, b in plain}
    stops, words = sum(s for s, _ in counts.values()), sum(n for _, n in counts.values())
    other = stops < OTHER_LANGUAGE * words
    for _, b in found:
        b.label = False
    for text, b in plain:
        b.label = None
        if _width(text) >= LONG:
            s, n = counts[id(b)]
            if s >= STOP_DENSITY * n or (other and _SENTENCE.search(text)):
                b.label = True
    decided = [b.label for _, b in found]
    by_container: dict[int, list[int]] = {}
    for i, (_, b) in enumerate(found):
        if decided[i] is not None and not b.bad:
            by_container.setdefault(b.container, []).append(i)
    anywhere = [i for i, (_, b) in enumerate(found) if decided[i] is not None and not b.bad]

    def nearest(i: int, among: list[int]) -> bool | None:
        k = bisect_left(among, i)
        before, after = (among[k - 1] if k else None), (among[k] if k < len(among) else None)
        if before is None or after is None or decided[before] == decided[after]:
            j = before if before is not None else after
            return None if j is None else decided[j]
        return decided[before] if i - before < after - i else decided[after] if after - i < i - before else True

    out = []
    for i, (_, b) in enumerate(found):
        label = decided[i]
        if label is None:
            label = nearest(i, by_container.get(b.container, []))
            if label is None:
                label = True if b.article else nearest(i, anywhere)
        out.append(bool(label))
    return out


def _pardon(found: list[tuple[str, Block]]) -> bool:
    """Pardon the soft elements that wrap most of the plain text of a page; False if there are none."""
    total, held, number = 0, Counter(), Counter()
    for text, b in found:
        if not b.hard and b.linked <= LINK_DENSITY * len(text):
            total += len(text)
            for e in b.soft:
                held[e] += len(text)
                number[e] += 1
    wrappers = {e for e, n in held.items() if 2 * n > total and number[e] >= WRAPPER_BLOCKS}
    for _, b in found:
        b.soft = tuple(e for e in b.soft if e not in wrappers)
        b.bad = b.hard or bool(b.soft)
    return bool(wrappers)


def main_text(html: str | None) -> str:
    """Main text of a page, its blocks joined by one blank."""
    found = blocks(html or "")
    good = classify(found)
    if not any(good) and _pardon(found):
        good = classify(found)
    if not any(good):
        good = [not b.bad and b.linked <= LINK_DENSITY * len(text) for text, b in found]
    return " ".join(text for (text, _), ok in zip(found, good, strict=True) if ok)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    small_batches(pages.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            arrays = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
