"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides what it
can by measure: blocks of mostly link text are bad, long blocks with many stop
words good, long ones with hardly any bad; short blocks and those between stay
open. The second pass gives open blocks the label of their nearest decided
neighbours, first among the blocks of the same container (the parent element,
or an article or main element around it), then on the page: where both sides
agree, or there is one, that label; else dense blocks and headings above good
text are good, others bad.

Structure is a feature of these rules, and a veto. In an article or main
element thresholds are lower, density is not asked where all its text is sparse
(a language without stop words here), and its ends and sides that differ count
as good. Blocks in navigation, footers, asides, forms and hidden elements are
bad, and so are elements whose class, id or role names them as sidebars,
adverts, notices, comments and the like, unless all body text of the page lies
in them: then the outermost such names are set aside, level by level.

Defined results: null or empty html gives an empty text; unclosed tags,
comments and scripts end at the page's end, close tags of nothing open are
ignored, a link ends at the latest with the element that it began in; other
columns are ignored; repeated rows each give a row; an empty table gives none.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORT, LONG = 70, 200
NONE, SPARSE, DENSE, DENSE_IN_ARTICLE = 0.05, 0.20, 0.30, 0.20
KNOWN = 0.10  # an article of a language with stop words here has this density at least
LINKED, LINKED_IN_ARTICLE = 0.33, 0.66

# Common function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a about after all also an and any are as at be been but by can could do for from had has have he her his how i if in into is it its just more my new no not of on one
    only or other our out over she so some than that the their them then there these they this to up was we were what when which who will with would you your
    aber als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer er es für hat hatte ich ihr im in ist ja kann man mehr mit nach
    nicht noch nur oder sein sich sie sind so über um und uns unter vom von vor war was wenn wer wie wir wird zu zum zur
    au aux avec ce ces cette comme dans de des du elle en est et eux il ils je la le les leur lui mais me même ne nous on ou où par pas plus pour qu que qui sa se ses son sont sur
    te tu un une vous y
    al algo como con de del desde donde el ella ellos en entre era es esta este esto fue ha hay la las le les lo los más me mi muy nada ni no nos o para pero por porque que quien se
    ser si sin sobre son su sus también te tiene todo un una uno y ya yo""".split()
)
# Names of elements, and words in class, id and role, that mark what is no main text.
DROPPED = "script style noscript template svg iframe textarea select option button title object canvas math audio video".split()
BAD_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
BAD_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adsense alert announcement banner bottombar breadcrumb breadcrumbs byline-ads comment comments complementary consent contentinfo
    cookie cookies copyright dialog disclaimer disqus feedback footer gdpr hidden legal login masthead menu menubar modal nav navbar navigation newsletter notice notices notification
    outbrain overlay pager pagination popup promo promoted promotion recommendations recommended related replies reply respond search share sharing sidebar signin signup skip social
    sponsor sponsored subscribe subscription taboola teaser toolbar topbar widget widgets""".split()
)
HEAD_WORDS = frozenset(("header", "top"))
CONTENT_TAGS = frozenset(("article", "main"))
BLOCK_TAGS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend
    li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul""".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(DROPPED) + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?:[/!?][^>]*|[a-zA-Z][^>]*)(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?<![\w-])(?:hidden(?![\w-])|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z]+")
DECIDED = ("good", "bad")
_WORD_EDGE = re.compile(r"^\W+|\W+$")


def _is_bad(tag: str, attrs: str, in_content: bool) -> tuple[bool, bool]:
    """(by its tag or hidden, by a name in class, id or role)."""
    if tag in BAD_TAGS or tag == "header" and not in_content:
        return True, False
    if not attrs or tag in ("html", "body"):
        return False, False
    if _HIDDEN.search(attrs):
        return True, False
    words = {w.lower() for m in _ATTR.finditer(attrs) for w in _CAMEL.split(m[2] or m[3] or m[4] or "")}
    return False, bool(words & BAD_WORDS) or not in_content and bool(words & HEAD_WORDS)


class Block(NamedTuple):
    text: str
    links: float  #: share of link text
    bad: bool  #: in an element that is bad by its tag, or hidden
    named: int  #: how many elements with bad names are around it
    content: bool  #: in an article or main element
    heading: bool
    container: int  #: number of the article or main element around it, else of its parent


class _Open(NamedTuple):
    tag: str
    bad: bool = False
    named: int = 0
    content: int = 0  #: number of the outermost article or main element
    heading: bool = False
    number: int = 0
    parent: int = 0


def blocks(page: str) -> list[Block]:
    """The blocks with text, in page order."""
    out: list[Block] = []
    stack: list[_Open] = []
    opened: Counter = Counter()  # how often each tag is in the stack
    parts: list[str] = []
    links = breaks = number = 0
    link = -1  # the depth at which a link began; it may hold blocks, and ends at the latest with the element that it began in

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(parts).split())
        if text:
            e = stack[-1] if stack else _Open("")
            out.append(Block(text, min(1.0, links / len(text)), e.bad, e.named, e.content > 0, e.heading, e.content or e.parent))
        parts.clear()
        links = 0

    def close(k: int) -> None:
        nonlocal link
        for entry in stack[k:]:
            opened[entry.tag] -= 1
        del stack[k:]
        if link > k:
            link = -1

    def take(raw: str) -> None:
        nonlocal links, breaks
        if raw:
            text = html.unescape(raw)
            parts.append(text)
            if not text.isspace():
                breaks = 0
                if link >= 0:
                    links += len(" ".join(text.split()))

    at = 0
    for m in _TOKEN.finditer(page):
        take(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
            breaks += 1
            if breaks > 1:
                flush()
            continue
        if tag in BLOCK_TAGS:
            flush()
            breaks = 0
        if tag == "a":
            link = -1 if m["close"] else len(stack)
        if tag in VOID or m["attrs"].endswith("/"):
            continue
        if not m["close"]:
            around = stack[-1] if stack else _Open("")
            if tag in BLOCK_TAGS or m["attrs"] and any(_is_bad(tag, m["attrs"], around.content > 0)):
                if tag not in BLOCK_TAGS:
                    flush()
                if tag == "p" and around.tag == "p":  # a paragraph ends where the next begins
                    close(len(stack) - 1)
                    around = stack[-1] if stack else _Open("")
                by_tag, by_name = _is_bad(tag, m["attrs"], around.content > 0)
                number += 1
                content = around.content or (number if tag in CONTENT_TAGS else 0)
                stack.append(_Open(tag, around.bad or by_tag, around.named + by_name, content, around.heading or tag in HEADINGS, number, around.number))
                opened[tag] += 1
        elif opened[tag]:  # else nothing of that name is open
            k = len(stack) - 1
            while stack[k].tag != tag:
                k -= 1
            flush()
            close(k)
    take(page[at:])
    flush()
    return out


def stop_density(text: str) -> float:
    words = [w for w in (_WORD_EDGE.sub("", x) for x in text.lower().split()) if w]
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def _first_pass(block: Block, density: float, known: bool) -> str:
    """good, bad, short or near; ``known``: stop words tell something about this text."""
    n = len(block.text)
    if block.links > (LINKED_IN_ARTICLE if block.content else LINKED) or block.text[0] == "©" and n <= LONG:
        return "bad"
    if n < SHORT:
        return "short" if block.links == 0 or block.content else "bad"
    if block.content and (not known or density >= DENSE_IN_ARTICLE) or density >= DENSE and n > LONG:
        return "good"
    return "bad" if density < NONE and n > LONG or block.content and block.links > LINKED else "near"


def _level(found: list[Block], density: list[float]) -> int:
    """How many bad names around a block are set aside: as few as leave body text, which is a block of an article or main, or two blocks."""
    here: dict[int, int] = {}
    for x, d in zip(found, density, strict=True):
        if not x.bad and x.links <= LINKED and len(x.text) >= (SHORT if x.content else LONG) and d >= (DENSE_IN_ARTICLE if x.content else DENSE):
            here[x.named] = here.get(x.named, 0) + (2 if x.content or not x.named else 1)
    return min((named for named, n in here.items() if n > 1), default=0)


def _decided(labels: list[str], edge: str | None) -> list[str | None]:
    """The nearest decided label before each."""
    out, last = [], edge
    for x in labels:
        out.append(last)
        last = x if x in DECIDED else last
    return out


def _inherit(found: list[Block], density: list[float], labels: list[str], which: list[int], edge: str | None) -> None:
    """Gives open blocks of ``which`` the label of their neighbours there; with no neighbour at all they stay open."""
    own = [labels[k] for k in which]
    for k, left, right in zip(which, _decided(own, edge), reversed(_decided(own[::-1], edge)), strict=True):
        if labels[k] in DECIDED or not (left or right):
            continue
        if left == right or not (left and right):
            labels[k] = left or right
        else:
            likely = labels[k] == "near" and density[k] >= SPARSE or found[k].heading and right == "good"
            labels[k] = "good" if found[k].content or likely else "bad"


def judged(page: str | None) -> tuple[list[Block], list[str], list[str]]:
    """(blocks, labels of the first pass, where "veto" stands for bad by structure, labels in the end: good or bad)."""
    found = blocks(page or "")
    density = [0.0 if x.bad else stop_density(x.text) for x in found]
    level = _level(found, density)
    out = [x.bad or x.named > level for x in found]
    long = [k for k, x in enumerate(found) if x.content and not out[k] and len(x.text) >= SHORT and x.links <= LINKED]
    known = sum(density[k] * len(found[k].text) for k in long) >= KNOWN * sum(len(found[k].text) for k in long)
    first = ["veto" if out[k] else _first_pass(x, density[k], known) for k, x in enumerate(found)]
    labels = ["bad" if x == "veto" else x for x in first]
    containers: dict[int, list[int]] = {}
    for k, x in enumerate(found):
        if not out[k]:
            containers.setdefault(x.container, []).append(k)
    for which in containers.values():
        _inherit(found, density, labels, which, "good" if found[which[0]].content else None)
    _inherit(found, density, labels, list(range(len(found))), "bad")
    return found, first, labels


def main_text(page: str | None) -> str:
    found, _, labels = judged(page)
    return "\n\n".join(x.text for x, label in zip(found, labels, strict=True) if label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of ``pages``."""

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                texts = [main_text(p) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"]
                )

    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html"
    ).mapInArrow(run, "page_id long, url string, text string, n_chars long")
