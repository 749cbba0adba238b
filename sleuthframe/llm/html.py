"""Main text of web pages: two-pass block rules over a page's blocks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks shorter than SHORT characters are ambiguous, from LONG on they decide alone.
SHORT, LONG = 70, 140
#: Share of characters in links from which a block is navigation.
MAX_LINKS = 0.2
#: Shares of stop words in running text, and in text that its neighbours must confirm. Half of running text's blocks have
#: 0.29 or more, a twentieth less than 0.09; that is lower than in plain prose, as pages mix in names, code and foreign words.
STOP_HIGH, STOP_LOW = 0.18, 0.08

# Elements by what they are to a page.
HIDDEN = frozenset("script style noscript template iframe svg canvas object head title select option datalist audio video math".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
ASIDE = frozenset("nav header footer aside form menu dialog button fieldset label input textarea".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTUAL = HEADINGS | frozenset("p li dd dt blockquote pre center".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSED = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class, id or role that mark an element as no part of the article.
MARKS = frozenset(
    "ad ads adv advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments cookie cookies consent contentinfo copyright disclaimer "
    "discussion disqus feedback foot footer form gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination "
    "pingback popup promo promoted promotion recommended related replies reply respond search share sharing sidebar sidebars signup skip social sponsor sponsored "
    "subscribe subscription tags toolbar tooltip topbar trackback trending widget widgets".split()
)
#: Frequent function words of English, German, French and Spanish.
STOPS = frozenset(
    "a all an and are as at be been but by for from had has have he her his i if in is it its not of on or she so that the their them they this to was we were what which who will with would you "
    "aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer es für hat ich im in ist mit nach nicht noch nur oder sein sich sie sind so über um und von vor war wenn wie wird zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous ont ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "al como con de del donde el ella en era es esa ese eso esta este esto ha la las le lo los más me mi muy no nos o para pero por que se ser si sin sobre su sus también te un una y ya".split()
)

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_HIDE = re.compile(r"""(?:^|\s)(?:hidden(?:[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.IGNORECASE)
_WORDS = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    """Running text between two block borders, with what the rules look at."""

    region: str  # "main", "out" or "" (undecided)
    heading: bool
    text: str
    linked: int
    parent: int  # the number of the container that it stands in


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes): kinds are open, close and text. Comments and raw elements' contents are left out."""
    at, size, lower = 0, len(html), None
    while at < size:
        begin = html.find("<", at)
        if begin < 0:
            begin = size
        if begin > at:
            yield "text", html[at:begin], ""
        if begin == size:
            return
        if html.startswith("<!--", begin):
            end = html.find("-->", begin + 4)
            at = size if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), begin):
            end = html.find(">", begin)
            at = size if end < 0 else end + 1
            continue
        m = _TAG.match(html, begin) or _LOOSE.match(html, begin)
        if m is None:
            if begin + 1 < size and (html[begin + 1].isalpha() or html[begin + 1] == "/"):
                return  # a tag that the page's end cuts off
            yield "text", "<", ""
            at = begin + 1
            continue
        name, at = m[2].lower(), m.end()
        yield ("close" if m[1] else "open"), name, m[3]
        if name in RAW and not m[1] and not m[3].endswith("/"):
            lower = html.lower() if lower is None else lower
            lower = lower if len(lower) == size else re.sub(r"[A-Z]", lambda x: x[0].lower(), html)
            end = lower.find("</" + name, at)
            if end < 0:
                return
            at = end


def _region(name: str, attributes: str, around: str, in_main: bool) -> str:
    """What an element is to the page: "main", "out" or what stands around it."""
    if around == "hidden" or name in HIDDEN or _HIDE.search(attributes):
        return "hidden"
    marked = {w for m in _NAMES.finditer(attributes) for w in re.split(r"[^a-z0-9]+", m[1].lower())} if attributes else set()
    if name not in ("html", "body") and marked & MARKS:
        return "comments" if marked & {"comment", "comments", "discussion", "disqus", "replies", "respond", "reply"} else "out"
    if around == "comments":
        return around
    if name in MAIN or marked & {"main"} and name != "body":
        return "main"
    if name in ASIDE and not (name == "header" and in_main):
        return "out"
    return around


def blocks(html: str) -> list[Block]:
    """The page's blocks in order, with regions."""
    found: list[Block] = []
    stack: list[tuple[str, str, bool, int]] = []  # name, region, whether a main element is open, the block that texts within belong to
    counts: Counter[str] = Counter()  # open elements by name, so that a closing tag without one is passed over at once
    opened = 0
    parts: list[str] = []
    region, heading, in_link, linked = "", False, 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            found.append(Block("out" if region in ("out", "comments") else region, heading, text, linked, stack[-1][3] if stack else 0))
        parts.clear()
        linked = 0

    def close(k: int) -> None:
        """Close the element at ``k`` and all within it."""
        nonlocal region
        for entry in stack[k:]:
            counts[entry[0]] -= 1
        del stack[k:]
        region = stack[-1][1] if stack else ""

    for kind, name, attributes in tokens(html):
        if kind == "text":
            if region != "hidden":
                text = unescape(name)
                parts.append(text)
                if in_link:
                    linked += len("".join(text.split()))
            continue
        border = name in BLOCKS or name in HIDDEN or name in ASIDE
        if border:
            flush()
        elif name == "br":
            parts.append(" ")
        if name == "a":
            in_link = 0 if kind == "close" else 1
        if name in CLOSED:
            continue
        if kind == "open":
            here = _region(name, attributes, region, bool(stack) and stack[-1][2])
            if here != region and not border:
                flush()
            if name in HEADINGS:
                heading = True
            if border or here != region:
                if name == "p" and stack and stack[-1][0] == "p":
                    close(len(stack) - 1)
                    here = _region(name, attributes, region, bool(stack) and stack[-1][2])
                opened += 1
                _, _, in_main, parent = stack[-1] if stack else ("", "", False, 0)
                stack.append((name, here, in_main or here == "main", parent if name in TEXTUAL else opened))
                counts[name] += 1
                region = here
        else:
            if name in HEADINGS:
                heading = False
            if counts[name]:
                k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name)
                if stack[k][1] != (stack[k - 1][1] if k else "") and not border:
                    flush()
                close(k)
    flush()
    return found


def stop_density(text: str) -> float:
    """The share of stop words among a text's words."""
    words = _WORDS.findall(text.lower())
    return sum(w in STOPS for w in words) / max(1, len(words))


def first_pass(block: Block, marked: bool = False, known: bool = True) -> str:
    """A block's own label: good, bad, near (good if a neighbour agrees), short (good if none disagrees), or inner (the same inside the article).

    Link-dense blocks are bad, long ones with the stop words of running text good.
    Where the page marks its article (``marked``), what stands outside is bad;
    inside, short blocks, those with few stop words and headings with links are
    ambiguous. An article of which no long block has any is in a language that
    isn't ``known``, and length decides alone.
    """
    if block.region == "out" or marked and block.region != "main":
        return "bad"
    size = len(block.text)
    links = block.linked / max(1, size - block.text.count(" "))
    if block.region == "main":
        if links > MAX_LINKS:
            return "inner" if block.heading else "bad"
        return "good" if size >= SHORT and (not known or stop_density(block.text) >= STOP_LOW) else "inner"
    if links > MAX_LINKS or block.text.startswith("\xa9") or "&copy" in block.text:
        return "bad"
    if size < SHORT:
        return "bad" if block.linked else "short"
    density = stop_density(block.text)
    if density >= STOP_HIGH and size > LONG:
        return "good"
    return "near" if density >= STOP_LOW else "short"


def second_pass(page: list[Block], labels: list[str]) -> list[bool]:
    """Ambiguous blocks take the label of their nearest decided neighbours.

    Neighbours are looked for in the block's own container first. There, ``near``
    is good if either side is good, ``short`` if no side is bad. If none is decided
    in the container, both sides on the whole page must be good, the page's ends
    being bad; but a heading goes with what follows it. ``inner`` blocks look no
    further than the article's blocks, those in their own container first: they
    are bad only if all decided ones next to them are.
    """
    sides: list[list[tuple[str, str, str, str]]] = []
    for walk in (range(len(page)), range(len(page) - 1, -1, -1)):
        own: dict[int, str] = {}
        inside: dict[int, str] = {}
        last, article, seen = "bad", "", [("", "", "", "")] * len(page)
        for i in walk:
            seen[i] = own.get(page[i].parent, ""), last, inside.get(page[i].parent, ""), article
            if labels[i] in ("good", "bad"):
                own[page[i].parent] = last = labels[i]
                if page[i].region == "main":
                    inside[page[i].parent] = article = last
        sides.append(seen)
    kept = []
    for block, label, before, after in zip(page, labels, *sides, strict=True):
        if label in ("near", "short"):
            own = {before[0], after[0]} - {""}
            agrees = ("good" in own if label == "near" else own == {"good"}) if own else before[1] == after[1] == "good"
            kept.append(agrees or block.heading and "good" in (after[0] or after[1]))
        elif label == "inner":
            around = {before[2], after[2]} - {""} or {before[3], after[3]} - {""}
            follows = after[2] or after[3]
            kept.append(follows == "good" if block.heading and follows else around != {"bad"})
        else:
            kept.append(label == "good")
    return kept


def judged(page: list[Block]) -> list[bool]:
    """Whether each block belongs to the article, by both passes."""
    marked = any(b.region == "main" for b in page)
    known = not marked or any(b.region == "main" and len(b.text) >= SHORT and stop_density(b.text) >= STOP_LOW for b in page)
    return second_pass(page, [first_pass(b, marked, known) for b in page])


def main_text(html: str | None) -> str:
    """The article of a page: its blocks joined by two line ends; empty if there is none.

    Blocks in menus, forms, comments and the like are bad by their place, and
    those outside an article that the page marks; both passes decide on the rest.
    """
    page = blocks(html or "")
    return "\n\n".join(b.text for b, good in zip(page, judged(page), strict=True) if good)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (``page_id, url, html``).

    Null and empty pages have an empty text. Rows are independent: repeated rows
    give equal texts, other columns are ignored, an empty table gives an empty
    table. Whole pages are read, in time linear in their length.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [main_text(h if isinstance(h, str) else None) for h in frame["html"]]
            yield pd.DataFrame({"page_id": frame["page_id"].astype("Int64"), "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInPandas(read, "page_id long, url string, text string, n_chars long")
