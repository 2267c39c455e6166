"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides each block alone:
blocks in boilerplate containers (menus, headers, footers, sidebars, notices, adverts, forms,
reader comments, by tag, role, class or id) and blocks made of links are out; blocks in an
article or main container are in; elsewhere length, link density and the density of stop
words decide, and short or middling blocks stay open. The second pass gives each open block
the label of its nearest decided neighbours.

One pass over the pages, without a shuffle; a task holds one batch of pages.

Defined cases: a null or empty page has the empty text; unclosed and stray tags, comments and
scripts are tolerated; a page may have no main text at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINK_DENSITY = 0.2
MAIN_LINK_DENSITY = 0.6
SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.30, 0.32

STOP_WORDS = frozenset(
    """a about after all also an and are as at be been but by can for from had has have he her his how i if in into is it its
    more no not of on one or our out over she so some than that the their them then there these they this to up was we were
    what when which who will with would you your
    aber alle als am an auch auf aus bei bin bis das dass dem den der des die dies du durch ein eine einem einen einer er es
    für hat ich ihr im in ist ja kann man mehr mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war
    was wenn werden wie wir wird zu zum zur
    au aux avec ce ces cette comme dans de des du elle en est et eux il ils je la le les leur lui mais me même mon ne nous on
    ou où par pas plus pour qu que qui sa se ses son sont sur te tu un une vous
    al como con de del desde el ella en entre era es esta este fue ha han hay la las le lo los más me mi muy no nos o para
    pero por que qué se ser si sin sobre son su sus también te tiene todo un una y ya yo""".split()
)

#: Raw text up to the end tag.
HIDDEN = "script|style|iframe|textarea|title"
TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>{HIDDEN})\b(?:[^>"']|"[^"]*"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<drawn>svg|math)\b(?:[^>"']|"[^"]*"|'[^']*')*+(?<!/)>(?:(?!<(?P=drawn)\b).)*?</(?P=drawn)\s*>|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>|[^<]+|<""",
    re.S | re.I,
)
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = BLOCK - frozenset("p hr h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OUT_TAGS = frozenset("nav aside footer form dialog menu search fieldset".split())
#: Nothing in these is text; one that is left open ends at the next block-level tag.
OUT_PARTS = frozenset("noscript template svg object select button math canvas".split())
IN_TAGS = frozenset(["article", "main"])
OUT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|gdpr|notice\w*|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|menu\w*|nav\w*|breadcrumb\w*|sidebar\w*|side|widget\w*|foot\w*|masthead|topbar|site-header|page-header|header|comment\w*|disqus|respond|reply|replies|discussion|share\w*|sharing|social\w*|related\w*|recommend\w*|pagination|pager|skip\w*|search\w*|toolbar|copyright|legal|disclaimer)(?:$|[\s_-])",
    re.I,
)
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


def zone(tag: str, rest: str, within: str) -> str:
    """'in', 'out' or '' (undecided) for what a container holds."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)} if rest.strip() else {}
    names = f"{found.get('class', '')} {found.get('id', '')}"
    if within == "out" or tag in OUT_TAGS or "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return "out"
    if found.get("role", "").lower() in OUT_ROLES or (tag not in ("html", "body") and OUT_NAMES.search(names)):
        return "out"
    if tag == "header":
        return "head" if within == "in" else "out"
    if tag in IN_TAGS or found.get("role", "").lower() in ("main", "article") or found.get("itemprop", "").lower() == "articlebody":
        return "in"
    return within


class Block:
    __slots__ = ("text", "linked", "zone", "heading", "label")

    def __init__(self, text: str, linked: int, zone: str, heading: bool):
        self.text, self.linked, self.zone, self.heading, self.label = text, linked, zone, heading, ""


def closed_parts(tokens: list[re.Match]) -> dict[int, int]:
    """Start and end of each of ``OUT_PARTS`` that is closed within the container around it."""
    closed: dict[int, int] = {}
    open_tags: list[tuple[str, int]] = []
    for i, m in enumerate(tokens):
        tag = (m["tag"] or "").lower()
        if tag not in CONTAINERS and tag not in OUT_PARTS:
            continue
        if not m["end"]:
            if m["rest"].endswith("/"):
                continue
            if tag in ("button", "select"):  # these do not nest
                open_tags = [x for x in open_tags if x[0] != tag]
            open_tags.append((tag, i))
        elif any(t == tag for t, _ in open_tags):
            while (last := open_tags.pop())[0] != tag:
                pass
            if tag in OUT_PARTS:
                closed[last[1]] = i
    return closed


def blocks(html: str) -> list[Block]:
    found: list[Block] = []
    stack: list[tuple[str, str]] = [("", "")]
    parts: list[tuple[str, bool]] = []
    link, heading, breaks = 0, "", 0

    def flush() -> None:
        nonlocal breaks
        if parts:
            text = " ".join("".join(t for t, _ in parts).split())
            if text:
                linked = sum(len(" ".join(t.split())) for t, in_link in parts if in_link)
                found.append(Block(text, linked, stack[-1][1], bool(heading)))
            parts.clear()
        breaks = 0

    tokens = list(TOKEN.finditer(html))
    closed = closed_parts(tokens) if any(m["tag"] and m["tag"].lower() in OUT_PARTS for m in tokens) else {}
    skip, hidden = -1, False
    for i, m in enumerate(tokens):
        if i <= skip:
            continue
        tag = m["tag"]
        if tag is None:
            text = m[0]
            if m["raw"] or m["drawn"] or (text[0] == "<" and len(text) > 1 and text[1] in "!?/"):
                if text.startswith("<![CDATA[") and not hidden:
                    parts.append((text[9:].removesuffix("]]>"), link > 0))
                continue
            if hidden:
                continue
            parts.append((unescape(text), link > 0))
            if not text.isspace():
                breaks = 0
            continue
        tag = tag.lower()
        if tag == "a":
            link = 0 if m["end"] else 1
        elif tag == "br":
            breaks += 1
            parts.append((" ", False))
            if breaks > 1:
                flush()
        elif tag in OUT_PARTS:
            skip = closed.get(i, -1)
            hidden = hidden or (not m["end"] and i not in closed and not m["rest"].endswith("/"))
        elif tag in BLOCK:
            flush()
            hidden = False
            if tag in HEADINGS:
                heading = "" if m["end"] else tag
            if tag in CONTAINERS:
                link = 0
                if not m["end"]:
                    if not m["rest"].endswith("/"):
                        stack.append((tag, zone(tag, m["rest"], stack[-1][1])))
                elif any(t == tag for t, _ in stack[1:]):
                    while stack.pop()[0] != tag:
                        pass
    flush()
    return found


def first_pass(block: Block) -> str:
    """'good', 'bad', or open: 'near' (likely good) and 'short'."""
    length = len(block.text)
    density = block.linked / length
    if block.zone == "out" or (block.zone == "head" and not block.heading):
        return "bad"
    if block.zone in ("in", "head"):
        return "bad" if density > MAIN_LINK_DENSITY else "good"
    if density > LINK_DENSITY or "©" in block.text:
        return "bad"
    if length < SHORT:
        return "short" if not block.linked else "bad"
    words = block.text.lower().split()
    stops = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)
    if stops >= STOP_HIGH:
        return "good" if length > LONG else "near"
    return "near" if stops >= STOP_LOW else "bad"


def second_pass(labels: list[str]) -> list[bool]:
    """Open blocks inherit from the nearest decided blocks before and after."""
    before, after, last = [], [], "bad"
    for x in labels:
        before.append(last)
        last = x if x in ("good", "bad") else last
    last = "bad"
    for x in reversed(labels):
        after.append(last)
        last = x if x in ("good", "bad") else last
    after.reverse()
    kept = []
    for x, b, a in zip(labels, before, after):
        both, any_good = b == a == "good", "good" in (b, a)
        kept.append(x == "good" or (x == "near" and any_good) or (x == "short" and both))
    return kept


def main_text(html: str | None) -> str:
    if not html:
        return ""
    found = blocks(html)
    labels = [first_pass(b) for b in found]
    kept = second_pass(labels)
    for i in reversed(range(len(found) - 1)):  # an open heading belongs to what follows it
        if found[i].heading and labels[i] == "short" and kept[i + 1]:
            kept[i] = True
    return "\n\n".join(b.text for b, k in zip(found, kept) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
