"""Main text of HTML pages by two passes over text blocks.

A page is cut into blocks at block-level tags. The first pass labels a block by where it stands (menus, forms, adverts,
comments and the like are out), by its link density, its length and its density of stop words. Blocks that this does
not decide, mostly short ones and headings, then take the label of the nearest decided block; inside an article, of the
nearest decided block of that article. Blocks that are out by their place say nothing about their neighbours, which differ in
place; a block with no decided neighbour is good: nothing speaks against it.

Broken markup never fails: unclosed tags end with their parent, a closing tag without an opening one is ignored, a tag
that never ends is text. A null page counts as empty: empty text, no blocks. Rows with null or repeated ids give one
result each. An empty table gives an empty result. Nothing is cut by length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from liftline.llm.frames import column

SHORT, LONG = 70, 200
LINKED, STOP_LOW, STOP_HIGH = 0.5, 0.08, 0.16

#: Very frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from has have he in is it its not of on or she that the they this to was were which will with you "
    "aber als am auch auf aus bei das dem den der des die ein eine einen einer er es für hat ich im in ist mit nach nicht oder sich sie sind so und von war wie wird zu zum "
    "au aux avec ce ces dans de des du elle en est et il la le les leur mais ne ou par pas pour qu que qui sa se ses son sur un une "
    "al como con de del el en es está la las lo los más no o para pero por que se ser sin su sus un una y".split())

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUT_TAGS = frozenset("aside button datalist dialog fieldset footer form head menu nav search select title".split())
OUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
OUT_NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs captcha comment comments consent cookie cookies disclaimer disqus footer "
    "gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification optin outbrain pager pagination paywall popup promo promotion "
    "recommended recommendations related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola toolbar widget widgets".split())
#: Names that say what the rest of the page has, not what this element is.
HAS_NAMES = frozenset("has with without no".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|svg|math|iframe|object|canvas|audio|video|noframes)\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attributes>(?>\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>"
    r"|<[!?][^>]*+>", re.S | re.I)
_NAME = re.compile(r"\b(class|id|role|aria-hidden|hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_WORD = re.compile(r"\w+")


@dataclass
class Block:
    text: str
    linked: int
    out: bool
    article: int  # number of the article around it, 0 for none
    heading: bool
    item: bool  # of a list
    label: str = field(default="")


@dataclass
class _Open:
    tag: str
    out: bool
    article: int
    item: bool


def _is_out(tag: str, attributes: str, inside: bool) -> bool:
    if tag in OUT_TAGS or tag == "header" and not inside:
        return True
    if not attributes.strip(" /"):
        return False
    for m in _NAME.finditer(attributes):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if name == "hidden" and m.start() and attributes[m.start() - 1].isspace() or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role" and value.lower() in OUT_ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name in ("class", "id"):
            for one in value.split():
                parts = {p.lower() for p in _PART.findall(one)}
                if parts & HAS_NAMES:
                    continue
                bad = parts & OUT_NAMES
                if tag in ("html", "body", "main") or inside and bad == {"header"}:
                    continue
                if bad and (tag != "article" or bad & {"comment", "comments", "ad", "ads", "advert", "sponsored", "promo"}):
                    return True
    return False


def blocks(page: str) -> list[Block]:
    """The blocks of a page, in order, without labels."""
    found: list[Block] = []
    stack: list[_Open] = [_Open("", False, 0, False)]
    pieces: list[str] = []
    state = {"linked": 0, "articles": 0}
    links = headings = 0

    def flush() -> None:
        nonlocal pieces
        text = " ".join("".join(pieces).split())
        if text:
            top = stack[-1]
            found.append(Block(text, state["linked"], top.out, top.article, headings > 0, top.item))
        pieces, state["linked"] = [], 0

    def say(raw: str) -> None:
        if raw:
            text = html.unescape(raw)
            pieces.append(text)
            if links:
                state["linked"] += len("".join(text.split()))

    at = 0
    for m in _TOKEN.finditer(page):
        say(page[at:m.start()])
        at = m.end()
        if not (tag := m["tag"]):
            if m["raw"]:
                pieces.append(" ")
            continue
        tag = tag.lower()
        if tag in ("br", "wbr", "img", "hr") or tag in VOID:
            if tag == "hr":
                flush()
            elif tag != "wbr":
                pieces.append(" ")
            continue
        if m["close"]:
            if tag == "a":
                links = 0
                continue
            if tag not in BLOCKS and tag != "button":
                for i in range(len(stack) - 1, 0, -1):  # an inline element that is out ends here
                    if stack[i].tag in BLOCKS:
                        break
                    if stack[i].tag == tag:
                        flush()
                        del stack[i:]
                        break
                continue
            flush()
            links = 0
            if tag in HEADINGS:
                headings = 0
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag == "a":
            links = 1
            continue
        top = stack[-1]
        out = top.out or _is_out(tag, m["attributes"], top.article > 0)
        if tag in BLOCKS:
            flush()
            links = 0
            if tag == "p" or tag in HEADINGS:
                headings = int(tag in HEADINGS)
                if top.tag == "p" or top.tag in HEADINGS:  # these end where the next begins
                    stack.pop()
                    top = stack[-1]
                    out = top.out or _is_out(tag, m["attributes"], top.article > 0)
            elif tag in ("li", "dt", "dd", "option") and top.tag == tag:
                stack.pop()
                top = stack[-1]
                out = top.out or _is_out(tag, m["attributes"], top.article > 0)
            article = top.article
            if tag in ("article", "main") and not article:
                state["articles"] += 1
                article = state["articles"]
            stack.append(_Open(tag, out, article, top.item or tag in ("li", "dt", "dd")))
        elif out and not top.out:
            flush()
            stack.append(_Open(tag, True, top.article, top.item))
    say(page[at:])
    flush()
    return found


def first_pass(block: Block) -> str:
    """good, bad, or empty where the block alone does not decide."""
    if block.out:
        return "bad"
    size = len(block.text)
    density = block.linked / max(1, size - block.text.count(" "))
    if density > LINKED:
        return "" if block.article and not block.item else "bad"
    parts = _WORD.findall(block.text.lower())
    stops = sum(w in STOP_WORDS for w in parts) / max(1, len(parts))
    if block.heading:
        return ""
    if block.article:
        return "good" if size >= SHORT or stops >= STOP_LOW else ""
    if size < SHORT:
        return "bad" if density > LINKED / 2 else ""
    if stops >= STOP_HIGH:
        return "good"
    if stops >= STOP_LOW:
        return "good" if size >= LONG else ""
    return "" if size >= LONG else "bad"


def second_pass(found: list[Block]) -> None:
    """Undecided blocks take the label of the nearest decided block, as far as they may look; a heading first of what follows."""
    n = len(found)
    label = [b.label for b in found]
    before: list[int | None] = [None] * n
    after: list[int | None] = [None] * n
    for order, near in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: dict[int, int] = {}  # by article
        for i in order:
            near[i] = last.get(found[i].article)
            if label[i] and not found[i].out:
                last[found[i].article] = i
    for i, b in enumerate(found):
        if label[i]:
            continue
        left, right = before[i], after[i]
        if left is None and right is None:
            b.label = "good"
        elif left is None or right is None:
            b.label = label[right if left is None else left]
        elif b.heading or right - i < i - left:
            b.label = label[right]
        elif right - i > i - left:
            b.label = label[left]
        else:
            b.label = "good" if "good" in (label[left], label[right]) else "bad"


def extract(page: str | None) -> tuple[str, int, int]:
    """Main text, number of blocks, number of blocks kept."""
    found = blocks(page or "")
    for b in found:
        b.label = first_pass(b)
    second_pass(found)
    kept = [b.text for b in found if b.label == "good"]
    return "\n".join(kept), len(found), len(kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [extract(x.as_py()) for x in batch.column(2)]
        texts, n, kept = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(kept, pa.int64())],
            names=["page", "url", "text", "n_blocks", "n_kept"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page, url, text (kept blocks joined by line ends), n_blocks, n_kept."""
    rows = pages.select(column(pages, id_col).alias("page"), column(pages, url_col).alias("url"), column(pages, html_col).alias("html"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(_extract, f"page {kinds['page']}, url {kinds['url']}, text string, n_blocks long, n_kept long")
