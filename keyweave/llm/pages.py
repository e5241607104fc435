"""Main text of web pages by two-pass block rules.

A page is cut into blocks of text.  The first pass decides each block by what it is made of: its
length, the share of stop words in it, the share of its letters that are links, and what its
surrounding elements say they are.  Blocks that are too short to tell stay open; in the second pass
they take the label of the nearest decided blocks before and behind them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.llm.textkit import WIDE_SLICE, batch_of, map_batches, slices, texts_of

#: Frequent small words of six languages, a parameter of the rules.
STOP_WORDS = frozenset(
    """a and are as at be been but by for from had has have he his in is it its not of on or that the their they this to was were which will with you
    aber als auch auf aus bei das dass dem den der des die ein eine einer es für hat ich im ist mit nach nicht sich sie sind um und von war wie wird zu zum zur
    au aux avec ce ces dans de du elle en est et il je la le les leur mais ne nous ou par pas plus pour que qui sa se son sur un une vous
    al como con cuando del el era esta este fue ha hay las lo los más muy no para pero por porque su sus también una y ya
    che della di gli non per più si sono ao com da dos em foi mas não uma een het niet van""".split()
)

#: Elements whose content is never text of the page.
DROPPED = frozenset("script style noscript template iframe object embed svg canvas audio video map head title select option optgroup datalist button textarea label input legend dialog noembed noframes applet".split())
#: Of these, elements in which no markup is read up to their own end.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p pre blockquote body".split())
#: What ends an open paragraph, and which open element a start tag ends besides.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: Words of class, id and role: never the article, whatever stands inside; not the article unless it says so too; the article.
NEVER = frozenset("ad ads advert adverts advertisement advertisements advertising adsense adsbygoogle sponsor sponsored comment comments commentlist disqus replies cookie cookies consent gdpr popup modal overlay newsletter".split())
SELDOM = frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended share sharing social promo promotion banner subscribe signup login search pagination pager toolbar tabs notice alert contentinfo complementary".split())
OFTEN = frozenset("article main content post entry story body text".split())
MAIN = frozenset("article main".split())
APART = {"nav", "aside", "footer", "header", "menu"}

#: The rules' measures: letters of a short and of a long block; shares of stop words; share of linked letters; letters between a heading and its text.
SHORT, LONG, STOP_LOW, STOP_HIGH, LINKED, HEADING_REACH = 70, 200, 0.06, 0.12, 0.4, 400
#: Phrases of notices, in short blocks outside an article.
NOTICE = re.compile(r"©|\(c\) ?\d{4}|copyright|all rights reserved|cookie|privacy policy|terms of (?:use|service)|subscribe|sign (?:up|in)|log ?in\b", re.I)

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"'=]|=\s*(?:\"[^\"]*\"|'[^']*')?|[\"'])*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?(?=[\s/]|\Z)", re.I)
_HINT = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[^\W\d_]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

GOOD, BAD, OPEN, NEAR = "good", "bad", "open", "near"


@dataclass(slots=True, eq=False)
class Scope:
    """An element that says what it holds: the article (main), perhaps the article (often), never, seldom, a form, or hidden."""

    kind: str
    main: bool = False


@dataclass(slots=True)
class Block:
    text: str
    linked: int
    tag: str
    scopes: tuple[Scope, ...]
    label: str = OPEN


@dataclass(slots=True)
class _Reader:
    """Collects the text of the block being read."""

    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def close(self, tag: str, scopes: list[tuple[str, Scope | None]]) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(text, min(self.linked, len(text)), tag, tuple(s for _, s in scopes if s)))
            self.parts.clear()
        self.linked = 0


def _scope(tag: str, attributes: str) -> Scope | None:
    said: set[str] = set()
    for name, value in _ATTRIBUTE.findall(attributes) if attributes and not attributes.isspace() else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" and value.lower() != "until-found" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            return Scope("hidden")
        if name in ("class", "id", "role"):
            said.update(_HINT.findall(_CAMEL.sub("-", value).lower()))
    if tag in ("html", "body"):
        return None
    if said & NEVER and not (tag in MAIN and said & OFTEN and not said & {"comment", "comments"}):
        return Scope("never")
    if tag in MAIN or "main" in said or "article" in said and not said & SELDOM:
        return Scope("main", True)
    if tag in APART or said & SELDOM and not said & OFTEN:
        return Scope("seldom")
    return Scope("form") if tag == "form" else Scope("often") if said & OFTEN else None


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order; tags that are left open or cut off, and stray ends, do no harm."""
    reader, stack, at = _Reader(), [], 0
    dropped, links = 0, 0
    paragraph = "body"

    def say(raw: str) -> None:
        nonlocal links
        if raw and not dropped:
            text = html.unescape(raw) if "&" in raw else raw
            reader.parts.append(text)
            if links:
                reader.linked += len(" ".join(text.split()))

    def leave(depth: int) -> None:
        nonlocal dropped, links
        for name, _ in stack[depth:]:
            dropped -= name in DROPPED
            links -= name == "a"
        del stack[depth:]

    while True:
        found = _TOKEN.search(page, at)
        say(page[at : found.start() if found else len(page)])
        if not found:
            break
        at = found.end()
        if not found[2]:
            continue
        tag, ends, whole = found[2].lower(), bool(found[1]), found[0].endswith(">")
        if not whole:
            break
        if tag in BLOCKS:
            reader.close(paragraph, stack)
            paragraph = "body" if ends else tag
        if ends:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if depth >= 0:
                leave(depth)
                if tag in BLOCKS:
                    paragraph = next((n for n, _ in reversed(stack) if n in BLOCKS), "body")
            continue
        if tag == "br":
            # one line break is white space, more in a row end the block
            reader.parts.append("\n")
            if _breaks(page, at):
                reader.close(paragraph, stack)
            continue
        if tag in VOID:
            continue
        if tag in BLOCKS:
            for i in range(len(stack) - 1, -1, -1):
                name = stack[i][0]
                if name == "p" or name in SIBLINGS.get(tag, ()):
                    leave(i)
                    break
                if name in BLOCKS and name not in HEADINGS:
                    break
        if tag == "a":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "a":
                    leave(i)
                    break
                if stack[i][0] in BLOCKS:
                    break
        if tag == "body" and dropped:
            leave(0)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if tag == "xmp" and not dropped:
                reader.parts.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
            continue
        if found[3].rstrip().endswith("/") and tag in ("svg", "path", "use"):
            continue
        scope = _scope(tag, found[3])
        if scope and scope.main:
            for _, outer in stack:
                if outer:
                    outer.main = True
        stack.append((tag, scope))
        dropped += tag in DROPPED
        links += tag == "a"
    reader.close(paragraph, stack)
    return reader.blocks


_BREAK = re.compile(r"\s*<br\b[^>]*>", re.I)


def _breaks(page: str, at: int) -> bool:
    return _BREAK.match(page, at) is not None


def _place(block: Block) -> str:
    """Where a block stands: never, apart, main or plain."""
    main = False
    for scope in block.scopes:
        if scope.kind in ("never", "hidden"):
            return "never"
        if scope.kind == "main":
            main = True
        elif not scope.main and (scope.kind == "seldom" or scope.kind == "form"):
            # a header of the article is part of it; what else stands apart isn't, inside the article too
            if not (main and scope.kind == "seldom" and block.tag in HEADINGS):
                return "apart"
    return "main" if main else "plain"


def _likely_main(page: list[Block]) -> None:
    """Where no element is the article, the innermost one that may be and holds over half of the page's text is taken for it."""
    sizes: dict[Scope, int] = {}
    whole = 0
    for block in page:
        if _place(block) == "plain":
            whole += len(block.text)
            for scope in block.scopes:
                if scope.kind == "often":
                    sizes[scope] = sizes.get(scope, 0) + len(block.text)
    fitting = [s for s, n in sizes.items() if 2 * n > whole]
    if fitting:
        fitting[-1].kind = "main"


def first_pass(page: list[Block]) -> None:
    """Labels each block by itself: stop-word density, length, link density, and the elements around it."""
    if not any(_place(b) == "main" for b in page):
        _likely_main(page)
    places = [_place(b) for b in page]
    inside = "main" in places
    for block, place in zip(page, places, strict=True):
        text, size = block.text, len(block.text)
        density = block.linked / size
        heading = block.tag in HEADINGS
        if place in ("never", "apart") or inside and place != "main":
            block.label = BAD
        elif density > LINKED and not (inside and (heading or block.tag == "p")):
            block.label = BAD
        elif inside:
            block.label = GOOD if size >= LONG or not block.linked else OPEN
        elif size < LONG and NOTICE.search(text):
            block.label = BAD
        elif size < SHORT:
            block.label = BAD if block.linked and density > 0.2 else OPEN
        else:
            words = _WORD.findall(text.lower())
            share = sum(map(STOP_WORDS.__contains__, words)) / len(words) if words else 0.0
            if share >= STOP_HIGH:
                block.label = GOOD if size >= LONG else NEAR
            elif share >= STOP_LOW:
                block.label = NEAR
            else:
                block.label = OPEN if not heading and size >= LONG and not block.linked else BAD


def second_pass(page: list[Block]) -> None:
    """Open blocks take the label of both decided neighbours; where these differ, of the one that is the same element, or else of the nearest.

    Nearly good blocks are good beside good ones, between a good and a bad one only if they are prose; a heading goes with the text that it
    is soon followed by.
    """
    inside = any(_place(b) == "main" for b in page)
    decided = [b.label if b.label in (GOOD, BAD) else None for b in page]
    near = [b.label == NEAR for b in page]
    edge = GOOD if inside else BAD
    before, behind = _nearest(page, decided, edge, 1), _nearest(page, decided, edge, -1)[::-1]
    if not inside and GOOD not in decided:
        # a page of short blocks alone: what nothing speaks against is its text
        alone = BAD not in decided
        for block, close in zip(page, near, strict=True):
            if block.label != BAD:
                block.label = GOOD if alone or close or block.tag in HEADINGS or block.tag in PROSE else BAD
        return
    for i, block in enumerate(page):
        if decided[i]:
            continue
        (label_before, far_before, tag_before), (label_behind, far_behind, tag_behind) = before[i], behind[i]
        if near[i]:
            beside = {t for x, t in ((label_before, tag_before), (label_behind, tag_behind)) if x == GOOD}
            block.label = GOOD if beside and (BAD not in (label_before, label_behind) or block.tag in beside or block.tag in PROSE or block.tag in HEADINGS) else BAD
        elif block.tag in HEADINGS and label_behind == GOOD and _reaches(page, decided, i):
            block.label = GOOD
        elif label_before == label_behind:
            block.label = label_before
        elif (block.tag == tag_before) != (block.tag == tag_behind):
            block.label = label_before if block.tag == tag_before else label_behind
        else:
            block.label = label_before if far_before < far_behind else label_behind if far_behind < far_before else BAD


def _nearest(page: list[Block], decided: list[str | None], edge: str, step: int) -> list[tuple[str, int, str]]:
    """(label, distance in blocks, element) of the decided block before each one, or behind it from the end on."""
    out, label, far, tag = [], edge, 1, ""
    for block, now in zip(page[::step], decided[::step], strict=True):
        out.append((label, far, tag))
        label, far, tag = (now, 1, block.tag) if now else (label, far + 1, tag)
    return out


def _reaches(page: list[Block], decided: list[str | None], i: int) -> bool:
    letters = 0
    for j in range(i + 1, len(page)):
        if decided[j] == GOOD:
            return True
        letters += len(page[j].text)
        if decided[j] == BAD or letters > HEADING_REACH:
            return False
    return False


def main_text(page: str | None) -> tuple[str, int, int]:
    """(the article, blocks of the page, blocks kept)."""
    found = blocks(page) if page else []
    if not found:
        return "", 0, 0
    first_pass(found)
    second_pass(found)
    kept = [b.text for b in found if b.label == GOOD]
    return "\n\n".join(kept), len(found), len(kept)


def extract_pages(pages: DataFrame, id_column: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_kept) of every page, without a shuffle.

    A null or empty page, and one without an article, has the empty text.  Repeated rows stay rows; ids
    and addresses may be null; other columns aren't read; an empty table gives an empty result.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_blocks", pa.int64()), ("n_kept", pa.int64())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, _ = texts_of(batch, "html")
            for i, j in slices(offsets, WIDE_SLICE):
                part = batch.slice(i, j - i)
                found = [main_text(x) for x in part.column(2).to_pylist()]
                yield batch_of(schema, page_id=part.column(0), url=part.column(1), text=[t for t, _, _ in found], n_chars=[len(t) for t, _, _ in found], n_blocks=[n for _, n, _ in found], n_kept=[k for _, _, k in found])

    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(source).cast("string").alias("html"))
    return map_batches(rows, extract, "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long")
