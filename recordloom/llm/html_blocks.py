"""Text blocks of web pages, and the main text by two passes of block rules."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import text_batches

TAG = re.compile(
    r"<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+|[^<>]*+)>|<[!?][^<>]*+>",
    re.DOTALL,
)
#: Elements whose text is never shown.
HIDDEN = frozenset("script style noscript template head iframe object svg math canvas audio video select option datalist textarea button".split())
RAW = frozenset("script style textarea noscript iframe title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul title".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT = frozenset("article main".split())
#: Elements whose end may be left out: open ones that a new one ends, and what these lie in at most.
ROWS, CELLS, GROUPS = frozenset(["tr"]), frozenset("td th".split()), frozenset("thead tbody tfoot caption".split())
TERMS, PASSED = frozenset("dt dd".split()), frozenset("address div p".split())
ENDED = {
    "li": (frozenset(["li"]), BREAKS - PASSED - {"li"}),
    **dict.fromkeys(TERMS, (TERMS, BREAKS - PASSED - TERMS)),
    "option": (frozenset(["option"]), frozenset("select datalist".split())),
    **dict.fromkeys(CELLS, (CELLS, frozenset("tr table".split()))),
    "tr": (ROWS | CELLS, frozenset(["table"])),
    **dict.fromkeys(GROUPS, (GROUPS | ROWS | CELLS, frozenset(["table"]))),
}
#: Elements and words of class, id or role that mark what is not the article.
ASIDES = frozenset("nav footer aside menu dialog".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent "
    "cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices "
    "notification pagination pager popup promo promoted related reply replies respond share sharing sidebar signup skip social "
    "sponsor sponsored subscribe subscription toolbar widget complementary contentinfo search".split()
)
#: Words of these never name a wrapper of the whole page, so such a mark stands.
FIRM_WORDS = frozenset(
    "breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr menu modal nav navbar navigation "
    "newsletter notification pagination pager popup reply replies respond".split()
)
#: A name that holds one of these tells of an aside elsewhere, or that there is none.
NEGATIONS = frozenset("no not has have with without free off".split())
#: A header that is named after one of these belongs to the article.
ARTICLE_WORDS = frozenset("article content entry post story".split())
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style|lang|href|name|content|charset)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
PARTS = re.compile(r"[a-z0-9]+")
OTHER = re.compile("[\u0370-\u1dff\u1f00-\u1fff\u2c00-\ud7af\uf900-\ufdff\ufe70-\ufeff\uff66-\uffdc]+")
WIDE = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af]+")
#: Common words of some languages, fixed lists.
STOP_WORDS = frozenset(
    (
        "a about after all an and are as at be been but by can for from had has have he her his i if in into is it its more no "
        "not of on one or our she so that the their them there they this to was we were what when which who will with you your "
        "aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer es für hat ich im in "
        "ist mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was wie wird wir zu zum zur "
        "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou où par pas plus pour "
        "qu que qui sa se ses son sont sur un une vous à été "
        "al como con de del el en era es esta este ha la las lo los más me mi muy no nos o para pero por que se ser si sin "
        "sobre su sus un una y ya"
    ).split()
)
MAX_LINK_DENSITY, SHORT_CHARS, LONG_CHARS = 0.33, 70, 200
STOP_LOW, STOP_HIGH = 0.20, 0.30
#: OUT is what its place alone excludes; such a block is no neighbour to inherit from.
GOOD, BAD, NEAR, SHORT, OUT = "good", "bad", "near", "short", "out"


@dataclass
class Block:
    """A block's text and what its place in the page says about it."""

    text: str
    linked: int
    heading: bool
    content: bool
    aside: bool
    mark: int = -1


@dataclass
class Mark:
    """An element that is marked as an aside: the marked one around it, whether its mark stands, the nearest such one."""

    around: int
    firm: bool
    nearest_firm: int
    holds_article: bool = False


@dataclass
class Page:
    title: str = ""
    language: str = ""
    blocks: list[Block] = field(default_factory=list)
    links: list[str] = field(default_factory=list)
    metas: list[tuple[str, str]] = field(default_factory=list)
    marks: list[Mark] = field(default_factory=list)


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in ATTRIBUTE.finditer(source)}


def _marking(tag: str, given: dict[str, str], content: bool) -> str:
    """How an element is marked as an aside: ``firm``, ``soft`` (it may turn out to wrap the page) or not at all.

    A class like ``no-sidebar``, ``has-sidebar`` or ``ad-free`` marks nothing, nor does
    the header of an article.
    """
    if tag in ASIDES or "hidden" in given or given.get("aria-hidden") == "true":
        return "firm"
    if re.search(r"display\s*:\s*none", given.get("style", "")):
        return "firm"
    if tag in ("body", "html") or tag in HEADINGS:
        return ""
    found, of_article = set(), False
    for name in " ".join(given.get(n, "") for n in ("class", "id", "role")).lower().split():
        # an article's class may tell what is beside it (with-sidebar), so only whole names count there
        parts = {name} if tag in CONTENT else set(PARTS.findall(name))
        if not NEGATIONS.isdisjoint(parts):
            continue
        words = parts & ASIDE_WORDS
        if words == {"header"} and not ARTICLE_WORDS.isdisjoint(parts):
            of_article = True
            continue
        found |= words
    if found:
        return "soft" if FIRM_WORDS.isdisjoint(found) else "firm"
    return "soft" if tag == "form" or (tag == "header" and not content and not of_article) else ""


def parse(source: str | None) -> Page:
    """The blocks of a page, with linked characters and marks; any markup is accepted.

    One pass over the tags, linear in the page.  Comments and hidden elements give no
    text; unclosed elements end with a sibling that HTML lets end them, with the element
    around them, however deep they lie in it, or with the page.
    """
    page, source = Page(), source or ""
    stack: list[tuple[str, int, bool, bool]] = []  # name, innermost mark, content, hidden
    places: dict[str, list[int]] = {}  # where in the stack each name is open
    words: list[str] = []
    linked, in_link, heading, at, size = 0, False, False, 0, len(source)
    link_block = 0  # blocks before the open link

    def top() -> tuple[str, int, bool, bool]:
        return stack[-1] if stack else ("", -1, False, False)

    def end_link() -> None:
        """End a link that lacks its end: what follows the block it starts in isn't linked."""
        nonlocal in_link, linked
        if in_link and len(page.blocks) > link_block:
            for block in page.blocks[link_block + 1 :]:
                block.linked = 0
            linked = 0
        in_link = False

    def cut(low: int) -> None:
        while len(stack) > low:
            places[stack.pop()[0]].pop()

    def last(names: frozenset[str]) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    def flush() -> None:
        nonlocal linked, heading
        text = " ".join("".join(words).split())
        words.clear()
        if text:
            _, mark, content, _ = top()
            page.blocks.append(Block(text, min(linked, len(text)), heading, content, mark >= 0, mark))
        linked = 0

    def add(low: int, high: int) -> None:
        nonlocal linked
        if low < high and not top()[3]:
            text = html.unescape(source[low:high])
            words.append(text)
            if in_link:
                linked += len(" ".join(text.split()))

    while at < size:
        found = TAG.search(source, at)
        if not found:
            add(at, size)
            break
        add(at, found.start())
        at = found.end()
        if not found[2]:
            continue
        tag, closing = found[2].lower(), bool(found[1])
        if tag in BREAKS:
            flush()
            heading = False
        elif tag == "br":
            words.append(" ")
        if closing:
            if tag == "a":
                in_link = False
            if places.get(tag):
                cut(places[tag][-1])
            continue
        given = attributes(found[3] or "") if found[3] else {}
        if tag in RAW:
            end = re.compile(rf"</{tag}", re.I).search(source, at)
            stop = end.start() if end else size
            if tag == "title" and not page.title:
                page.title = " ".join(html.unescape(source[at:stop]).split())
            at = stop
            if end:
                close = source.find(">", end.end())
                at = size if close < 0 else close + 1
            continue
        if tag == "a":
            end_link()
            if "href" in given:
                in_link, link_block = True, len(page.blocks)
            if given.get("href"):
                page.links.append(given["href"])
        if tag == "html":
            page.language = given.get("lang", "")
        if tag == "meta" and given:
            page.metas.append((given.get("name", "charset" if "charset" in given else ""), given.get("content", given.get("charset", ""))))
        if tag in HEADINGS:
            heading = True
        if tag in VOID or (found[3] or "").endswith("/"):
            continue
        if tag in BREAKS or tag in HIDDEN:
            if tag in ENDED:  # a new one ends an open one
                names, around = ENDED[tag]
                wall = last(around)
                cut(min((places[n][-1] for n in names if places.get(n) and places[n][-1] > wall), default=len(stack)))
            if stack and stack[-1][0] in ("p", *HEADINGS) and tag in ("p", "li", "td", "th", "dt", "dd", *HEADINGS):
                cut(len(stack) - 1)
            _, mark, content, hidden = top()
            if tag == "main" and mark >= 0:  # it holds the article, whatever a wrapper's class says
                mark = page.marks[mark].nearest_firm
            elif tag == "article":
                around = mark
                while around >= 0 and not page.marks[around].holds_article:
                    page.marks[around].holds_article = True
                    around = page.marks[around].around
            marking = _marking(tag, given, content)
            if marking:
                firm = marking == "firm"
                own = len(page.marks)
                page.marks.append(Mark(mark, firm, own if firm else page.marks[mark].nearest_firm if mark >= 0 else -1))
                mark = own
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, mark, content or tag in CONTENT, hidden or tag in HIDDEN))
            if tag in ("body", "article", "main"):
                end_link()
    flush()
    end_link()
    return page


def unwrap(page: Page) -> None:
    """Lift the marks of elements that turn out to wrap the page's text.

    Called if no block outside the asides is good.  A soft mark is lifted if its element
    holds an article or most of the text that is neither linked nor in a firm aside.
    """
    held = [0] * len(page.marks)
    total = 0
    for b in page.blocks:
        if b.mark < 0 or page.marks[b.mark].nearest_firm < 0:
            own = len(b.text) - b.linked
            total += own
            if b.mark >= 0:
                held[b.mark] += own
    standing = [-1] * len(page.marks)  # the nearest mark that stays, itself included
    for i in range(len(page.marks) - 1, -1, -1):
        if page.marks[i].around >= 0:
            held[page.marks[i].around] += held[i]
    for i, mark in enumerate(page.marks):
        lifted = not mark.firm and mark.nearest_firm < 0 and (mark.holds_article or 2 * held[i] > total)
        standing[i] = i if not lifted else standing[mark.around] if mark.around >= 0 else -1
    for b in page.blocks:
        b.aside = b.mark >= 0 and standing[b.mark] >= 0


def length(text: str) -> int:
    """Characters, those of scripts that write a word with one or two of them three times."""
    return len(text) if text.isascii() else len(text) + 2 * sum(map(len, WIDE.findall(text)))


def is_latin(text: str) -> bool:
    """Whether most of a text isn't in other letters than those of the stop-words' languages."""
    return text.isascii() or 2 * sum(map(len, OTHER.findall(text))) <= len(text)


def stop_density(text: str) -> float:
    words = text.lower().split()
    hits = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words)
    return hits / len(words) if words else 0.0


def first_pass(block: Block, told: bool = True) -> str:
    """A block's own class, by link density, length and density of stop-words.

    A place in the article is a prior: such a block is one class better than its words
    make it, and a short one nearly good.  Where stop-words tell nothing (``told`` is
    false: the prose hasn't its share of them, or the block isn't in Latin letters), it is
    good in the article if it isn't short, elsewhere if it is long.
    """
    if block.aside:
        return OUT
    density = block.linked / len(block.text)
    size = length(block.text)
    if density > MAX_LINK_DENSITY and not (block.content and size >= LONG_CHARS):
        return BAD
    if size < SHORT_CHARS:
        if block.content:
            return NEAR
        return BAD if block.linked else SHORT
    stops = stop_density(block.text)
    told = told and (stops >= STOP_LOW or is_latin(block.text))
    if block.content:
        return GOOD if stops >= STOP_LOW or not told else NEAR
    if stops >= STOP_HIGH or not told:
        return GOOD if size > LONG_CHARS else NEAR
    return NEAR if stops >= STOP_LOW else BAD


def second_pass(classes: list[str], headings: list[bool], content: list[bool] | bool = False) -> list[bool]:
    """Labels of all blocks: ambiguous ones take that of the nearest decided block.

    A tie goes to good for nearly good blocks and to bad for short ones, and a heading
    looks down the page first.  Without any decided block an ambiguous block is good:
    nothing speaks against it.

    On a page with an article, its blocks ask one another only: a heading is good if a
    good block follows, and all ambiguous ones are if none of its blocks is.  A short block
    outside is good between two good ones, a heading there above one; other blocks outside
    take the nearest label, and all of them are bad if nothing is decided.
    """
    size = len(classes)
    content = content or [False] * size
    far, marked = size + 1, True in content
    before, after = [(far, BAD)] * size, [(far, BAD)] * size
    for near, order in ((before, range(size)), (after, range(size - 1, -1, -1))):
        last_any = last_content = None
        for i in order:
            last = last_content if content[i] else last_any
            if classes[i] in (GOOD, BAD):
                last_any, last_content = i, i if content[i] else last_content
            elif last is not None:
                near[i] = (abs(i - last), classes[last])
    last_good = max((i for i in range(size) if content[i] and classes[i] == GOOD), default=None)
    out = []
    for i, c in enumerate(classes):
        (up, above), (down, below) = before[i], after[i]
        if c in (GOOD, BAD, OUT):
            out.append(c == GOOD)
        elif content[i] and last_good is None:
            out.append(True)
        elif content[i] and headings[i]:
            out.append(last_good > i)
        elif up == down == far:
            out.append(not marked)
        elif headings[i] and down < far:
            out.append(below == GOOD)
        elif marked and c == SHORT:
            out.append(above == below == GOOD)
        elif up == down:
            out.append(GOOD in (above, below) if c == NEAR else above == below == GOOD)
        else:
            out.append((above if up < down else below) == GOOD)
    return out


def classify(blocks: list[Block]) -> list[str]:
    """The first pass over all blocks.

    Stop-words are asked for if a block of the article has its share of them; without an
    article, if blocks with a quarter of the prose do.
    """
    prose = [b for b in blocks if not b.aside and length(b.text) >= SHORT_CHARS]
    inside = [b for b in prose if b.content]
    if inside:
        told = any(stop_density(b.text) >= STOP_LOW for b in inside)
    else:
        plain = [b for b in prose if b.linked <= MAX_LINK_DENSITY * len(b.text)]
        share = sum(len(b.text) for b in plain if stop_density(b.text) >= STOP_LOW)
        told = 4 * share >= sum(len(b.text) for b in plain)
    return [first_pass(b, told) for b in blocks]


def main_text(source: str | None) -> str:
    """The page's good blocks in page order, joined by newlines."""
    page = parse(source)
    blocks, classes = page.blocks, classify(page.blocks)
    if page.marks and GOOD not in classes:
        unwrap(page)
        classes = classify(blocks)
    keep = second_pass(classes, [b.heading for b in blocks], [b.content and not b.aside for b in blocks])
    return "\n".join(b.text for b, good in zip(blocks, keep, strict=True) if good)


def shown_text(page: Page) -> str:
    """All shown blocks, for a plain rendering of a page."""
    return "\n".join(b.text for b in page.blocks)


def extracted(pages: DataFrame, html_column: str = "html", text_column: str = "text") -> DataFrame:
    """Every row with the main text of its page added, empty if there is none.

    Null, empty and text-free pages give an empty text; equal pages give equal texts; a
    column of the added name is replaced.  Pages are read whole, one at a time.
    """

    @F.pandas_udf("string")
    def extract(sources):  # noqa: ANN001, ANN202
        return sources.map(lambda h: main_text(h).encode("utf-8", "replace").decode())

    return text_batches(pages).withColumn(text_column, extract(F.coalesce(F.col(html_column), F.lit(""))))
