"""Main text of web pages by two-pass block rules.

The page is cut into blocks at block-level tags. Pass one decides a block by the
region it lies in, its link density, its length and its density of stop words;
short blocks without evidence stay open. Pass two gives an open block the label
of its nearest decided neighbours.

A region counts by its tag (nav, footer, ...) or by a name that says nothing else:
``comment-list`` does, ``share-price`` and ``with-sidebar`` don't. A named region or
form that holds the page's heading and most of its dense text is no such region.
In a language without a stop list, long blocks count as dense by their sentences.

Cases: a null or empty page gives an empty text; a script, style or comment that never
closes ends with the page, other markup that never closes where it can't go on (a head
at the body's first tag or text, a link with its block, a list of options at the next
block); unknown or cut character references stay as they are, as HTML has it; repeated
rows are repeated; very long pages are read whole; other columns are not looked at.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tags that start or end a block.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td "
    "textarea tfoot th thead title tr ul".split()
)
# Tags whose content is never text: up to their end tag or the page's end; only with an end tag; up to a tag that they can't hold.
RAW = ("script", "style", "title", "textarea", "iframe")
CLOSED = ("noscript", "template", "svg", "math", "object", "canvas")
LOOSE = ("select", "button")
# Regions that hold no article text.
ASIDE_TAGS = frozenset("nav header footer aside form menu dialog".split())
# Void tags, which never hold anything.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words in class, id or role that name such regions, and words that may stand beside them in one name.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header menu "
    "modal nav navbar navigation newsletter notice notices pagination popup promo promoted related replies share sharing sidebar signup social "
    "sponsor sponsored subscribe subscription toc toolbar widget complementary contentinfo search login alert".split()
)
PART_WORDS = frozenset(
    "area article articles bar block bottom box btn button buttons column container content desktop feed fixed form group icons inner item items label left "
    "links list main message mobile module news outer page pages panel policy post posts primary reader right row secondary section site slot stories thread top "
    "unit user wrap wrapper".split()
)
# End tags that may be left out, with the start tags that stand for them.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Frequent function words of the languages that are expected.
STOP_WORDS = frozenset(
    "the of and to in is that it for was on are as with be by this at from or have not but they which you all were there "
    "de la le les des et en un une du que qui dans pour sur pas au avec par est ce il se ne plus "
    "el los las una del y por con para su al lo como más pero sus no es ha si o "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch an werden aus er hat dass sie nach bei".split()
)

LONG, SHORT, DENSE, SOME, LINKS = 200, 70, 0.30, 0.12, 0.5
UNLISTED = 0.06  # share of stop words on a page below which no list fits its language
SENTENCE = 300  # characters for each end of a sentence, at most, in prose

# A head ends at </head> or, as that may be left out, at text or the first tag that can't stand in it.
_HEAD = (
    r"<head(?=[\s/>])[^>]*>(?:\s+|<!--.*?(?:-->|\Z)|<[!?][^>]*>|</(?!(?:head|body|html)\b)[^>]*>|"
    r"<(script|style|noscript|template|title|noframes)\b[^>]*>.*?(?:</\2\s*>|\Z)|"
    r"<(?:base|basefont|bgsound|link|meta)\b(?:(?:[^>\"']|\"[^\"]*\"|'[^']*')*>|[^>]*>))*(?:</head\s*>)?"
)
_SILENT_RE = re.compile(
    rf"({_HEAD})|<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|"
    rf"<({'|'.join(RAW)})\b[^>]*>.*?(?:</\3\s*>|\Z)|<({'|'.join(CLOSED)})\b[^>]*>.*?</\4\s*>|"
    rf"<({'|'.join(LOOSE)})\b[^>]*>(?:[^<]|<(?!/?(?:p|article|section|main|h[1-6]|ul|ol|table|form|body|html|{'|'.join(LOOSE)})\b))*(?:</\5\s*>)?",
    re.S | re.I,
)
_TAG_RE = re.compile(r"<(?:(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\s(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)?/?)(?:>|\Z)|[!?][^>]*(?:>|\Z))")
_ATTR_RE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HREF_RE = re.compile(r"\bhref\s*=", re.I)
_NAME_RE = re.compile(r"[^\W_]+")
_SENTENCE_RE = re.compile(r"[.!?。！？।؟…](?=[\s\"'»”)\]]|$)|[。！？।]")
_EDGE = ".,;:!?\"'()[]«»…#*%$&@+-–—/|"


def blocks(page: str) -> tuple[list[list], dict[int, bool]]:
    """[text, link characters, in an aside tag, named regions, in an article, heading] of each block; whether each region holds the page's heading."""
    page = _SILENT_RE.sub(lambda m: "<p>" if m[1] or any(m.group(3, 4, 5)) else " ", page)
    found: list[list] = []
    regions: dict[int, bool] = {}
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, tuple, bool]] = []  # open containers: tag, and the state before it
    aside, names, article = False, (), False
    in_link = closed_link = heading = False

    def close() -> None:
        nonlocal linked, in_link
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append([text, linked, aside, names, article, heading])
            parts.clear()
        linked = 0
        in_link = in_link and closed_link

    def leave(tags: set[str]) -> None:
        nonlocal aside, names, article
        while stack:
            name, aside, names, article = stack.pop()
            if name in tags:
                return

    def enter(tag: str, by_tag: bool, by_name: bool) -> None:
        nonlocal aside, names, article
        stack.append((tag, aside, names, article))
        aside, article = aside or by_tag, article or tag in ("article", "main")
        if by_name:
            regions[len(regions)] = False
            names = (*names, len(regions) - 1)

    tags = [m for m in _TAG_RE.finditer(page)]
    links = [(i, m[1]) for i, m in enumerate(tags) if (m[2] or "").lower() == "a"]
    ends = {i for (i, _), (_, end) in zip(links, links[1:], strict=False) if end}  # links whose end tag comes before another link
    at = 0
    for i, m in enumerate(tags):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag == "a":
            in_link = not m[1] and bool(_HREF_RE.search(m[3] or ""))
            closed_link = i in ends
            continue
        named = not m[1] and bool(m[3]) and "=" in m[3] and tag not in VOID and tag not in ("body", "html", "article", "main") and _named_aside(m[3])
        if tag not in BLOCK_TAGS:
            if named:
                close()
                enter(tag, False, True)
            elif m[1] and any(x[0] == tag for x in stack):
                close()
                leave({tag})
            continue
        close()
        heading = not m[1] and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
        if tag in ("h1", "main") and not m[1]:
            regions.update((r, True) for r in names)
        if tag in VOID:
            continue
        if m[1]:
            if any(x[0] == tag for x in stack):
                leave({tag})
            continue
        if stack and (stack[-1][0] == "p" or stack[-1][0] in IMPLIED.get(tag, ())):
            leave({stack[-1][0]})
        by_tag = tag in ASIDE_TAGS and tag != "form" and not (tag == "header" and article)
        named = named or tag == "form"
        if tag not in ("p", "li", "td", "tr", "th", "dd", "dt", "option") or by_tag or named:
            enter(tag, by_tag, named)
    if at < len(page):
        rest = page[at:]
        cut = re.search(r"<(?=[a-zA-Z/!?])", rest)  # a tag that the page's end cuts off
        parts.append(rest[: cut.start()] if cut else rest)
    close()
    return found, regions


def _named_aside(attributes: str) -> bool:
    """Whether a class, id or role is made of an aside's words and neutral ones alone."""
    for value in _ATTR_RE.findall(attributes):
        for name in next(filter(None, value), "").split():
            words = {w.lower() for w in _NAME_RE.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name)) if not w.isdigit()}
            if words & ASIDE_WORDS and words <= ASIDE_WORDS | PART_WORDS and not ("header" in words and words & {"article", "post", "page", "content", "main"}):
                return True
    return False


def density(text: str) -> float:
    """Share of stop words."""
    words = text.lower().split()
    return sum(w.strip(_EDGE) in STOP_WORDS for w in words) / len(words)


def prose(text: str) -> float:
    """In a language without a list: dense where a long block has sentences, some where a shorter one ends as one."""
    ends = len(_SENTENCE_RE.findall(text))
    return DENSE if len(text) >= LONG and ends * SENTENCE >= len(text) else SOME if ends else 0.0


def first_pass(block: list, aside: bool, dense: float) -> bool | None:
    """True for article text, False for the rest, None where the block alone doesn't tell."""
    text, linked, _, _, article, heading = block
    n = len(text)
    if aside:
        return False
    if linked > LINKS * n or n < LONG and text.startswith("©"):
        return False
    if heading or n < SHORT:
        return None
    if article and n >= LONG or dense >= DENSE or dense >= SOME and n >= LONG:
        return True
    return None if article or dense >= SOME else False


def labelled(found: list[list], regions: dict[int, bool]) -> list[bool | None]:
    """Labels of the first pass, once it is known which named regions count."""
    open_ = [not b[2] and b[1] <= LINKS * len(b[0]) and len(b[0]) >= SHORT for b in found]
    dense = [density(b[0]) if o else 0.0 for b, o in zip(found, open_, strict=True)]
    size = sum(len(b[0]) for b, o in zip(found, open_, strict=True) if o)
    if sum(d * len(b[0]) for b, d in zip(found, dense, strict=True)) < UNLISTED * size:
        dense = [max(d, prose(b[0])) if o else 0.0 for b, d, o in zip(found, dense, open_, strict=True)]
    held = dict.fromkeys(regions, 0)
    total = 0
    for b, d in zip(found, dense, strict=True):
        if d >= SOME and len(b[0]) >= LONG:
            total += len(b[0])
            for r in b[3]:
                held[r] += len(b[0])
    real = {r for r, heads in regions.items() if not (heads and 2 * held[r] > total)}
    return [first_pass(b, b[2] or not real.isdisjoint(b[3]), d) for b, d in zip(found, dense, strict=True)]


def main_text(page: str | None) -> str:
    """The article's blocks, white space collapsed, joined by one space."""
    if not page:
        return ""
    found, regions = blocks(page)
    labels = labelled(found, regions)
    n = len(found)
    before, after = [None] * n, [None] * n
    last = None
    for i in range(n):
        before[i] = last
        last = i if labels[i] is not None else last
    last = None
    for i in reversed(range(n)):
        after[i] = last
        last = i if labels[i] is not None else last
    out = []
    for i, (text, _, _, _, article, heading) in enumerate(found):
        label = labels[i]
        if label is None:
            b, a = before[i], after[i]
            # An aside region is no neighbour of a block inside an article, or the reverse.
            if article:
                b, a = (x if x is not None and found[x][4] and not found[x][2] and not (found[x][3] and labels[x] is False) else None for x in (b, a))
            if b is None and a is None:
                label = article
            elif b is None or a is None:
                label = labels[a if b is None else b]
            elif labels[a] == labels[b]:
                label = labels[a]
            elif heading or a - i < i - b:
                label = labels[a]
            elif i - b < a - i:
                label = labels[b]
            else:
                label = article
        if label:
            out.append(text)
    return " ".join(out)


def _extract(batches):
    for batch in batches:
        ids, urls, pages = batch.columns
        texts = [main_text(x.as_py()) for x in pages]
        yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
