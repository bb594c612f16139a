"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. Pass one decides each block by
itself: stop-word density, length and link density, the element it lies in
(navigation, forms, asides and the like are never main text) and the names that
``class``, ``id`` and ``role`` give that element; such names are set aside where
nothing else would be left. In scripts without spaces frequent characters count
in place of stop words. Short blocks stay open. In pass
two an open block takes the label of the nearest decided block, first of its own
article. On a page with an ``article`` or ``main`` element, blocks outside it are
not main text; inside it length alone can stand for stop words. That does not hold
if such elements have no main text (comments, for one), or less than the block
rules find beside them (teasers): then the block rules decide the whole page.

Cases: null html is empty; a page without blocks has empty text. Broken markup
never fails: unknown or unclosed tags are skipped (of an unclosed ``video``, ``svg``
and the like only the tag, not what follows), a tag cut off at the end of
the page is dropped. Repeated rows give repeated results; other columns than
``page_id``, ``url`` and ``html`` are left out.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reefline.llm.common import ship, slices

ship(__name__)

# Elements that end a block.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
# Elements whose content is no text of the page.
RAW = "script|style|noscript|template|textarea|title|iframe"
# The same, but these are parsed, may be nested, and hold nothing if they are never closed.
PARSED = frozenset("svg math object select canvas video audio".split())
FOREIGN = frozenset(["svg", "math"])  # may close themselves
# Elements that never hold main text.
OUTSIDE = frozenset("nav footer aside form menu dialog button label fieldset".split())
MAIN = frozenset(["article", "main"])
# Words in class, id and role that mark such elements.
NAMES = frozenset(
    "ad ads advert adverts advertisement alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo"
    " cookie cookies disqus footer form gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay"
    " pagination popup promo promoted promotion recommended related reply replies respond search share sharing shoutbox sidebar"
    " signup skip social sponsor sponsored sponsors subscribe subscription tags toolbar widget widgets".split()
)
# Frequent words of the languages at hand.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from has have he her his i in is it its not of on or she that the their they this to was we were which who will with you"
    " aber als am auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich im ist kann mit nach nicht noch nur oder sich sie sind über um und von vor war wie wird zu zum zur"
    " au aux avec ce cette dans de des du elle en est et il ils je la le les leur mais ne nous on ont ou par pas plus pour qu que qui sa se ses son sont sur un une vous"
    " al como con cuando del el ella entre era es esta este fue ha hay las lo los más me mi muy no o para pero por porque sin sobre su sus también tan te todo una y ya".split()
)
MANY_STOP_WORDS, SOME_STOP_WORDS = 0.30, 0.15
LONG, SHORT = 100, 70
MANY_LINKS = 0.33

# What stands between a tag's name and its end: names, each with a value in quotes or up to white space. A stray quote is a
# name, a quote that is never closed belongs to its value.
INSIDE_TAG = r"""(?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+|=)*+"""
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*+>.*?(?:</\1\s*+>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({INSIDE_TAG})(?:>|\Z)|<[!?][^>]*+(?:>|\Z)|</",
    re.S | re.I,
)
HAS_PARSED = re.compile(rf"<(?:{'|'.join(sorted(PARSED))})\b", re.I)
ATTRIBUTE = re.compile(r"""(=?[^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
TELLING = frozenset("class id role hidden aria-hidden".split())
# Parts of names that say what a container has, lacks or is about, not what it is.
SAYS_HAS = frozenset("has have with without no not is show hide".split())
CONTENT = frozenset("article post entry content story body text page".split())
# Characters that stand in most sentences of languages written without spaces.
COMMON_CHARACTERS = frozenset("的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之のにはをたがでてとしれさいるもなか")
UNSPACED = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]")
MANY_COMMON, SOME_COMMON, WIDE = 0.12, 0.05, 2.5  # shares of such characters; letters that one character stands for
WORD = re.compile(r"[^\W\d_]+")
ROOT = ("", False, False, 0)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


@dataclass
class Block:
    text: str
    links: float  # share of the letters inside links
    outside: bool
    named: bool  # outside by class, id or role alone
    article: int  # number of the article it lies in, 0 for none
    heading: bool
    label: str = "open"


def by_element(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is no main text by its kind, or because it is hidden."""
    if tag in OUTSIDE or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body", "main", "article"):
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        if name.lower() == "hidden" or (name.lower() == "aria-hidden" and "".join(values).lower() == "true"):
            return True
    return False


def by_name(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether class, id or role name an element as no main text."""
    if not attributes or tag in ("html", "body", "main"):
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        if name.lower() not in TELLING:
            continue
        for word in "".join(values).lower().split():
            # whole names only: articles list their topics here
            if word in NAMES or (tag != "article" and _names_boilerplate(word, in_article)):
                return True
    return False


def _names_boilerplate(word: str, in_article: bool) -> bool:
    """``main-nav``, ``comment-list`` and ``site-header-wrap`` are boilerplate; ``has-sidebar`` says what the element
    has, and ``article-share-count`` or ``entry-header`` belong to the article."""
    parts = [p for p in re.split(r"[^a-z]+", word) if p]
    if not parts or parts[0] in SAYS_HAS:
        return False
    if parts[0] in CONTENT:
        return len(parts) > 1 and parts[-1] in NAMES
    return not NAMES.isdisjoint(parts) or (not in_article and "header" in parts)


def closed(page: str) -> dict[int, int]:
    """Where each closed parsed element starts and ends."""
    out: dict[int, int] = {}
    if not HAS_PARSED.search(page):
        return out
    opened: dict[str, list[int]] = {tag: [] for tag in PARSED}
    for m in TOKEN.finditer(page):
        tag = (m[3] or "").lower()
        if tag not in PARSED:
            continue
        if m[2]:
            if opened[tag]:
                out[opened[tag].pop()] = m.end()
        elif tag in FOREIGN and m[4].endswith("/"):
            out[m.start()] = m.end()
        else:
            opened[tag].append(m.start())
    return out


def blocks_of(page: str) -> list[Block]:
    out: list[Block] = []
    parts: list[str] = []
    linked = depth_a = 0
    # open elements: name, inside boilerplate by kind, by name, article
    stack: list[tuple[str, bool, bool, int]] = []
    articles = 0
    heading = False

    def end_block() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            _, kind, name, article = stack[-1] if stack else ROOT
            out.append(Block(text, min(1.0, linked / len(text)), kind or name, name and not kind, article, heading))
        parts.clear()
        linked = 0

    def take(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if depth_a:
            linked += len(text.strip())

    at = 0
    skipped = closed(page)
    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            take(page[at : m.start()])
        at = skipped.get(m.start(), m.end())
        if at > m.end():
            continue
        tag = (m[3] or "").lower()
        if not tag:
            if m[1] and m[1].lower() in BLOCK:
                end_block()
            continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            depth_a = 0 if m[2] else 1
        if tag not in BLOCK:
            if not m[2] and tag not in VOID and tag in ("span", "button", "label", "ins") and (
                by_element(tag, m[4], False) or by_name(tag, m[4], False)
            ):
                end_block()
                _, kind, name, article = stack[-1] if stack else ROOT
                kind = kind or by_element(tag, m[4], False)
                stack.append((tag, kind, name or by_name(tag, m[4], False), article))
            elif m[2] and any(s[0] == tag for s in stack):
                end_block()
                while stack.pop()[0] != tag:
                    pass
            continue
        end_block()
        depth_a = 0
        if m[2]:
            heading = False
            if any(s[0] == tag for s in stack):
                while stack.pop()[0] != tag:
                    pass
        elif tag not in VOID:
            if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and stack and stack[-1][0] == tag:
                stack.pop()  # these end where the next one starts
            _, kind, name, article = stack[-1] if stack else ROOT
            if tag in MAIN and not article:
                articles += 1
                article = articles
            heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
            kind = kind or by_element(tag, m[4], article > 0)
            stack.append((tag, kind, name or by_name(tag, m[4], article > 0), article))
    if at < len(page):
        take(page[at:])
    end_block()
    return out


def density(text: str) -> tuple[float, bool, bool]:
    """A block's size in letters, and whether many or some of its words are stop words.

    Where most letters belong to scripts without spaces, characters take the place of words.
    """
    unspaced = len(UNSPACED.findall(text))
    if unspaced * 2 > len(text):
        common = sum(c in COMMON_CHARACTERS for c in text) / unspaced
        return len(text) + unspaced * (WIDE - 1), common >= MANY_COMMON, common >= SOME_COMMON
    words = WORD.findall(text.lower())
    stops = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    return len(text), stops >= MANY_STOP_WORDS, stops >= SOME_STOP_WORDS


def decide_alone(b: Block, page_has_article: bool) -> str:
    """Pass one: the label of a block by itself."""
    if b.outside or b.links > MANY_LINKS or (page_has_article and not b.article):
        return "bad"
    size, many, some = density(b.text)
    if b.article:
        return "good" if size >= SHORT or many else "open"
    if b.heading or (size < SHORT and "©" not in b.text):
        return "open" if b.links == 0 else "bad"
    if "©" in b.text and size < LONG:
        return "bad"
    if many:
        return "good" if size >= LONG else "near"
    return "near" if some else "bad"


def decide_by_neighbours(blocks: list[Block]) -> None:
    """Pass two: open and near-good blocks take the label of the nearest decided block."""
    decided = [b.label in ("good", "bad") for b in blocks]

    def nearest(step: int) -> list[int]:
        """Per block, the distance to the next decided block that way in the same article (0: none)."""
        out, last = [0] * len(blocks), None
        order = range(len(blocks)) if step < 0 else range(len(blocks) - 1, -1, -1)
        for k in order:
            if last is not None and not (blocks[k].article and blocks[last].article != blocks[k].article):
                out[k] = abs(k - last)
            if decided[k] and not blocks[k].outside:  # menus and the like say nothing of what is beside them
                last = k
        return out

    before, after = nearest(-1), nearest(1)
    labels = [b.label for b in blocks]
    for k, b in enumerate(blocks):
        if decided[k]:
            continue
        left, right = (before[k], labels[k - before[k]]), (after[k], labels[(k + after[k]) % len(blocks)])
        sides = [side for side in (left, right) if side[0]]
        if b.heading and after[k]:  # a heading belongs to what follows it
            sides = [right]
        if not sides:
            labels[k] = "good" if b.article or b.label == "near" else "bad"
            continue
        near = min(d for d, _ in sides)
        votes = {x for d, x in sides if d == near}
        labels[k] = "good" if votes == {"good"} or (len(votes) == 2 and b.label == "near") else "bad"
    for b, x in zip(blocks, labels):
        b.label = x


def classify(page: str) -> list[Block]:
    """The labelled blocks of a page. Names alone do not empty a page: then they are set aside."""
    blocks = weighed(blocks_of(page))
    if not any(b.label == "good" for b in blocks) and any(b.named for b in blocks):
        freed = weighed([replace(b, outside=b.outside and not b.named) for b in blocks])
        return freed if any(b.label == "good" for b in freed) else blocks
    return blocks


def weighed(blocks: list[Block]) -> list[Block]:
    has_article = any(b.article and not b.outside for b in blocks)
    decide(blocks, has_article)
    if has_article and any(not b.article and not b.outside for b in blocks):
        inside = sum(len(b.text) for b in blocks if b.label == "good")
        plain = [replace(b, article=0) for b in blocks]
        decide(plain, False)
        if sum(len(p.text) for p, b in zip(plain, blocks) if p.label == "good" and not b.article) > inside:
            return plain
    return blocks


def decide(blocks: list[Block], has_article: bool) -> None:
    for b in blocks:
        b.label = decide_alone(b, has_article)
    decide_by_neighbours(blocks)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, and ``n_blocks`` and ``n_main`` (blocks in all, blocks taken)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                text, n_blocks, n_main = [], [], []
                for page in part.column("html").to_pylist():
                    blocks = classify(page)
                    main = [b.text for b in blocks if b.label == "good"]
                    text.append(" ".join(main))
                    n_blocks.append(len(blocks))
                    n_main.append(len(main))
                yield pa.record_batch(
                    [part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array(n_blocks, pa.int32()), pa.array(n_main, pa.int32())],
                    names=["page_id", "url", "text", "n_blocks", "n_main"],
                )

    plain = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    )
    return plain.mapInArrow(run, "page_id bigint, url string, text string, n_blocks int, n_main int")
