"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags; scripts, styles, comments and other unseen elements are
dropped, and a block remembers its containers.

First pass, by densities: blocks whose characters stand mostly inside links are boilerplate, as are short ones
with a copyright sign; blocks of at least ``DECIDED`` characters with enough stop words for their length are
content. All others stay ambiguous: short blocks, and long ones without stop words. Containers are a further
feature of this pass. Blocks of navigation, footer, sidebar, notice, advert, form or reader-comment containers
are boilerplate whatever their density. Where article or main elements hold most of the dense text, a long block
inside them needs no stop words, and one outside them is not decided by its density alone. If nothing at
all is content then, the container with the most ambiguous text is, if that is long or dense as a whole (an
article need not be).

Second pass: an ambiguous block takes the label of the nearest decided block of its own container; with none
there, that of the nearest decided block on either side (inside an article: of the article). Ties are content inside
an article, else boilerplate. A page without any decided block has no main text.

Body and html are never boilerplate by name, and neither a container that is one by its names only (or a form)
if it holds most of the stop-word-dense text of the page's articles, or, where no article has such text, most of
the page's text outside links while hardly any lies outside marked containers. Names that also mark parts of an article
(``PART_NAMES``, such as header or tags) count outside articles only.

Character references are decoded, white space inside a block becomes one space, blocks are joined by
line ends in page order. Null html is empty; broken, unclosed or cut-off markup is read as far as it
goes, in time that grows with the page's length alone; a page without main text gives "". Rows with null or
repeated ids are pages of their own; an empty table gives an empty table; columns other than page_id, url
and html are left out.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_left
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: frequent function words of four languages
STOP_WORDS = frozenset(
    """the of and to a in is that it for on with as was by at be this are from or an have not but they you we he she his her had has were which their will would there been if more when who so no
    der die und das den von zu mit ist im nicht sich des auf ein eine als dem für auch es an er sie wird werden bei oder um aus nach wie über zum zur einer einem einen noch nur aber war
    le la les de des du un une que qui en dans pour pas sur avec est et au par elle il ce se plus ne ou sont aux cette mais son sa ses nous vous leur comme été
    el los las y del por con para una su al lo como más pero sus este esta entre cuando muy sin sobre ser también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros""".split()
)
#: Characters from which a block counts as dense, is decided by its density, and is long.
SHORT, DECIDED, LONG = 70, 120, 200
STOP_LOW, LINKS_HIGH = 0.12, 0.35

_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9]*)")
_EMPTY = re.compile(r"(?:^|[\s\"'])/$")
_STOP = re.compile("[<>\"']")
_NAMES = re.compile(r"""\b(?:class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")
UNSEEN = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in "script style noscript template svg iframe textarea select title".split()}
BLOCK_TAGS = frozenset("p div li ul ol dl dt dd h1 h2 h3 h4 h5 h6 table tr td th thead tbody blockquote pre section article main nav header footer aside form fieldset figure figcaption hr body html address details summary center caption option button label head".split())
VOID_TAGS = frozenset("br hr img input meta link area base col embed source track wbr".split())
#: Elements whose blocks belong together; blocks of other elements belong to the nearest of these around them.
GROUP_TAGS = frozenset("div ul ol dl table td blockquote section article main nav header footer aside form fieldset figure body".split())
REOPENED, HOLDERS = frozenset("p li td tr dt dd option".split()), frozenset("ul ol table dl div section article main blockquote".split())
BAD_TAGS = frozenset("nav footer aside button dialog menu head".split())
BAD_NAMES = frozenset(
    """ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe signup login
    nav navbar navigation menu menus breadcrumb breadcrumbs sidebar side rail widget related recommended share social footer foot header masthead comments comment commentlist disqus replies reply respond pagination pager toolbar tags copyright legal disclaimer search complementary contentinfo""".split()
)
PART_NAMES = frozenset("header head masthead side search tags menu legal disclaimer foot".split())
GOOD_TAGS = frozenset(("article", "main"))


class Block:
    __slots__ = ("text", "linked", "bad", "good", "label", "mark", "proper", "dense", "group")

    def __init__(self, text: str, linked: int, bad: bool, good: bool, mark: int, proper: bool, group: int):
        self.text, self.linked, self.bad, self.good, self.label = text, linked, bad, good, None
        self.mark, self.proper, self.group = mark, proper, group  # innermost container marked by name; inside an article without a bad name
        self.dense = len(text) if len(text) >= SHORT and linked <= LINKS_HIGH * len(text) and stop_density(text) >= STOP_LOW else 0


def settle(found: list[Block], outer: list[int]) -> None:
    """Sets bad for blocks in containers marked by name, where the mark holds; ``outer`` has the mark around each."""
    rows = [b for b in found if not b.bad and b.linked <= LINKS_HIGH * len(b.text)]
    proper, whole = sum(b.dense for b in rows if b.proper), sum(len(b.text) for b in rows)
    own, inside, inside_proper = ([0] * len(outer) for _ in range(3))
    free = 0  # text outside all containers whose mark holds
    for b in rows:
        if b.mark < 0:
            free += len(b.text)
        else:
            own[b.mark] += len(b.text)
            inside[b.mark] += len(b.text)
            inside_proper[b.mark] += b.dense * b.proper
    for k in range(len(outer) - 1, -1, -1):  # outer containers come first
        if outer[k] >= 0:
            inside[outer[k]] += inside[k]
            inside_proper[outer[k]] += inside_proper[k]
    clear = [False] * len(outer)
    for k, o in enumerate(outer):
        void = 2 * inside_proper[k] > proper if proper else 2 * inside[k] > whole and 10 * free < whole
        clear[k] = void and (o < 0 or clear[o])
        free += own[k] if clear[k] else 0
    for b in found:
        b.bad = b.bad or (b.mark >= 0 and not clear[b.mark])


def tags(page: str):
    """(start, end, closing, name, attributes) of every tag; name "" for comments and unseen elements."""
    at, last = 0, {c: page.rfind(c) for c in ">\"'"}
    while (at := page.find("<", at)) >= 0 and at < last[">"]:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, False, "", ""
        elif page[at + 1] in "!?":
            end = page.find(">", at) + 1
            yield at, end, False, "", ""
        elif m := _NAME.match(page, at + 1):
            closing, name, end = page[at + 1] == "/", m[1].lower(), m.end()
            while (stop := _STOP.search(page, end)) and stop[0] in "\"'":  # a quote without its end is a character
                end = page.find(stop[0], stop.end()) + 1 if stop.start() < last[stop[0]] else stop.end()
            body = m.end()
            if not stop:
                return
            end = stop.end() if stop[0] == ">" else stop.start()  # a tag that meets the next one ends there
            if name in UNSEEN and not closing and not (name == "svg" and page[end - 2 : end] == "/>"):
                close = UNSEEN[name].search(page, end)
                end = close.end() if close else len(page)
                name = ""
            yield at, end, closing, name, page[body : stop.start()] if name else ""
        else:
            end = at + 1
        at = end


def blocks(page: str) -> list[Block]:
    """Blocks of visible text in page order, with characters inside links and container marks."""
    out: list[Block] = []
    stack: list[tuple] = []  # tag, boilerplate by tag, article container, marked by name, article without a bad name, block elements so far, group
    open_at: dict[str, list[int]] = defaultdict(list)
    holders: list[int] = []
    outer: list[int] = []
    marks: list[int] = []
    bad = good = links = proper = groups = 0
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, linked, bad > 0, good > 0, marks[-1] if marks else -1, proper > 0, stack[-1][6] if stack else 0))
        parts, linked = [], 0

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            shown = html_lib.unescape(raw) if "&" in raw else raw
            parts.append(shown)
            if links:
                linked += len(" ".join(shown.split()))

    def close(k: int) -> None:
        nonlocal bad, good, links, proper
        while len(stack) > k:
            tag, b, g, named, p, *_ = stack.pop()
            open_at[tag].pop()
            bad, good, links, proper = bad - b, good - g, links - (tag == "a"), proper - p
            if named:
                marks.pop()
            if tag in HOLDERS:
                holders.pop()

    at, breaks = 0, 0
    for start, end, closing, tag, attributes in tags(page):
        if start > at:
            raw = page[at:start]
            if breaks and raw.strip():
                breaks = 0
            text(raw)
        at = end
        if not tag:
            continue
        if tag == "br":
            breaks += 1
            parts.append(" ")
            if breaks == 2:
                flush()
            continue
        breaks = 0
        if tag in BLOCK_TAGS:
            flush()
        if closing:  # an end tag closes its element; a stray one closes nothing, nor one of text around blocks
            if open_at[tag]:
                k = open_at[tag][-1]
                if tag in BLOCK_TAGS or stack[-1][5] == stack[k][5]:
                    close(k)
        elif tag not in VOID_TAGS and not _EMPTY.search(attributes):
            if tag in REOPENED and open_at[tag] and open_at[tag][-1] > (holders[-1] if holders else -1):  # opened again without an end tag
                close(open_at[tag][-1])
            g = tag in GOOD_TAGS
            b = tag in BAD_TAGS or (tag == "header" and not good)
            named = tag == "form"
            p = g
            if not b and "=" in attributes and tag not in ("body", "html"):
                names = {w for n in _NAMES.findall(attributes) for w in _PARTS.split("".join(n).lower())}
                known = not names.isdisjoint(BAD_NAMES - PART_NAMES if proper else BAD_NAMES)
                named, p = named or (known and not g), p and not known
                g = g or (not named and not names.isdisjoint(("articlebody", "main")) and tag in BLOCK_TAGS)
                p = p or (g and not known)
            groups += 1
            depth, group = (stack[-1][5], stack[-1][6]) if stack else (0, 0)
            open_at[tag].append(len(stack))
            if tag in HOLDERS:
                holders.append(len(stack))
            stack.append((tag, b, g, named, p, depth + (tag in BLOCK_TAGS), groups if tag in GROUP_TAGS else group))
            bad, good, links, proper = bad + b, good + g, links + (tag == "a"), proper + p
            if named:
                outer.append(marks[-1] if marks else -1)
                marks.append(len(outer) - 1)
    rest = page[at:]
    text(rest.partition("<")[0] if ">" not in rest else rest)
    flush()
    settle(out, outer)
    return out


def stop_density(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?()[]\"'#*$%&|") in STOP_WORDS for w in words) / max(1, len(words))


def first_pass(found: list[Block]) -> None:
    """Labels blocks by densities and containers; good is taken back where articles do not hold most dense text."""
    left = [b for b in found if not b.bad]
    article = any(b.good for b in left) and 2 * sum(b.dense for b in left if b.good) >= sum(b.dense for b in left)
    for b in found:
        b.good = b.good and article
        n = len(b.text)
        if b.bad or b.linked > LINKS_HIGH * n or ("\u00a9" in b.text and n < LONG and not b.good):
            b.label = False
        elif b.dense >= DECIDED and (b.good or not article):
            b.label = True
        elif b.good and n >= LONG:
            b.label = True
    if any(b.label for b in found):
        return
    open_ = [b for b in found if b.label is None and (b.good or not article)]
    groups: dict[int, list[Block]] = defaultdict(list)
    for b in open_:
        groups[b.group].append(b)
    texts = {g: " ".join(b.text for b in rows) for g, rows in groups.items()}
    fit = [g for g, t in texts.items() if article or len(t) >= LONG or (len(t) >= SHORT and stop_density(t) >= STOP_LOW)]
    if fit:
        best = max(fit, key=lambda g: len(texts[g]))
        for b in open_:
            if b.good or b.group == best:
                b.label = True


def nearest(at: list[int], i: int) -> list[int]:
    """The one or two nearest of the sorted places ``at`` on either side of i, the nearest alone if it is nearer."""
    k = bisect_left(at, i)
    sides = at[max(0, k - 1) : k] + at[k : k + 1]
    best = min((abs(j - i) for j in sides), default=0)
    return [j for j in sides if abs(j - i) == best]


def second_pass(found: list[Block]) -> None:
    """Ambiguous blocks inherit labels from their nearest decided neighbours."""
    by_group: dict[int, list[int]] = defaultdict(list)
    decided, of_article = [], []
    for i, b in enumerate(found):
        if b.label is not None:
            by_group[b.group].append(i)
            decided.append(i)
            if b.good:
                of_article.append(i)
    given = {}
    for i, b in enumerate(found):
        if b.label is None:
            near = nearest(by_group[b.group], i) or nearest(of_article if b.good else decided, i)
            labels = {found[j].label for j in near}
            given[i] = labels.pop() if len(labels) == 1 else b.good
    for i, label in given.items():
        found[i].label = label


def classify(found: list[Block]) -> None:
    """Sets label: True for content, False for boilerplate."""
    first_pass(found)
    second_pass(found)


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    classify(found)
    return "\n".join(b.text for b in found if b.label)


def extract(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` -> (page_id, url, text, n_chars)."""

    def run(frames):
        for frame in frames:
            texts = [main_text(h.as_py()) for h in frame.column("html")]
            yield pa.RecordBatch.from_arrays([frame.column("page_id"), frame.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
