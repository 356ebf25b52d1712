"""Main text of web pages by tag-path ratios.

A scanner turns a page into text blocks, each with its root-to-leaf path of
block elements (inline elements are transparent).  Blocks of elements that are
never content (navigation, forms, scripts, adverts and the like, by name, class,
id or role) are set aside; the paths of the others are judged:

1. *Aggregate.*  Text length and punctuation are summed per path; their ratios
   to the path's number of blocks, as far as those of a full paragraph, are put
   on a log scale and fused (added).
2. *Smooth.*  A path's ratio becomes the mean over all paths of the page,
   weighted by their blocks and by a Gaussian of the distance between the paths
   (elements to remove and add), so a heading shares in its paragraphs' ratio.
3. *Threshold.*  Paths within ``GAP`` of the page's greatest ratio are content.
   Below ``article`` or ``main`` a path gets ``BONUS`` on top, less than half of
   ``GAP``: what such an element holds may still be too thin, and what stands
   outside may be content by its ratio.  There, a class or id that only contains a
   word of the lists (``social-science``, ``search-results``) does not set a block
   aside but takes ``MALUS`` off, so that paragraphs stay and link lists go.

Edge cases: a null or empty page has empty text; broken, unclosed and truncated
markup is read as far as it goes (a tag that the page's end cuts off, in a quoted
value too, holds no text); a page of one path is content; of equal ratios
all are content; very long texts and pages, also of very many different paths, are
read whole, in linear time (paths end at 200 elements, texts below them count
there); repeated rows are extracted alike; an empty table
gives an empty result; columns named text or n_chars are replaced.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import ship, trimmed

# Element names, and class, id and role words, by what they mean.
INLINE = frozenset("a abbr acronym b bdi bdo big blink cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("head script style noscript template nav footer aside form button select option optgroup datalist fieldset textarea iframe svg canvas object applet menu dialog map audio video title noembed noframes".split())
ARTICLE = frozenset("article main".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer masthead "
    "comment comments commentlist disqus respond cookie cookies consent gdpr notice notices notification popup modal overlay share sharing social related recommended newsletter subscribe subscription widget toolbar pagination pager login signup search skip".split()
)
#: Of these, those that set a block aside as a part of a name too: adverts, readers' comments, consent.
STRONG = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo comment comments commentlist disqus respond cookie cookies consent gdpr newsletter".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: A start tag of the key closes an open element of the values.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"}}
#: Elements nested deeper than this keep the path of this depth.
DEEPEST = 200
_SCOPE = frozenset("ul ol dl table div section article main body".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_TAG_STOP = re.compile(r""">|=\s*(["'])""")
_COMMENT_END = re.compile("--!?>")
_PUNCTUATION = re.compile(r"[.,;:!?、。，…]")
_WORDS = re.compile(r"[a-z0-9]+")


def _tag_end(html: str, at: int) -> int:
    """Index after the > that ends the tag whose name ends at ``at``, or -1; quoted values may hold >.

    Every stop lies after the last, so the scan is linear in the tag.
    """
    while m := _TAG_STOP.search(html, at):
        if not m[1]:
            return m.end()
        at = html.find(m[1], m.end()) + 1
        if not at:
            break
    return -1


class Block:
    __slots__ = ("path", "text", "marked", "dropped", "hinted")

    def __init__(self, path: str, text: str, marked: bool, dropped: bool, hinted: bool):
        self.path, self.text, self.marked, self.dropped, self.hinted = path, text, marked, dropped, hinted


def _attributes(part: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in reversed(_ATTRIBUTE.findall(part))}


def _says(name: str, attributes: dict[str, str], in_article: bool) -> tuple[bool, bool]:
    """Whether an element is dropped, and whether it is only hinted at."""
    if name in DROPPED or name == "header" and not in_article:
        return True, False
    if not attributes or name in ("html", "body", "article", "main"):
        return "hidden" in attributes, False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True, False
    if attributes.get("role", "").lower() in ROLES:
        return True, False
    named = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()
    parts = set(_WORDS.findall(named))
    if parts.isdisjoint(HINTS):
        return False, False
    if in_article and parts.isdisjoint(STRONG) and HINTS.isdisjoint(named.split()):
        return False, True
    return True, False


def blocks(html: str) -> list[Block]:
    """Text blocks in page order."""
    out: list[Block] = []
    # An open element: name, path, dropped, marked, hinted.
    stack: list[tuple[str, str, bool, bool, bool]] = [("", "", False, False, False)]
    inline: list[tuple[str, bool]] = []  # open inline elements that hide their text
    text: list[str] = []

    def flush() -> None:
        if text:
            joined = " ".join("".join(text).split())
            text.clear()
            if joined:
                _, path, dropped, marked, hinted = stack[-1]
                out.append(Block(path, joined, marked, dropped, hinted))

    def close(k: int) -> None:
        flush()
        del stack[k:]

    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not inline:
            raw = html[at:lt]
            text.append(unescape(raw) if "&" in raw else raw)
        if lt == n:
            break
        if html.startswith("<!--", lt):
            end = _COMMENT_END.search(html, lt + 2)  # <!--> is empty
            at = end.end() if end else n
            continue
        if html.startswith(("<!", "<?"), lt):
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        ending = html.startswith("</", lt)
        m = _NAME.match(html, lt + 1 + ending)
        if not m:
            if ending:  # a bogus comment
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                if not inline:
                    text.append("<")
                at = lt + 1
            continue
        name, at = m[0].lower(), _tag_end(html, m.end())
        if at < 0:
            break  # a tag that the page's end cuts off
        if ending:
            if name in INLINE:
                for k in range(len(inline) - 1, -1, -1):
                    if inline[k][0] == name:
                        del inline[k:]
                        break
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    close(k)
                    inline.clear()
                    break
            else:
                if name == "p":
                    flush()
            continue
        if name == "br":
            text.append(" ")
            continue
        part = html[m.end() : at - 1]
        if name in INLINE:
            if part.strip() and (inline or _says(name, _attributes(part), True)[0]):
                inline.append((name, True))
            elif inline:
                inline.append((name, True))
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        inline.clear()
        if name not in ("tr", "td", "th") or stack[-1][0] != "p":
            if stack[-1][0] == "p":
                close(len(stack) - 1)
        if shut := CLOSES.get(name):
            k = len(stack) - 1
            low = None
            while k > 0 and (stack[k][0] in shut or stack[k][0] not in _SCOPE):
                if stack[k][0] in shut:
                    low = k
                k -= 1
            if low is not None:
                close(low)
        flush()
        _, path, dropped, marked, hinted = stack[-1]
        attributes = _attributes(part) if part.strip() else {}
        drop, hint = _says(name, attributes, marked)
        dropped, hinted = dropped or drop, hinted or hint
        label = name if not attributes.get("class") else f"{name}.{'.'.join(sorted(attributes['class'].lower().split()))}"
        if name in RAW:
            end = re.compile(rf"</{name}[\s/>]", re.I).search(html, at)
            if not dropped and end:
                out.append(Block(f"{path}/{label}", " ".join(unescape(html[at : end.start()]).split()), marked, dropped, hinted))
            at = _tag_end(html, end.end() - 1) if end else -1
            if at < 0:
                break
            continue
        if not part.endswith("/") or name not in ("p",):
            stack.append((name, f"{path}/{label}" if len(stack) < DEEPEST else path, dropped, marked or name in ARTICLE or attributes.get("role", "").lower() in ARTICLE, hinted))
    flush()
    return out


#: How far below the greatest ratio content may be, what ``article`` and ``main``
#: add and a hint in them takes off (log scale); the Gaussian's width in elements.
GAP, BONUS, MALUS, SIGMA = 2.75, 1.0, 3.0, 1.0
#: Text length and punctuation of a block from which it is a full paragraph:
#: what is longer on average says no more about a path.
FULL_LENGTH, FULL_MARKS = 300, 5


def path_ratios(found: list[Block]) -> dict[str, tuple[float, int]]:
    """Fused ratio of each path, log text length and punctuation per block, and its blocks."""
    length, marks, n = defaultdict(int), defaultdict(int), defaultdict(int)
    for b in found:
        length[b.path] += len(b.text)
        marks[b.path] += len(_PUNCTUATION.findall(b.text))
        n[b.path] += 1
    fused = lambda p: math.log1p(min(FULL_LENGTH, length[p] / n[p])) + math.log1p(min(FULL_MARKS, marks[p] / n[p]))
    return {p: (fused(p), n[p]) for p in n}


def smoothed(ratios: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Each path's ratio as the mean over the page's paths, weighted by their
    blocks and a Gaussian of the distance between the paths.

    The distance is up to a common ancestor and down again; sums over what lies
    v elements below an ancestor make this linear in the number of paths.
    """
    reach = int(6 * SIGMA)
    gauss = [math.exp(-d * d / (2 * SIGMA * SIGMA)) for d in range(reach + 1)]
    below: dict[tuple[str, int], list[float]] = defaultdict(lambda: [0.0, 0.0])
    for path, (ratio, n) in ratios.items():
        for depth, node in enumerate(_ancestors(path, reach)):
            held = below[node, depth]
            held[0] += n
            held[1] += n * ratio
    out = {}
    for path in ratios:
        weight = total = 0.0
        child = None
        for up, node in enumerate(_ancestors(path, reach)):
            for down in range(reach - up + 1):
                n, sums = below.get((node, down), (0.0, 0.0))
                if child is not None and down:  # what lies below the child came nearer
                    less = below.get((child, down - 1), (0.0, 0.0))
                    n, sums = n - less[0], sums - less[1]
                weight += gauss[up + down] * n
                total += gauss[up + down] * sums
            child = node
        out[path] = total / weight
    return out


def _ancestors(path: str, reach: int) -> Iterator[str]:
    """The path itself, then what is left without its last 1, 2, ... elements."""
    for _ in range(reach + 1):
        yield path
        if not path:
            return
        path = path.rpartition("/")[0]


def content_paths(found: list[Block]) -> set[tuple[str, bool, bool]]:
    """The (path, marked, hinted) of blocks that are content."""
    ratio = smoothed(path_ratios(found))
    cut = max(ratio.values()) - GAP - 1e-9
    return {(b.path, b.marked, b.hinted) for b in found if ratio[b.path] + BONUS * b.marked - MALUS * b.hinted >= cut}


def extract(html: str | None) -> str:
    """The page's main text, blocks joined by newlines."""
    found = [b for b in blocks(html or "") if not b.dropped]
    if not found:
        return ""
    content = content_paths(found)
    return "\n".join(b.text for b in found if (b.path, b.marked, b.hinted) in content)


def extract_text(pages: DataFrame) -> DataFrame:
    """``pages`` without html, with text and n_chars (code points)."""
    ship(pages.sparkSession)
    source = pages.drop("text", "n_chars")
    carried = [c for c in source.columns if c != "html"]
    schema = StructType([*[source.schema[c] for c in carried], StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h.as_py()) for h in b.column(len(carried))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carried)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*carried, "text", "n_chars"])

    return source.select(*carried, "html").mapInArrow(trimmed(run), schema)
