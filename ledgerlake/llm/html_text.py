"""Main text of web pages by tag-path ratios.

A page becomes a sequence of text blocks, each with its root-to-leaf tag path. Text length, punctuation and link
share are aggregated per path, smoothed along the page, fused into one ratio per path and cut at a threshold; the
paths above it point at the element that holds the article, and the blocks under that element are the text.
Menus, headers, footers, sidebars, notices, adverts, forms and comments are told by element and attribute names.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm.common import masked, quoted, small_batches, stray_columns

#: Element names by their part in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe svg math object textarea title select option button canvas audio video".split())
#: Of these the ones that, without an end tag, are passed over as a tag only.
LOOSE = set("svg math object select option button canvas audio video iframe noscript template".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
SIDE = set("nav header footer aside form menu dialog fieldset".split())
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: Words in class, id or role that mark an element as outside the article.
SIDE_WORDS = set("""ad ads adv adsbox alert banner complementary contentinfo dialog disclaimer discussion discussions footer form gdpr header infobar
login masthead menu modal nav navbar notice notices notification overlay pager pagination paywall popup privacy promo promotion promos rail
recommended replies reply respond responses search share sharing sidenav signup social tags teaser toast toolbar widget widgets""".split())
SIDE_STARTS = tuple("advert breadcrumb commentf commentl commentb comments consent cookie copyright disqus navig newsletter related sidebar skyscraper sponsor subscri".split())
TITLE_WORDS = {"article", "entry", "post", "page", "content", "story"}
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)""", re.S)
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PUNCT = re.compile(r"""[.,;:!?…。，、؟]""")


@dataclass(slots=True)
class Block:
    path: tuple[tuple[str, int], ...]  # (element with its class, serial number of the element), root first
    text: str
    linked: int
    marks: tuple[tuple[int, int], ...]  # (serial number, how it is told) of elements around it that are outside the article
    holds: bool  # whether it is a first-order heading, or in an article or main element


PART, WHOLE, SURE = 1, 2, 3  # told by a part of a name, a whole name, the element itself


def _words(attributes: str, holder: bool) -> tuple[str, int]:
    """An element's class for its path, and how its attributes put it outside the article (0: not at all); of an element
    that may itself be the article (``holder``) only whole names count, so that "has-comments" says nothing against it."""
    label, side = "", 0
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(value.strip("\"'"))
        if name == "hidden" or (name == "style" and _UNSEEN.search(value)):
            side = SURE
        if name not in ("class", "id", "role"):
            continue
        if name == "class" and not label:
            label = ".".join(value.split()[:2])
        plain = re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()
        for words, told in ((plain.split(), WHOLE), ([] if holder else re.split(r"[^a-z]+", plain), PART)):
            if "header" in words and not TITLE_WORDS.isdisjoint(re.split(r"[^a-z]+", plain)):  # an article's own head holds its title
                words.remove("header")
            if not SIDE_WORDS.isdisjoint(words) or any(w == "comment" or w.startswith(SIDE_STARTS) and (told == PART or w.isalpha()) for w in words):
                side = max(side, told)
    return label, side


def blocks_of(page: str) -> list[Block]:
    """Text blocks of a page in order, raw elements and the head left out."""
    out: list[Block] = []
    stack: list[tuple[str, str, int, int]] = []  # element, label, serial, outside the article
    parts: list[str] = []
    linked = serial = 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(tuple((x[1], x[2]) for x in stack if x[0] not in INLINE), text, min(linked, len(text)),
                                 tuple((x[2], x[3]) for x in stack if x[3]), any(x[0] in ("article", "main", "h1") for x in stack)))
            parts.clear()
        linked = 0

    def pop_to(k: int) -> None:
        if any(x[0] not in INLINE for x in stack[k:]):
            close()
        del stack[k:]

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        text = page[at:m.start() if m else n]
        if text:
            parts.append(text)
            if any(x[0] == "a" for x in stack):
                linked += len(text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                parts.append(html.escape(m[0][9:-3]))
            continue
        if m[1] or m[4]:
            if tag == "br":
                parts.append(" ")
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            else:
                if tag in ("p", "body", "html"):
                    close()
            continue
        if tag == "head":  # what it holds is raw or void; its end tag may be missing
            continue
        if tag in RAW:
            if tag in ("object", "video", "audio", "canvas", "svg", "math", "noscript", "template", "button", "select", "option", "iframe") and (m[3] or m[6] or "").endswith("/"):
                continue
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else at if tag in LOOSE else n
            continue
        if tag in VOID:
            if tag in ("br", "wbr", "img", "input", "embed"):
                parts.append("" if tag == "wbr" else " ")
            elif tag == "hr":
                close()
            continue
        if tag in ENDS_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    pop_to(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        if tag in SAME:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in SAME[tag]:
                    pop_to(k)
                    break
                if stack[k][0] in HOLDS[tag]:
                    break
        label, side = _words(m[3] or m[6] or "", tag in ("article", "main"))
        if tag not in INLINE:
            close()
        serial += 1
        inside = any(x[0] in ("article", "main") for x in stack)
        side = 0 if tag in ("html", "body") else side
        side = SURE if tag in SIDE and not (tag == "header" and inside) else side
        stack.append((tag, f"{tag}.{label}" if label else tag, serial, side))
    close()
    return out


#: What a block's text counts for where an element around it is told to be outside the article: by a part of a name, a
#: whole name, the element itself. A mark around all blocks tells none apart.
TRUST = {0: 1.0, PART: 0.02, WHOLE: 0.005, SURE: 0.0005}


def _ratio(path: list[Block]) -> float:
    """Fused ratio of a path: characters per node, raised by punctuation and lowered by links."""
    chars, nodes = sum(len(b.text) for b in path), len(path)
    points = sum(len(_PUNCT.findall(b.text)) for b in path)
    linked = sum(b.linked for b in path)
    return chars / nodes * (0.1 + points / nodes) * max(0.0, 1 - linked / chars)


def _trust(path: list[Block], common: frozenset[int]) -> float:
    """What the marks around a path (but the ``common`` ones) leave of its ratio."""
    return min(TRUST[told] for b in path for _, told in ((0, 0), *(m for m in b.marks if m[0] not in common)))


def _common(blocks: list[Block]) -> frozenset[int]:
    """Marked elements that say nothing: those told by a part of a name that hold most of the page's unlinked text, and its
    heading or article or nearly all of it; those around every block."""
    size: dict[int, int] = defaultdict(int)
    holds: set[int] = set()
    for b in blocks:
        for serial, told in b.marks:
            if told < SURE:
                size[serial] += len(b.text) - b.linked
                if b.holds and all(t == PART for _, t in b.marks):
                    holds.add(serial)
    parts = {serial for b in blocks for serial, told in b.marks if told == PART}
    total = sum(len(b.text) - b.linked for b in blocks if all(told < SURE for _, told in b.marks))
    free = sum(len(b.text) - b.linked for b in blocks if not b.marks)
    wide = {serial for serial in parts if 2 * size[serial] > total and (serial in holds or 4 * free < total)}
    everywhere = set.intersection(*({serial for serial, _ in b.marks} for b in blocks)) if blocks else set()
    return frozenset(wide | everywhere)


def main_text(page: str, spread: float = 1.0, cut: float = 0.25) -> str:
    """The article's text: blocks joined by one space."""
    blocks = blocks_of(page)
    if not blocks or all(told == SURE for b in blocks for told in [max((t for _, t in b.marks), default=0)]):
        return ""
    common = _common(blocks)
    paths: dict[tuple[str, ...], list[Block]] = defaultdict(list)
    # a path is told from another by its labels and by how it is marked
    names = [(*(label for label, _ in b.path), *(str(told) for serial, told in b.marks if serial not in common)) for b in blocks]
    for name, block in zip(names, blocks, strict=True):
        paths[name].append(block)
    ratio = {name: _ratio(found) for name, found in paths.items()}
    # smooth along the page (Gaussian, 2 blocks to either side), then fuse with the path's own ratio
    kernel = [math.exp(-(k * k) / (2 * spread * spread)) for k in range(-2, 3)]
    fused: dict[tuple[str, ...], list[float]] = defaultdict(list)
    for i, name in enumerate(names):
        near = [(kernel[k + 2], ratio[names[i + k]]) for k in range(-2, 3) if 0 <= i + k < len(names)]
        fused[name].append(math.sqrt(ratio[name] * sum(w * v for w, v in near) / sum(w for w, _ in near)))
    value = {name: sum(v) / len(v) * _trust(paths[name], common) for name, v in fused.items()}
    level = cut * sum(value[n] * len(b.text) for n, b in zip(names, blocks, strict=True)) / sum(len(b.text) for b in blocks)
    chosen = {name for name, v in value.items() if v >= level}

    # the elements that hold the chosen blocks: the article or main element with most of them, if there is one,
    # else the parents of all; of the body itself the chosen paths, headings and what stands between without being links
    mass: dict[tuple, float] = defaultdict(float)
    for name, block in zip(names, blocks, strict=True):
        if name in chosen:
            mass[_holder(block)] += len(block.text) * value[name]
    named = [h for h in mass if h and h[-1][0].split(".")[0] in ("article", "main")]
    holders = {max(named, key=lambda h: (mass[h], -h[-1][1]))} if named else {h for h in mass if h and h[-1][0].split(".")[0] not in ("html", "body")}
    bare_at = [i for i, (name, b) in enumerate(zip(names, blocks, strict=True)) if not named and name in chosen and _holder(b) not in holders]
    kept = []
    for i, (name, block) in enumerate(zip(names, blocks, strict=True)):
        # in the article's element everything is kept, but for marked paths that were not chosen
        held = any(block.path[:k] in holders for k in range(1, len(block.path) + 1)) and (name in chosen or all(serial in common for serial, _ in block.marks))
        bare = bool(bare_at) and (name in chosen or (_leaf(block) in HEADING and _holder(block) in mass)
                                  or (bare_at[0] < i < bare_at[-1] and 2 * block.linked < len(block.text)))
        if held or bare:
            kept.append(block.text)
    return " ".join(kept)


def _leaf(block: Block) -> str:
    return block.path[-1][0].split(".")[0] if block.path else ""


def _holder(block: Block) -> tuple:
    """Path up to the outermost article or main element around a block, else up to its parent element."""
    for k, (label, _) in enumerate(block.path):
        if label.split(".")[0] in ("article", "main"):
            inner = next((j for j in range(k + 1, len(block.path)) if block.path[j][0].split(".")[0] == "article"), k)
            return block.path[:(inner if label.split(".")[0] == "main" else k) + 1]
    return block.path[:-1]


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds ``text`` (the main text, empty if none) and ``n_chars`` (its code points) to every row of ``pages``.

    The whole ``html`` is read; null counts as empty. Character references are decoded, white space inside a block
    becomes one space. Input columns named text or n_chars are replaced, others pass through, the html itself does
    not. Every row is worked on by itself, so repeated rows give repeated results; an empty table gives an empty one.
    """
    small_batches(pages.sparkSession)
    through = stray_columns(pages, {html_col, "text", "n_chars"})
    inside, outside = masked(pages, through)
    frame = pages.select(*inside, F.col(quoted(html_col)).alias("__html"))
    schema = T.StructType([*frame.schema.fields[:-1], T.StructField("__main", T.StringType()), T.StructField("__n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x or "") for x in batch.column("__html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names)

    return frame.mapInArrow(run, schema).select(*outside, F.col("__main").alias("text"), F.col("__n").alias("n_chars"))
