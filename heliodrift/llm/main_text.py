"""Main text of web pages by two passes of block rules.

A page is read once into blocks: runs of text between block-level tags, with their links and
the containers around them. The first pass decides each block by itself:

* ``BAD`` if a container says so (navigation, footer, form, a class or id such as ``ad`` or
  ``comments``), or if more than half of its signs are in links;
* ``GOOD`` if it is long and dense in stop words;
* long and with hardly any it is ``BAD`` where the page is in a language that the stop words
  cover, else ``GOOD``, as they then say nothing about it. The language is the declared one; where
  none is declared it is covered unless these blocks are more, and hold more text, than the dense;
* otherwise it is left open, short blocks above all.

Names of classes count for what they name, not for what is laid out around it: none on
``html``, ``body``, ``main`` and an outermost ``article``, no name such as ``has-sidebar`` or
``with-menu``, and none that ends in a word for the article. Where nothing of a page would be left,
the names that rule out most of its text are not heeded.

The second pass gives each open block the label of its nearest decided neighbours: if they
agree, theirs; else that of the nearer one, counted in blocks, the earlier one on a tie.
What a container rules out says nothing about its neighbours, and an open block without a
decided neighbour is good. Blocks in the page's article (``article`` or ``main``) ask only
neighbours in there and are never decided by a lack of stop words. Where an article holds
more text than the good blocks around it, these are bad.

A null or empty page, or one without text, gives an empty text; very long pages are read in
one linear pass; null ids and urls are returned as they are; repeated rows give repeated
results; other columns are not read.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliodrift.llm.batches import map_text

LINK_SHARE = 0.5
LONG_CHARS = 70
DENSE_SHARE = 0.3
SPARSE_SHARE = 0.1
BAD, OPEN, GOOD = -1, 0, 1
#: Long with hardly any stop words: bad or good by what else the page holds.
SPARSE = 2

#: Tags that begin or end a block.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option "
    "p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Tags whose content is not text.
RAW_TAGS = frozenset("script style noscript template textarea title iframe svg math object canvas video audio".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags around what is not the article.
BAD_TAGS = frozenset("nav aside footer form button select fieldset label menu dialog head".split())
ARTICLE_TAGS = frozenset(("article", "main"))
#: Words in class, id and role of what is not the article.
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation "
    "menu breadcrumb breadcrumbs sidebar aside widget footer masthead topbar cookie cookies consent gdpr notice "
    "alert popup modal overlay newsletter subscribe subscription signup login search share sharing social comment "
    "comments discussion replies reply respond disqus related recommended recommendations pagination pager copyright "
    "legal disclaimer toolbar complementary contentinfo hidden".split()
)
#: Frequent words of four languages.
STOP_WORDS = frozenset(
    "the of and to in a is that it for was on are as with his they be at this from have or by not but "
    "le la les de des du et un une que qui dans pour pas sur au aux est avec par ce il en ne se plus "
    "der die das und den von zu mit sich ein eine auf für nicht ist dem auch als im es an war "
    "el los las y del se no una por con para su al lo como más o pero sus".split()
)
#: Languages that the stop words cover.
COVERED = frozenset(("en", "fr", "de", "es"))
#: First parts of names that say what stands beside, and last parts that name the article.
LAYOUT_PARTS = frozenset("has have with without no is show hide toggle".split())
ARTICLE_PARTS = frozenset("article story post essay page main body".split())
#: Tags around a whole page, whose names describe its layout.
PAGE_TAGS = frozenset(("html", "body", "main"))
_LANGUAGE = re.compile(r"<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z]+)", re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_HINT = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PART = re.compile(r"[a-z]+")
_WORD = re.compile(r"[^\W\d_]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    linked: int
    bad: bool
    article: bool
    #: Number of the outermost container that a name alone rules out; 0 if there is none.
    named: int = 0
    label: int = OPEN


def _hidden(attributes: str) -> bool:
    for name, *values in _HINT.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _named_bad(attributes: str, article: bool) -> bool:
    for name, *values in _HINT.findall(attributes):
        if name.lower() in ("class", "id", "role"):
            for word in "".join(values).lower().split():
                parts = _PART.findall(word)
                if len(parts) > 1 and (parts[0] in LAYOUT_PARTS or parts[-1] in ARTICLE_PARTS):
                    continue
                if not BAD_WORDS.isdisjoint(parts) or "header" in parts and not article:
                    return True
    return False


class _Reader:
    """Collects blocks while the tags of a page go by."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        #: Name, whether ruled out, whether in an article, and the container whose name rules it out.
        self.open: list[tuple[str, bool, bool, int]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.in_link = False
        self.named = 0

    @property
    def state(self) -> tuple[bool, bool, int]:
        return self.open[-1][1:] if self.open else (False, False, 0)

    def text(self, raw: str) -> None:
        if raw:
            found = references.unescape(raw) if "&" in raw else raw
            self.parts.append(found)
            if self.in_link:
                self.linked += len(_SPACE.sub(" ", found).strip())

    def flush(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.blocks.append(Block(text, self.linked, *self.state))
            self.parts = []
        self.linked = 0

    def _ruled_out(self, name: str, attributes: str) -> tuple[bool, bool]:
        """Whether a tag is out by itself, and whether it is by a name."""
        _, article, _ = self.state
        out = name in BAD_TAGS or (name == "header" and not article) or bool(attributes) and _hidden(attributes)
        heeded = bool(attributes) and name not in PAGE_TAGS and (name != "article" or article)
        return out, heeded and _named_bad(attributes, article)

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.parts.append(" ")
            return
        if name == "a":
            self.in_link = True
            return
        out, by_name = self._ruled_out(name, attributes) if name in BLOCK_TAGS or attributes else (False, False)
        if name in BLOCK_TAGS or out or by_name:
            self.flush()
            if name == "p" and self.open and self.open[-1][0] == "p":
                self.open.pop()
            if name not in VOID_TAGS:
                bad, article, named = self.state
                if by_name and not (out or bad):
                    self.named += 1
                    named = self.named
                self.open.append((name, bad or out or by_name, article or name in ARTICLE_TAGS, 0 if out else named))
        elif name not in VOID_TAGS and self.open and not self.open[-1][0] in BLOCK_TAGS:
            self.open.append((name, *self.state))

    def end(self, name: str) -> None:
        if name == "a":
            self.in_link = False
        elif name in BLOCK_TAGS or any(x[0] == name for x in self.open[-8:]):
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == name:
                    self.flush()
                    self.in_link = False
                    del self.open[k:]
                    return
            if name in BLOCK_TAGS:
                self.flush()


def read_blocks(page: str) -> list[Block]:
    """The blocks of a page in order, with references decoded and white space folded."""
    reader, at, lower = _Reader(), 0, None
    while True:
        tag = page.find("<", at)
        if tag < 0:
            reader.text(page[at:])
            break
        if tag > at:
            reader.text(page[at:tag])
        following = page[tag + 1 : tag + 2]
        if page.startswith("<!--", tag):
            end = page.find("-->", tag + 4)
            at = end + 3 if end >= 0 else len(page)
        elif following in ("!", "?"):
            end = page.find(">", tag)
            at = end + 1 if end >= 0 else len(page)
        elif match := (_TAG.match(page, tag) or _LOOSE_TAG.match(page, tag)):
            name, at = match[2].lower(), match.end()
            if match[1]:
                reader.end(name)
            elif name in RAW_TAGS and not match[3].endswith("/"):
                lower = page.lower() if lower is None or len(lower) != len(page) else lower
                end = lower.find(f"</{name}", at) if len(lower) == len(page) else -1
                if end < 0 and (found := re.compile(f"</{name}", re.I).search(page, at)):
                    end = found.start()
                close = page.find(">", end) if end >= 0 else -1
                at = close + 1 if close >= 0 else len(page)
            else:
                reader.start(name, match[3])
        else:
            reader.text("<")
            at = tag + 1
    reader.flush()
    return reader.blocks


def _first_pass(block: Block) -> int:
    size = len(block.text)
    if block.bad or block.linked > LINK_SHARE * size:
        return BAD
    if size < LONG_CHARS:
        return OPEN
    words = _WORD.findall(block.text.lower())
    share = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if share >= DENSE_SHARE:
        return GOOD
    return SPARSE if share < SPARSE_SHARE and not block.article else OPEN


def _second_pass(blocks: list[Block]) -> None:
    decided = [k for k, b in enumerate(blocks) if b.label != OPEN]
    labels = [b.label for b in blocks]
    following = 0
    for k, block in enumerate(blocks):
        while following < len(decided) and decided[following] < k:
            following += 1
        if block.label == OPEN:
            before = decided[following - 1] if following else None
            after = decided[following] if following < len(decided) else None
            if before is None and after is None:
                block.label = GOOD
            elif after is None or before is not None and k - before <= after - k:
                block.label = labels[before]
            else:
                block.label = labels[after]


def main_blocks(page: str | None) -> list[str]:
    """Texts of the good blocks, in page order."""
    page = page or ""
    blocks = read_blocks(page)
    declared = _LANGUAGE.search(page)
    found = _decided(blocks, declared[1].lower()[:2] if declared else None)
    held: dict[int, int] = {}
    for block in blocks:
        if block.named:
            held[block.named] = held.get(block.named, 0) + len(block.text) - block.linked
    if found or not held:
        return found
    # Nothing is left but what a name rules out: the name is not heeded where most of the text is.
    most = max(held, key=lambda k: (held[k], -k))
    for block in blocks:
        block.label = OPEN
        if block.named == most:
            block.bad, block.named = False, 0
    return _decided(blocks, declared[1].lower()[:2] if declared else None)


def _decided(blocks: list[Block], language: str | None) -> list[str]:
    for block in blocks:
        block.label = _first_pass(block)
    dense, thin = ([len(b.text) for b in blocks if b.label == label] for label in (GOOD, SPARSE))
    covered = language in COVERED if language else len(dense) >= len(thin) or sum(dense) >= sum(thin)
    sparse = BAD if covered and dense else GOOD
    for block in blocks:
        if block.label == SPARSE:
            block.label = sparse
    inside = [b for b in blocks if b.article and not b.bad]
    around = [b for b in blocks if not b.article and not b.bad]
    _second_pass(inside)
    _second_pass(around)
    held = sum(len(b.text) for b in inside if b.label == GOOD)
    if held and held >= sum(len(b.text) for b in around if b.label == GOOD):
        for block in around:
            block.label = BAD
    return [b.text for b in blocks if b.label == GOOD]


def extracted(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, ``text`` and ``n_chars`` of every page."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = ["\n".join(main_blocks(x)) for x in batch.column(len(keep)).to_pylist()]
        sizes = pa.array([len(x) for x in texts], pa.int64())
        return pa.record_batch(
            [*batch.columns[: len(keep)], pa.array(texts, pa.string()), sizes], [*keep, "text", "n_chars"]
        )

    source = pages.select(*keep, F.col(html).alias("__html"))
    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in keep)
    return map_text(source, "__html", run, f"{kinds}, text string, n_chars bigint")
