"""HTML extraction with consensus paths: what most pages of a host call their main container is used for all of them.

Every page is walked once; its containers are scored by the text of their paragraphs, less what is link text, and
by what their names suggest. The page votes for the generalised tag-class path of its best container. Votes are counted
per host and path in Spark, so a host with very many pages is a small aggregate; the path with most votes wins.
Then every page is read again by the winning path; a page without a container there uses the path of its own best. Below
each child of the body that holds such a container, the text is the smallest container around it and around every
paragraph, so parts beside the winner are kept, however small. Added are main headings, text that stands in the body itself,
and sections and articles with paragraphs that are children of the body. What is only links is left out, unless it lies on the path.

A container gives a share of its score to the one above, so the innermost container that holds all parts of a content
beats the largest part. Lists are no containers of their own, and a table gives what it has to the text around it.
Markup is read forwards once: a page takes time in proportion to its length, finished or not.

How it scales: two narrow reads of the pages; only (host, path) counts are shuffled, and the winners are one row per
host, joined by Spark's own choice of size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.llm.common import written

_START = re.compile(r"<!--|<([!?])|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_QUOTED = re.compile(r"(?:[^'\">]++|\"[^\"]*\"|'[^']*')*+>")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[a-z]+")

_RAW = frozenset("script style noscript template textarea iframe title svg math object select".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("head nav footer aside form button dialog menu figure label fieldset".split())
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th caption figcaption summary".split())
_BLOCK = _LEAF | _DROPPED | frozenset(
    "html body div section article main header ul ol dl table thead tbody tfoot tr address details hr center".split()
)
_CLOSES_P = _BLOCK - {"html", "body", "td", "th"}
_LISTS = frozenset("ul ol dl".split())
#: Share of a container's score that the one above gets; parts of tables pass on nearly all, so that ties go inwards.
SHARE = 0.75
_SHARES = dict.fromkeys("table thead tbody tfoot".split(), 0.99)
#: Words in a class, id or role that mark what is no article.
_NOISE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus "
    "footer header masthead menu nav navigation navbar newsletter notice popup modal promo promoted related recommended share sharing "
    "sidebar social sponsor sponsored subscribe subscription toolbar widget widgets signup login search pagination pager contentinfo "
    "complementary alert discussion replies reply".split()
)
_GOOD = frozenset("article content entry post story text main body blog".split())
_SAME_AGAIN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_TABLE_PARTS = frozenset("table thead tbody tfoot tr td th".split())
#: Children of the body that say themselves that they are content.
_CONTENT = frozenset("article main section".split())
_RIGHTS = re.compile(r"©|\(c\)\s*\d{4}|copyright\b", re.I)
#: Characters outside of links that make a block a paragraph.
PARAGRAPH = 25


@dataclass(eq=False)
class _Box:
    """A container of a page: its text blocks, those of its children included, are those from ``first`` to ``last``."""

    tag: str
    step: str
    bonus: float
    parent: _Box | None
    top: _Box | None = None  # its ancestor that is a child of the body, maybe itself
    depth: int = 0
    score: float = 0.0
    first: int = 0
    last: int = 0

    @property
    def path(self) -> str:
        steps, box = [], self
        while box.parent is not None:
            steps.append(box.step)
            box = box.parent
        return "".join(f">{step}" for step in reversed(steps))


class _Common:
    """The smallest container around all containers given so far; every container is climbed over once."""

    def __init__(self, box: _Box):
        self.box, self._under = box, {box}

    def add(self, box: _Box) -> None:
        while box not in self._under:
            level = box.depth - self.box.depth
            if level <= 0:
                self.box = self.box.parent
                self._under.add(self.box)
            if level >= 0:
                self._under.add(box)
                box = box.parent


def _names(attributes: str) -> tuple[str, set[str]]:
    """Generalised classes for the path, and all words of class, id and role."""
    classes, words = "", set()
    if "=" in attributes:
        for kind, *values in _ATTRIBUTE.findall(attributes):
            value = "".join(values).lower()
            if kind.lower() == "class":
                classes = "".join(f".{name}" for name in sorted({re.sub(r"\d+", "#", name).replace(">", "_") for name in value.split()}))
            words.update(_NAME.findall(value))
    return classes, words


def _is_closed(attributes: str) -> bool:
    """Whether a start tag ends itself; the slash at the end of a bare value does not."""
    bare = attributes.rstrip()
    return bare.endswith("/") and (len(bare) == 1 or bare[-2] in " \t\r\n\f\"'")


class Page:
    """Blocks and scored containers of one page."""

    def __init__(self, html: str):
        self.blocks: list[str] = []
        self._owners: list[_Box] = []
        self._paragraphs: list[bool] = []
        self._alone: set[int] = set()
        self._root = _Box("", "", 0.5, None)
        self.boxes: list[_Box] = [self._root]
        self._stack: list[tuple[str, _Box | None, bool]] = []  # tag, box (None: transparent or leaf), dropped
        self._open_blocks: list[str] = []
        self._open_tags: list[Counter] = [Counter()]  # open inline tags by block; of blocks in the first one
        self._box = self._root
        self._dropped = 0
        self._text: list[str] = []
        self._in_link, self._link_chars = 0, 0
        self._read(html)

    def _read(self, html: str) -> None:
        at, size, quotes = 0, len(html), True
        while at < size:
            found = _START.search(html, at)
            if not found:
                self._add(html[at:])
                break
            self._add(html[at : found.start()])
            at = found.end()
            if found[0] == "<!--":
                end = html.find("-->", at)
                at = size if end < 0 else end + 3
                continue
            if found[1]:
                end = html.find(">", at)
                at = size if end < 0 else end + 1
                continue
            whole = _QUOTED.match(html, at) if quotes else None
            end = whole.end() if whole else html.find(">", at) + 1
            if not end:  # an unfinished tag at the end is no text
                break
            quotes = quotes and whole is not None  # a quote that never closes: from here on the next bracket ends a tag
            tag, attributes, at = found[3].lower(), html[at : end - 1], end
            if found[2]:
                self._close(tag)
            elif tag in _RAW and not _is_closed(attributes):
                after = re.compile(f"</{tag}[\\s/>]", re.I).search(html, at)
                stop = html.find(">", after.end() - 1) if after else -1
                at = size if stop < 0 else stop + 1
            else:
                self._open(tag, attributes)
        self._flush()
        while self._stack:
            self._pop()
        self._root.last = len(self.blocks)

    def _add(self, raw: str) -> None:
        if raw and not self._dropped:
            text = unescape(raw) if "&" in raw else raw
            self._text.append(text)
            if self._in_link:
                self._link_chars += len(text.strip())

    def _flush(self) -> None:
        """End the current block and give its score to its container."""
        if self._text:
            text = " ".join("".join(self._text).split())
            self._text = []
            if text:
                own = max(0.0, len(text) - 2.0 * self._link_chars)
                self._box.score += own * (0.3 if len(text) < PARAGRAPH else 1.0)
                if own and self._stands_alone(text):
                    self._alone.add(len(self.blocks))
                self.blocks.append(text)
                self._owners.append(self._box)
                self._paragraphs.append(own >= PARAGRAPH)
        self._link_chars = 0

    def _stands_alone(self, text: str) -> bool:
        """Whether a block is content wherever its containers are: main headings, and text in the body itself but for rights."""
        leaf = self._open_blocks[-1] if self._open_blocks else ""
        if leaf == "h1":
            return True
        return self._box is self._root and (leaf == "p" or len(text) >= PARAGRAPH) and not _RIGHTS.match(text)

    def _open(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self._text.append(" ")
            return
        if tag in _BLOCK:
            self._flush()
        if tag in _VOID:
            return
        if tag in _BLOCK and self._open_blocks and self._open_blocks[-1] == "head":
            self._pop_to("head")
        if tag in _CLOSES_P and self._open_blocks and self._open_blocks[-1] == "p":
            self._pop_to("p")
        again = _SAME_AGAIN.get(tag)
        if again:
            for name in self._open_blocks[:-3:-1]:  # nothing but a paragraph may lie between
                if name in again:
                    self._pop_to(name)
                    break
                if name != "p":
                    break
            if tag == "tr" and self._open_blocks and self._open_blocks[-1] == "tr":
                self._pop_to("tr")
        if tag not in _BLOCK and _is_closed(attributes):
            return
        classes, words = _names(attributes)
        box, dropped = None, tag in _DROPPED and not (tag == "figure" and self._box is not self._root)
        if tag == "header":
            dropped = not (self._open_tags[0]["article"] or self._open_tags[0]["main"])
        if tag not in ("html", "body", "article", "main") and words & _NOISE and not words & {"article"}:
            dropped = dropped or tag in _BLOCK or tag in ("span", "a")
        if tag == "a":
            self._in_link += 1
        if tag in _BLOCK and tag not in _LEAF and tag not in _LISTS and not dropped and not self._dropped and tag not in ("html", "body"):
            bonus = {"article": 2.0, "main": 1.5}.get(tag, 1.0) * (1.3 if words & _GOOD else 1.0)
            box = _Box(tag, tag + classes, bonus, self._box, self._box.top, self._box.depth + 1, first=len(self.blocks))
            box.top = box.top or box
            self.boxes.append(box)
            self._box = box
        if dropped:
            self._dropped += 1
        self._stack.append((tag, box, dropped))
        if tag in _BLOCK:
            self._open_blocks.append(tag)
            self._open_tags[0][tag] += 1
            self._open_tags.append(Counter())
        else:
            self._open_tags[-1][tag] += 1

    def _pop(self) -> None:
        tag, box, dropped = self._stack.pop()
        if tag in _BLOCK:
            self._flush()
            self._open_blocks.pop()
            self._open_tags[0][tag] -= 1
            self._open_tags.pop()
        else:
            self._open_tags[-1][tag] -= 1
        if tag == "a":
            self._in_link -= 1
        if dropped:
            self._dropped -= 1
        if box is not None:
            box.last = len(self.blocks)
            box.parent.score += box.score * _SHARES.get(tag, SHARE)
            self._box = box.parent

    def _pop_to(self, tag: str) -> None:
        while self._stack:
            name = self._stack[-1][0]
            self._pop()
            if name == tag:
                return

    def _close(self, tag: str) -> None:
        if tag == "br":
            self._text.append(" ")
        elif tag in _BLOCK:
            self._flush()
        if self._open_tags[0 if tag in _BLOCK else -1][tag]:  # an inline end tag does not reach out of its block
            self._pop_to(tag)

    def _on(self, path: str) -> list[_Box]:
        """Containers with blocks on ``path``, in page order."""
        steps = path.split(">")[1:]
        agreeing, found = set(), []
        for box in self.boxes:
            if box.parent is None or box.depth <= len(steps) and box.parent in agreeing and box.step == steps[box.depth - 1]:
                agreeing.add(box)
                if box.depth == len(steps) and box.last > box.first:
                    found.append(box)
        return found

    def best(self, path: str | None = None) -> _Box | None:
        """The container with the highest score, the first of equals; only those on ``path`` if it is given."""
        chosen = None
        for box in self.boxes if path is None else self._on(path):
            if box.last > box.first and (chosen is None or box.score * box.bonus > chosen.score * chosen.bonus):
                chosen = box
        return chosen

    def text(self, box: _Box | None) -> str:
        """The main text of the page by the path of ``box``, blocks in page order.

        Cells of a table on the path that hold only links are menus; any other container there is content.
        """
        if box is None:
            return ""
        winners = [other for other in self._on(box.path) if other is box or other.score > 0 or other.tag not in _TABLE_PARTS]
        regions: dict[_Box | None, _Common] = {}
        for winner in winners:
            if winner.top in regions:
                regions[winner.top].add(winner)
            else:
                regions[winner.top] = _Common(winner)
        for owner, paragraph in zip(self._owners, self._paragraphs):
            top = owner.top
            if paragraph and top in regions:
                regions[top].add(owner)
            elif paragraph and top is not None and top.tag in _CONTENT:
                regions[top] = _Common(owner)
        kept = set(self._alone)
        for region in (common.box for common in regions.values()):
            kept.update(at for at in range(region.first, region.last) if self._owners[at] is region or self._owners[at].score > 0)
        for winner in winners:
            kept.update(range(winner.first, winner.last))
        return "\n\n".join(self.blocks[at] for at in sorted(kept))


class _Vote:
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, scores = [], []
            for html in batch.column(1).to_pylist():
                box = Page(html or "").best()
                paths.append(box.path if box else None)
                scores.append(box.score * box.bonus if box else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string()), pa.array(scores)], names=["host", "path", "score"])


class _Extract:
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, used = [], []
            for html, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                page = Page(html or "")
                box = (page.best(path) if path is not None else None) or page.best()
                texts.append(page.text(box))
                used.append(box.path if box else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(used, pa.string())],
                names=["page_id", "url", "text", "path"],
            )


def host_of(url: str):
    """Lower-case host of an absolute URL, without user and port; null if there is none."""
    host = F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(host, F.lit(""))


def consensus_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, pages): the container path that most pages of a host vote for; ties to the higher score, then path."""
    source = pages.select(host_of(url_col).alias("host"), F.col(html_col).cast("string").alias("html")).where("host is not null")
    votes = source.mapInArrow(_Vote(), "host string, path string, score double").where("path is not null")
    # scores are rounded so that the order of additions cannot decide a tie
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("pages"), F.sum(F.round("score").cast("long")).alias("score"))
    best = F.max(F.struct("pages", "score", "path")).alias("w")
    return written(counted.groupBy("host").agg(best).select("host", F.col("w.path").alias("path"), F.col("w.pages").alias("pages")))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page (id_col, url_col, text, path): blocks joined by two line feeds, white space inside a block as one blank.

    A null or empty page, and one without text, gives an empty text and a null path. A page whose URL has no host uses
    its own best container. Broken markup is read as far as it goes. Repeated rows are extracted once each;
    further columns are left out; an empty table gives no rows.
    """
    paths = consensus_paths(pages, url_col, html_col)
    source = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"), host_of(url_col).alias("host"),
    )
    joined = source.join(paths.select("host", "path"), "host", "left").select("page_id", "url", "html", "path")
    out = joined.mapInArrow(_Extract(), "page_id long, url string, text string, path string")
    return out.withColumnsRenamed({"page_id": id_col, "url": url_col})
