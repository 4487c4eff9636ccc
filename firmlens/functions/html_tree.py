"""Small HTML tree for the per-row parsing steps (standard library parser, no tree repair).

Elements nest exactly as their tags say: an unclosed element stays open until an enclosing element
closes, a self-closed or void element has no content, and a stray end tag is ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

# Elements without content, and elements whose text is not page text.
VOID = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link "
    "menuitem meta nextid param source spacer track wbr".split()
)
HIDDEN = frozenset({"script", "style", "template", "rt", "rp"})


class Element:
    """One element with its attributes, parent and ordered children (elements and strings)."""

    __slots__ = ("tag", "attrs", "parent", "children", "end", "start", "scope")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None) -> None:
        self.tag = tag
        self.attrs = attrs
        self.parent = parent
        self.children: list[Element | str] = []
        self.start = self.end = 0
        self.scope = None  # for the caller's walk

    def walk(self) -> Iterator[Element]:
        """All descendants in document order."""
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, Element):
                    yield child
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()

    def raw_text(self) -> str:
        return "".join(child for child in self.children if isinstance(child, str))

    def text(self) -> str:
        """Page text below this element, pieces joined by one blank."""
        pieces: list[str] = []
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, str):
                    piece = child.strip()
                    if piece:
                        pieces.append(piece)
                elif child.tag not in HIDDEN:
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()
        return " ".join(pieces)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("", {}, None)
        self.current = self.root
        self.open = Counter()
        self.joins = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        element = Element(tag, {name: value or "" for name, value in attrs}, self.current)
        self.current.children.append(element)
        self.joins = False
        if tag not in VOID:
            self.current = element
            self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.joins = False
        if not self.open[tag]:
            return
        while self.current.parent is not None:
            closed, self.current = self.current, self.current.parent
            self.open[closed.tag] -= 1
            if closed.tag == tag:
                return

    def handle_data(self, data: str) -> None:
        siblings = self.current.children
        if self.joins and siblings and isinstance(siblings[-1], str):
            siblings[-1] += data
        else:
            siblings.append(data)
        self.joins = True

    def handle_comment(self, data: str) -> None:
        self.joins = False

    handle_decl = handle_pi = unknown_decl = handle_comment


def parse_html(html: str) -> Element:
    """Parse one document. Markup the parser gives up on is kept up to there, with ``parse_error`` on the root.

    Nothing after the last closing bracket can be markup, so it is text (and dropped inside an unclosed script, as
    the parser does). The parser would find that out by reading to the end once for every unfinished tag.
    """
    builder = _Builder()
    cut = html.rfind(">") + 1
    try:
        builder.feed(html[:cut])
        builder.close()
        if cut < len(html) and builder.cdata_elem is None:
            builder.handle_data(unescape(html[cut:]))
    except (AssertionError, ValueError) as error:
        builder.root.attrs["parse_error"] = f"{type(error).__name__}: {error}"
    return builder.root


def _matches(element: Element, simple: str) -> bool:
    """Test ``tag``, ``.class`` and ``[attr]`` parts such as ``a.ob[href]``."""
    head, _, attribute = simple.partition("[")
    if attribute and attribute.rstrip("]") not in element.attrs:
        return False
    tag, *classes = head.split(".")
    if tag and element.tag != tag:
        return False
    if not classes:
        return True
    own = element.attrs.get("class", "").split()
    return all(name in own for name in classes)


def _matches_path(element: Element, steps: list[str], scope: Element) -> bool:
    """Match right to left: blanks mean descendant, ``>`` means child."""
    if not _matches(element, steps[-1]):
        return False
    rest = steps[:-1]
    if not rest:
        return True
    if rest[-1] == ">":
        parent = element.parent
        if rest[:-1] == [":scope"]:
            return parent is scope
        return parent is not None and _matches_path(parent, rest[:-1], scope)
    parent = element.parent
    while parent is not None:
        if _matches_path(parent, rest, scope):
            return True
        parent = parent.parent
    return False


def select(scope: Element, selector: str) -> Iterator[Element]:
    """Descendants matching any of the comma-separated selectors, in document order."""
    paths = [group.split() for group in selector.split(",")]
    for element in scope.walk():
        if any(_matches_path(element, path, scope) for path in paths):
            yield element


def select_one(scope: Element, selector: str) -> Element | None:
    return next(select(scope, selector), None)
