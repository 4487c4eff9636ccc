"""Chat formatting: a small sandboxed template language, compiled to Python closures.

A template is parsed into a syntax tree, constant parts are folded, and every node becomes a closure that yields pieces of
text, each marked as generated or not. The language has ``{{ expression }}``, ``{% for x in list %}``, ``{% if %}`` /
``{% elif %}`` / ``{% else %}``, ``{% set name = expression %}`` and ``{% generation %}`` ... ``{% endgeneration %}``, which marks
what a model is trained to write. Expressions are literals, names, ``x.key`` and ``x['key']`` on mappings, ``loop.first``,
``loop.last``, ``loop.index0``, comparisons, ``and``, ``or``, ``not``, ``in``, ``+``, ``~`` and filters of a fixed list. There
are no calls, no attributes of objects and no imports, so a template can reach nothing but its input.

How it scales: turns are shuffled and sorted by conversation, then streamed. A conversation is rendered turn by turn
and given as one row per turn, so memory is bounded by one turn however long a conversation is.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings that steer chat models; inside texts they are escaped.
CONTROL = ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TURNS = (
    "{% for m in messages %}<|turn|>{{ m.role | field }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}<|end|>\n{% endfor %}"
)

_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))


def escape(text: str) -> str:
    """Text in which no control string is left: backslashes doubled, one put after the first sign of each control string."""
    return _CONTROL.sub(lambda found: f"{found[0][0]}\\{found[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


def field(text: str) -> str:
    """``escape`` for a text that must stay on one line."""
    return escape(text).replace("\n", "\\\n")


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape, "field": field, "trim": lambda text: text.strip(), "upper": lambda text: text.upper(), "lower": lambda text: text.lower(),
}


class TemplateError(ValueError):
    """The template is not in the language, or asks for what its input does not hold."""


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: object
    key: object


@dataclass(frozen=True)
class Filter:
    of: object
    name: str


@dataclass(frozen=True)
class Op:
    sign: str
    args: tuple


@dataclass(frozen=True)
class For:
    name: str
    items: object
    body: tuple


@dataclass(frozen=True)
class If:
    arms: tuple  # (condition, body), the last condition may be Const(True)


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class Generation:
    body: tuple


_PART = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[<>+~|.\[\]()]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """One expression by precedence: or, and, not, comparison, + and ~, filter, item."""

    def __init__(self, source: str):
        self._tokens: list[tuple[str, object]] = []
        at, source = 0, source.strip()
        while at < len(source):
            found = _TOKEN.match(source, at)
            if not found:
                raise TemplateError(f"unreadable expression: {source[at:]!r}")
            at = found.end()
            number, string, name, sign = found.groups()
            if number is not None:
                self._tokens.append(("const", int(number)))
            elif string is not None:
                self._tokens.append(("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), string[1:-1], flags=re.S)))
            elif name is not None:
                self._tokens.append(("name", name))
            else:
                self._tokens.append(("sign", sign))
        self._at = 0

    def _peek(self) -> object:
        return self._tokens[self._at] if self._at < len(self._tokens) else ("end", None)

    def _take(self, kind: str, value: object = None) -> object:
        found = self._peek()
        if found[0] != kind or (value is not None and found[1] != value):
            raise TemplateError(f"expected {value or kind}, found {found[1]!r}")
        self._at += 1
        return found[1]

    def _is(self, kind: str, *values: object) -> bool:
        found = self._peek()
        return found[0] == kind and found[1] in values

    def whole(self) -> object:
        out = self._either()
        if self._peek()[0] != "end":
            raise TemplateError(f"unexpected {self._peek()[1]!r}")
        return out

    def _either(self) -> object:
        out = self._both()
        while self._is("name", "or"):
            self._at += 1
            out = Op("or", (out, self._both()))
        return out

    def _both(self) -> object:
        out = self._negated()
        while self._is("name", "and"):
            self._at += 1
            out = Op("and", (out, self._negated()))
        return out

    def _negated(self) -> object:
        if self._is("name", "not"):
            self._at += 1
            return Op("not", (self._negated(),))
        left = self._sum()
        if self._is("sign", "==", "!=", "<", ">", "<=", ">=") or self._is("name", "in"):
            sign = self._take(self._peek()[0])
            return Op(sign, (left, self._sum()))
        return left

    def _sum(self) -> object:
        out = self._filtered()
        while self._is("sign", "+", "~"):
            sign = self._take("sign")
            out = Op(sign, (out, self._filtered()))
        return out

    def _filtered(self) -> object:
        out = self._item()
        while self._is("sign", "|"):
            self._at += 1
            name = self._take("name")
            if name not in FILTERS:
                raise TemplateError(f"unknown filter {name}")
            out = Filter(out, name)
        return out

    def _item(self) -> object:
        kind, value = self._peek()
        if kind == "const":
            self._at += 1
            out: object = Const(value)
        elif kind == "name":
            self._at += 1
            fixed = {"true": True, "false": False, "none": None}
            out = Const(fixed[value]) if value in fixed else Name(value)
        else:
            self._take("sign", "(")
            out = self._either()
            self._take("sign", ")")
        while self._is("sign", ".", "["):
            if self._take("sign") == ".":
                out = Item(out, Const(self._take("name")))
            else:
                out = Item(out, self._either())
                self._take("sign", "]")
        return out


def parsed(source: str) -> tuple:
    """The syntax tree of a template."""
    parts: list[tuple[str, str]] = []
    at, strip_next = 0, False
    for found in _PART.finditer(source):
        text = source[at : found.start()]
        text = text.lstrip() if strip_next else text
        dash_before, dash_after = found[1] or found[4], found[3] or found[6]
        parts.append(("text", text.rstrip() if dash_before else text))
        if found[2] is not None:
            parts.append(("value", found[2]))
        elif found[5] is not None:
            parts.append(("tag", found[5].strip()))
        strip_next, at = bool(dash_after), found.end()
    rest = source[at:]
    parts.append(("text", rest.lstrip() if strip_next else rest))
    body, end, left = _body(parts, 0, ())
    if end:
        raise TemplateError(f"unexpected {end}")
    return body


def _body(parts: list, at: int, stops: tuple[str, ...]) -> tuple[tuple, str, int]:
    """Nodes up to a tag whose first word is in ``stops``: (nodes, that tag, place after it)."""
    nodes: list[object] = []
    while at < len(parts):
        kind, value = parts[at]
        at += 1
        if kind == "text":
            if value:
                nodes.append(Text(value))
        elif kind == "value":
            nodes.append(_Expression(value).whole())
        else:
            word, _, rest = value.partition(" ")
            if word in stops:
                return tuple(nodes), value, at
            if word == "for":
                found = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)
                if not found:
                    raise TemplateError(f"unreadable loop: {value!r}")
                inner, _, at = _closed(parts, at, ("endfor",))
                nodes.append(For(found[1], _Expression(found[2]).whole(), inner))
            elif word == "if":
                arms, condition = [], _Expression(rest).whole()
                while True:
                    inner, end, at = _closed(parts, at, ("elif", "else", "endif"))
                    arms.append((condition, inner))
                    if end == "endif":
                        break
                    condition = Const(True) if end == "else" else _Expression(end.partition(" ")[2]).whole()
                nodes.append(If(tuple(arms)))
            elif word == "set":
                name, sign, expression = rest.partition("=")
                if not sign or not re.fullmatch(r"[A-Za-z_]\w*", name.strip()):
                    raise TemplateError(f"unreadable assignment: {value!r}")
                nodes.append(Set(name.strip(), _Expression(expression).whole()))
            elif word == "generation":
                inner, _, at = _closed(parts, at, ("endgeneration",))
                nodes.append(Generation(inner))
            else:
                raise TemplateError(f"unknown tag {value!r}")
    return tuple(nodes), "", at


def _closed(parts: list, at: int, stops: tuple[str, ...]) -> tuple[tuple, str, int]:
    body, end, at = _body(parts, at, stops)
    if not end:
        raise TemplateError(f"missing {stops[-1]}")
    return body, end, at


_OPS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b, "in": lambda a, b: a in b, "~": lambda a, b: _shown(a) + _shown(b), "not": lambda a: not a,
}


def _plus(a: object, b: object) -> object:
    if isinstance(a, str) != isinstance(b, str):
        raise TemplateError("+ joins two texts or adds two numbers")
    return a + b


_OPS["+"] = _plus


def _shown(value: object) -> str:
    return "" if value is None else str(value)


def folded(node: object) -> object:
    """The node with constant parts computed, arms that cannot be taken removed, and neighbouring texts joined."""
    if isinstance(node, tuple):
        out: list[object] = []
        for part in map(folded, node):
            for one in part if isinstance(part, tuple) else (part,):
                if isinstance(one, Const):
                    one = Text(_shown(one.value))
                if isinstance(one, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].value + one.value)
                elif not (isinstance(one, Text) and not one.value):
                    out.append(one)
        return tuple(out)
    if isinstance(node, Item):
        return Item(folded(node.of), folded(node.key))
    if isinstance(node, Filter):
        inner = folded(node.of)
        return Const(FILTERS[node.name](_shown(inner.value))) if isinstance(inner, Const) else Filter(inner, node.name)
    if isinstance(node, Op):
        args = tuple(map(folded, node.args))
        first = args[0]
        if node.sign in ("and", "or") and isinstance(first, Const):
            return args[1] if bool(first.value) == (node.sign == "and") else first
        if node.sign not in ("and", "or") and all(isinstance(arg, Const) for arg in args):
            return Const(_OPS[node.sign](*(arg.value for arg in args)))
        return Op(node.sign, args)
    if isinstance(node, For):
        return For(node.name, folded(node.items), folded(node.body))
    if isinstance(node, Set):
        return Set(node.name, folded(node.value))
    if isinstance(node, Generation):
        return Generation(folded(node.body))
    if isinstance(node, If):
        arms = []
        for condition, body in node.arms:
            condition = folded(condition)
            if isinstance(condition, Const) and not condition.value:
                continue
            arms.append((condition, folded(body)))
            if isinstance(condition, Const):
                break
        if arms and isinstance(arms[0][0], Const):
            return arms[0][1]
        return If(tuple(arms)) if arms else ()
    return node


def _value(node: object) -> Callable[[dict], object]:
    """Closure that computes an expression in a scope of names."""
    if isinstance(node, Const):
        value = node.value
        return lambda scope: value
    if isinstance(node, Name):
        name = node.name

        def of_name(scope: dict) -> object:
            if name not in scope:
                raise TemplateError(f"unknown name {name}")
            return scope[name]

        return of_name
    if isinstance(node, Item):
        of, key = _value(node.of), _value(node.key)

        def of_item(scope: dict) -> object:
            holder, place = of(scope), key(scope)
            if not isinstance(holder, (dict, list, tuple)):
                raise TemplateError("only mappings and lists have items")
            try:
                return holder[place]
            except (KeyError, IndexError, TypeError) as error:
                raise TemplateError(f"no item {place!r}") from error

        return of_item
    if isinstance(node, Filter):
        inner, change = _value(node.of), FILTERS[node.name]
        return lambda scope: change(_shown(inner(scope)))
    args = [_value(arg) for arg in node.args]
    if node.sign == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if node.sign == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    compute = _OPS[node.sign]
    return lambda scope: compute(*(arg(scope) for arg in args))


#: Yielded after every round of an outermost loop, where a rendering may be cut.
CUT = (None, False)


def _render(node: object, depth: int = 0) -> Callable[[dict, bool], Iterator[tuple[str | None, bool]]]:
    """Closure that yields (piece, is generated)."""
    if isinstance(node, tuple):
        parts = [_render(part, depth) for part in node]

        def of_parts(scope: dict, marked: bool) -> Iterator:
            for part in parts:
                yield from part(scope, marked)

        return of_parts
    if isinstance(node, Text):
        text = node.value

        def of_text(scope: dict, marked: bool) -> Iterator:
            yield text, marked

        return of_text
    if isinstance(node, Generation):
        body = _render(node.body, depth)
        return lambda scope, marked: body(scope, True)
    if isinstance(node, Set):
        name, value = node.name, _value(node.value)

        def of_set(scope: dict, marked: bool) -> Iterator:
            scope[name] = value(scope)
            return iter(())

        return of_set
    if isinstance(node, If):
        arms = [(_value(condition), _render(body, depth)) for condition, body in node.arms]

        def of_if(scope: dict, marked: bool) -> Iterator:
            for condition, body in arms:
                if condition(scope):
                    yield from body(scope, marked)
                    return

        return of_if
    if isinstance(node, For):
        name, items, body = node.name, _value(node.items), _render(node.body, depth + 1)

        def of_for(scope: dict, marked: bool) -> Iterator:
            inner, missing = dict(scope), object()
            stream = iter(items(scope))
            item, index = next(stream, missing), 0
            while item is not missing:
                after = next(stream, missing)
                inner[name] = item
                inner["loop"] = {"index0": index, "index": index + 1, "first": index == 0, "last": after is missing}
                yield from body(inner, marked)
                if depth == 0:
                    yield CUT
                item, index = after, index + 1

        return of_for
    value = _value(node)

    def of_value(scope: dict, marked: bool) -> Iterator:
        yield _shown(value(scope)), marked

    return of_value


class Template:
    """A compiled template; ``pieces`` renders the messages (any iterable of mappings) as they come."""

    def __init__(self, source: str):
        self.tree = folded(parsed(source))
        self._run = _render(self.tree)

    def pieces(self, messages: Iterable[dict]) -> Iterator[tuple[str | None, bool]]:
        return self._run({"messages": messages}, False)

    def parts(self, messages: Iterable[dict]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """Text between cuts with the spans in it that are generated."""
        texts: list[str] = []
        spans: list[tuple[int, int]] = []
        at = 0
        for text, marked in self.pieces(messages):
            if text is None:
                yield "".join(texts), spans
                texts, spans, at = [], [], 0
            elif text:
                texts.append(text)
                if marked:
                    if spans and spans[-1][1] == at:
                        spans[-1] = (spans[-1][0], at + len(text))
                    else:
                        spans.append((at, at + len(text)))
                at += len(text)
        if texts:
            yield "".join(texts), spans


_PARTS = "conv_id long, part long, formatted string, starts array<long>, ends array<long>"
_ROWS = 500


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


class _Format:
    def __init__(self, source: str):
        self._source = source

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(self._source)
        rows: list[tuple] = []
        for conv, turns in groupby(_stream(batches), key=lambda row: row[0]):
            messages = ({"role": role or "", "text": text or ""} for _, _, role, text in turns)
            for part, (text, spans) in enumerate(template.parts(messages)):
                rows.append((conv, part, text, [a for a, _ in spans], [b for _, b in spans]))
                if len(rows) >= _ROWS:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[p.split(" ")[0] for p in _PARTS.split(", ")])


def format_conversations(turns: DataFrame, template: str = TURNS, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """(conv_id, part, formatted, starts, ends): the rendering of every conversation, one row per turn of an outer loop;
    joined by ``part`` the rows are the whole text, and [start, end) are its generated characters in each.

    Turns come by their number, then role and text; equal rows are turns of their own, a null turn number comes first, a
    null role or text is empty. Rows without a conversation are left out, as are further columns. Rows of a conversation
    stay together and in order in their partition.
    """
    Template(template)  # errors show here, not in the tasks
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    ).where("conv_id is not null")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_Format(template), _PARTS)


_TURN = re.compile(r"<\|turn\|>((?:[^\\\n]|\\.)*)\n((?:[^\\<]|\\.|<(?!\|))*)<\|end\|>\n", re.S)


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns in a rendering with the template ``TURNS``."""
    out, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError("the text is not a rendering of this template")
        out.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return out
