"""Chat templates as columns: loops, conditions and filters over messages and tools, compiled to one expression.

The language is the part of the usual template notation that chat templates live on: ``{{ value }}``; ``{% if %}``,
``{% elif %}``, ``{% else %}``, ``{% endif %}``; ``{% for x in list %}`` with ``loop.first``, ``loop.last``, ``loop.index``
and ``loop.index0``; ``{% set name = value %}``; ``{# comments #}``; a dash inside a mark trims the blanks beside it.
Values are texts, numbers, names, ``a.b``, ``a['b']``, ``list[0]``, ``a + b``, comparisons, ``in``, ``not``, ``and``,
``or``, ``is defined`` and ``is none``, and the filters ``trim``, ``length``, ``upper``, ``lower``, ``tojson`` and ``default``.

A template is parsed once, on the driver; what runs is a Column, so rendering stays inside the engine's own code. Lists
are arrays of structs (``messages``) or of JSON texts (``tools``, for which ``tojson`` gives the text itself). A missing
name is null; null renders as nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from callmetrics.operators.parse import CALL_START

MARKS = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.DOTALL)
WORDS = re.compile(r"\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[<>+|.\[\]()~]))")
ESCAPES = {"\\n": "\n", "\\t": "\t", "\\'": "'", '\\"': '"', "\\\\": "\\"}
FILTERS: dict[str, Callable[[Column], Column]] = {
    "trim": lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""),
    "upper": F.upper,
    "lower": F.lower,
    "tojson": lambda c: c,
    "string": lambda c: c.cast("string"),
}
COMPARED = {"==": lambda a, b: a.eqNullSafe(b), "!=": lambda a, b: ~a.eqNullSafe(b), "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}


class TemplateError(ValueError):
    """A template that isn't in the language."""


class _Listed:
    """A list: its column and what an element is."""

    def __init__(self, column: Column, size: Column | None = None):
        self.column, self.size = column, F.size(column) if size is None else size


class _Reader:
    """The words of one expression, and their value in an environment of columns."""

    def __init__(self, source: str, names: dict[str, Any]):
        self.words, self.names, at = [], names, 0
        source = source.strip()
        while at < len(source):
            found = WORDS.match(source, at)
            if not found:
                raise TemplateError(f"can't read: {source[at:]}")
            self.words.append((found.lastgroup, found.group(found.lastgroup)))
            at = found.end()

    def next(self, *wanted: str) -> str | None:
        if self.words and self.words[0][0] != "text" and self.words[0][1] in wanted:
            return self.words.pop(0)[1]
        return None

    def must(self, word: str) -> None:
        if not self.next(word):
            raise TemplateError(f"{word} is missing")

    def whole(self) -> Any:
        value = self.any_of()
        if self.words:
            raise TemplateError(f"can't read: {self.words[0][1]}")
        return value

    def any_of(self) -> Any:
        value = self.all_of()
        while self.next("or"):
            value = truth(value) | truth(self.all_of())
        return value

    def all_of(self) -> Any:
        value = self.negated()
        while self.next("and"):
            value = truth(value) & truth(self.negated())
        return value

    def negated(self) -> Any:
        return ~truth(self.negated()) if self.next("not") else self.compared()

    def compared(self) -> Any:
        value = self.added()
        if sign := self.next(*COMPARED):
            return COMPARED[sign](value, self.added())
        if self.next("in"):
            return F.coalesce(F.contains(self.added(), value), F.lit(False))
        if self.next("is"):
            other = bool(self.next("not"))
            word = self.next("defined", "none", "string")
            if word is None:
                raise TemplateError("is what?")
            there = (value.column if isinstance(value, _Listed) else value).isNotNull()
            return there if (word == "none") == other else ~there
        return value

    def added(self) -> Any:
        value = self.filtered()
        while self.next("+", "~"):  # of texts
            other = self.filtered()
            value = F.concat(*[F.coalesce(x.cast("string"), F.lit("")) for x in (value, other)])
        return value

    def filtered(self) -> Any:
        value = self.place()
        while self.next("|"):
            name = self.words.pop(0)[1] if self.words else ""
            if name == "length":
                value = value.size if isinstance(value, _Listed) else F.length(value)
            elif name == "default":
                self.must("(")
                value = F.coalesce(value, self.any_of())
                self.must(")")
            elif name in FILTERS:
                value = FILTERS[name](value)
            else:
                raise TemplateError(f"no filter {name}")
        return value

    def place(self) -> Any:
        value = self.thing()
        while sign := self.next(".", "["):
            kind, word = self.words.pop(0) if self.words else ("", "")
            if sign == "." or kind == "text":
                key = word if sign == "." else _text(word)
                value = value[key] if isinstance(value, dict) else F.lit(None).cast("string") if value is None else value.getField(key)
            elif kind == "number":
                value = F.get(value.column if isinstance(value, _Listed) else value, F.lit(int(word)))
            else:
                raise TemplateError(f"can't go to {word}")
            if sign == "[":
                self.must("]")
        return value

    def thing(self) -> Any:
        if self.next("("):
            value = self.any_of()
            self.must(")")
            return value
        if not self.words:
            raise TemplateError("a value is missing")
        kind, word = self.words.pop(0)
        if kind == "text":
            return F.lit(_text(word))
        if kind == "number":
            return F.lit(int(word))
        if word.lower() in ("true", "false", "none"):
            return F.lit({"true": True, "false": False, "none": None}[word.lower()])
        if kind != "name":
            raise TemplateError(f"can't begin with {word}")
        return self.names.get(word, F.lit(None).cast("string"))


def _text(quoted: str) -> str:
    return re.sub(r"\\.", lambda m: ESCAPES.get(m.group(), m.group()[1:]), quoted[1:-1], flags=re.DOTALL)


def truth(value: Any) -> Column:
    """A list with elements, a text with characters, and true hold; null doesn't."""
    if isinstance(value, _Listed):
        return F.coalesce(value.size > 0, F.lit(False))
    if isinstance(value, dict):
        return F.lit(True)
    text = value.cast("string")
    return F.coalesce((text != "") & (text != "false") & (text != "0"), F.lit(False))


def _pieces(source: str) -> list[tuple[str, str]]:
    """(kind, content) of a template: text, value or order, blanks beside dashed marks trimmed."""
    parts = MARKS.split(source)
    made: list[tuple[str, str]] = []
    for i, part in enumerate(parts):
        if i % 2 == 0:
            if i and parts[i - 1][-3] == "-":
                part = part.lstrip()
            if i + 1 < len(parts) and parts[i + 1][2] == "-":
                part = part.rstrip()
            if part:
                made.append(("text", part))
        elif part[1] != "#":
            made.append(("value" if part[1] == "{" else "order", part[2:-2].strip("-").strip()))
    return made


def _until(pieces: list[tuple[str, str]], at: int, *ends: str) -> tuple[list, int]:
    """The block from a piece on as a tree, and the piece that ends it."""
    block: list = []
    while at < len(pieces):
        kind, content = pieces[at]
        word = content.split(" ", 1)[0] if kind == "order" else ""
        if word in ends:
            return block, at
        if word == "for":
            found = re.fullmatch(r"for\s+(\w+)\s+in\s+(.+)", content, re.DOTALL)
            if not found:
                raise TemplateError(content)
            body, at = _until(pieces, at + 1, "endfor")
            block.append(("for", found[1], found[2], body))
        elif word == "if":
            ways, other = [], []
            while word in ("if", "elif"):
                condition = content.split(" ", 1)[1]
                body, at = _until(pieces, at + 1, "elif", "else", "endif")
                ways.append((condition, body))
                content = pieces[at][1]
                word = content.split(" ", 1)[0]
            if word == "else":
                other, at = _until(pieces, at + 1, "endif")
            block.append(("if", ways, other))
        elif word == "set":
            found = re.fullmatch(r"set\s+(\w+)\s*=\s*(.+)", content, re.DOTALL)
            if not found:
                raise TemplateError(content)
            block.append(("set", found[1], found[2]))
        elif kind == "order":
            raise TemplateError(f"no order {content}")
        else:
            block.append((kind, content))
        at += 1
    if ends:
        raise TemplateError(f"{ends[-1]} is missing")
    return block, at


def _compiled(block: list, names: dict[str, Any]) -> Column:
    names, parts = dict(names), []
    for node in block:
        if node[0] == "text":
            parts.append(F.lit(node[1]))
        elif node[0] == "value":
            value = _Reader(node[1], names).whole()
            parts.append(F.coalesce((F.to_json(value.column) if isinstance(value, _Listed) else value).cast("string"), F.lit("")))
        elif node[0] == "set":
            names[node[1]] = _Reader(node[2], names).whole()
        elif node[0] == "if":
            made = _compiled(node[2], names)
            for condition, body in reversed(node[1]):
                made = F.when(truth(_Reader(condition, names).whole()), _compiled(body, names)).otherwise(made)
            parts.append(made)
        else:
            parts.append(_looped(node, names))
    return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else F.lit("")


def _looped(node: tuple, names: dict[str, Any]) -> Column:
    listed = _Reader(node[2], names).whole()
    listed = listed if isinstance(listed, _Listed) else _Listed(listed)

    def body(x: Column, i: Column) -> Column:
        loop = {"first": i == 0, "last": i == listed.size - 1, "index0": i, "index": i + 1, "length": listed.size}
        return _compiled(node[3], names | {node[1]: x, "loop": loop})

    return F.coalesce(F.array_join(F.transform(listed.column, body), ""), F.lit(""))


def render(template: str, messages: Column, tools: Column | None = None, add_generation_prompt: bool = False, **more: Any) -> Column:
    """The text of a template over ``messages`` (an array of structs) and ``tools`` (an array of JSON texts)."""
    block, _ = _until(_pieces(template), 0)
    names = {"messages": _Listed(messages), "add_generation_prompt": F.lit(add_generation_prompt), **{k: v if isinstance(v, Column) else F.lit(v) for k, v in more.items()}}
    names["tools"] = _Listed(F.lit(None).cast("array<string>"), F.lit(0)) if tools is None else _Listed(tools)
    return _compiled(block, names)


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def rendered_pair(template: str, tools: Column, query: Column, completion: Column) -> Column:
    """(prompt, completion, problem) of a record by its template: what stands before the call in the whole text is the
    prompt, marks of the assistant's turn included; ``problem`` says why a template won't do, null if it does."""
    ask = [_message("user", query)]
    before = render(template, F.array(*ask), tools, True, enable_thinking=False)
    whole = render(template, F.array(*ask, _message("assistant", completion)), tools, False, enable_thinking=False)
    rest = F.substr(whole, F.length(before) + 1)
    at = F.locate(CALL_START, rest)
    problem = F.when(~whole.startswith(before), "prompt and completion are not a stable prefix").when(at == 0, "rendered completion does not contain a tool call")
    good = lambda c: F.when(problem.isNull(), c)
    return F.struct(good(F.concat(before, F.substr(rest, F.lit(1), at - 1))).alias("prompt"), good(F.substr(rest, at)).alias("completion"), problem.alias("problem"))


def tools_prompt(template: str, tools: Column, query: Column, name: Column) -> Column:
    """The prompt of tools alone, marks of the assistant's turn included: found with a probing call; where the template has
    no stable prefix the text with its generation prompt."""
    from callmetrics.operators.render import completion as call

    pair = rendered_pair(template, tools, query, call(name, F.lit("{}")))
    return F.coalesce(pair["prompt"], render(template, F.array(_message("user", query)), tools, True, enable_thinking=False))
