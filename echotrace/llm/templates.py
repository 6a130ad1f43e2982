"""A small sandboxed template language, compiled to Python closures.

``{{ expression }}`` writes; ``{% for x in messages %}``, ``{% if %}``/``{% elif %}``/``{% else %}`` and ``{% generation %}`` are closed
by their ``end...``.  Expressions have names, ``name.field``, strings in single quotes, ``+``, ``==``, ``!=``, ``and``, ``or``, ``not``,
parentheses and filters (``x | escape``).  Inside a loop there are ``loop.first``, ``loop.last`` and ``loop.index0``.  There are no
calls, no subscripts and no names from Python: fields come from the messages' dictionaries only.

Compiling parses into a tree, folds what is constant, and returns a generator function of ``(piece, generated)``; loops draw
their items one at a time, so a conversation of any length renders in the memory of one message.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*')|([A-Za-z][A-Za-z0-9_]*(?:\.[A-Za-z][A-Za-z0-9_]*)?)|(==|!=|[()+|])|$)")
_ESCAPES = {"n": "\n", "t": "\t", "'": "'", "\\": "\\"}
Filter = Callable[[str], str]
Render = Callable[[dict[str, Any]], Iterator[tuple[str, bool]]]


class TemplateError(ValueError):
    pass


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(source.rstrip()):
        m = _TOKEN.match(source, at)
        if not m or m.end() == at:
            raise TemplateError(f"can't read {source[at:]!r}")
        text, name, sign = m.groups()
        if text is not None:
            out.append(("text", re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), text[1:-1], flags=re.DOTALL)))
        elif name is not None:
            out.append(("word" if name in ("and", "or", "not", "in") else "name", name))
        elif sign is not None:
            out.append(("sign", sign))
        at = m.end()
    return out


class _Expression:
    """Recursive descent to tuples: ("const", v), ("get", name, field), ("not", a), (operator, a, b), ("filter", name, a)."""

    def __init__(self, source: str):
        self.tokens, self.at, self.source = _tokens(source), 0, source

    def take(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "text" and self.tokens[self.at][1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def whole(self) -> tuple:
        tree = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"something is left over in {self.source!r}")
        return tree

    def either(self) -> tuple:
        left = self.both()
        while self.take("or"):
            left = ("or", left, self.both())
        return left

    def both(self) -> tuple:
        left = self.negated()
        while self.take("and"):
            left = ("and", left, self.negated())
        return left

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        left = self.joined()
        sign = self.take("==", "!=")
        return (sign, left, self.joined()) if sign else left

    def joined(self) -> tuple:
        left = self.filtered()
        while self.take("+"):
            left = ("+", left, self.filtered())
        return left

    def filtered(self) -> tuple:
        left = self.atom()
        while self.take("|"):
            left = ("filter", self.next("name"), left)
        return left

    def next(self, kind: str) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != kind:
            raise TemplateError(f"a {kind} is missing in {self.source!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def atom(self) -> tuple:
        if self.take("("):
            tree = self.either()
            if not self.take(")"):
                raise TemplateError(f"a ) is missing in {self.source!r}")
            return tree
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "text":
            return ("const", self.next("text"))
        name, _, field = self.next("name").partition(".")
        return ("get", name, field)


def _parse(source: str) -> list:
    """Nodes: ("text", s), ("out", e), ("for", name, iterable, body), ("if", [(e, body)...]), ("generation", body)."""
    top: list = []
    stack: list[tuple[str, list, Any]] = [("", top, None)]
    at = 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            stack[-1][1].append(("text", source[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            stack[-1][1].append(("out", _Expression(m[1]).whole()))
            continue
        word, _, rest = m[2].strip().partition(" ")
        if word == "for":
            if not (f := re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+([A-Za-z]\w*)\s*", rest)):
                raise TemplateError(f"can't read the loop {rest!r}")
            body: list = []
            stack[-1][1].append(("for", f[1], f[2], body))
            stack.append(("for", body, None))
        elif word == "if":
            body, arms = [], []
            arms.append((_Expression(rest).whole(), body))
            stack[-1][1].append(("if", arms))
            stack.append(("if", body, arms))
        elif word in ("elif", "else") and stack[-1][0] == "if":
            arms, body = stack.pop()[2], []
            arms.append((_Expression(rest).whole() if word == "elif" else ("const", True), body))
            stack.append(("if", body, arms))
        elif word == "generation":
            body = []
            stack[-1][1].append(("generation", body))
            stack.append(("generation", body, None))
        elif word == f"end{stack[-1][0]}" and len(stack) > 1:
            stack.pop()
        else:
            raise TemplateError(f"{m[0]!r} is out of place")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} isn't closed")
    if at < len(source):
        top.append(("text", source[at:]))
    return top


def _fold(tree: tuple, filters: dict[str, Filter]) -> tuple:
    if tree[0] in ("const", "get"):
        return tree
    if tree[0] == "filter" and tree[1] not in filters:
        raise TemplateError(f"there is no filter {tree[1]}")
    parts = [_fold(x, filters) if isinstance(x, tuple) else x for x in tree[1:]]
    if all(x[0] == "const" for x in parts if isinstance(x, tuple)):
        return ("const", _evaluator((tree[0], *parts), filters)({}))
    return (tree[0], *parts)


def _evaluator(tree: tuple, filters: dict[str, Filter]) -> Callable[[dict], Any]:
    kind = tree[0]
    if kind == "const":
        value = tree[1]
        return lambda scope: value
    if kind == "get":
        name, field = tree[1:]
        return (lambda scope: scope[name][field]) if field else (lambda scope: scope[name])
    if kind == "filter":
        change, inner = filters[tree[1]], _evaluator(tree[2], filters)
        return lambda scope: change(inner(scope))
    if kind == "not":
        inner = _evaluator(tree[1], filters)
        return lambda scope: not inner(scope)
    a, b = (_evaluator(x, filters) for x in tree[1:])
    return {
        "and": lambda scope: a(scope) and b(scope), "or": lambda scope: a(scope) or b(scope), "+": lambda scope: a(scope) + b(scope),
        "==": lambda scope: a(scope) == b(scope), "!=": lambda scope: a(scope) != b(scope),
    }[kind]


def _fold_nodes(nodes: list, filters: dict[str, Filter]) -> list:
    """Constants become text, arms that can't be taken go, and neighbouring texts are joined."""
    out: list = []
    for node in nodes:
        kind = node[0]
        if kind == "out":
            tree = _fold(node[1], filters)
            new = [("text", str(tree[1]))] if tree[0] == "const" else [("out", tree)]
        elif kind == "for":
            new = [(*node[:3], _fold_nodes(node[3], filters))]
        elif kind == "generation":
            new = [("generation", _fold_nodes(node[1], filters))]
        elif kind == "if":
            arms: list = []
            for test, body in node[1]:
                tree = _fold(test, filters)
                if tree[0] != "const" or tree[1]:
                    arms.append((tree, _fold_nodes(body, filters)))
                if tree[0] == "const" and tree[1]:
                    break
            new = arms[0][1] if arms and arms[0][0][0] == "const" else [("if", arms)] if arms else []
        else:
            new = [node]
        for x in new:
            if x[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + x[1])
            else:
                out.append(x)
    return out


def _closure(nodes: list, filters: dict[str, Filter], generated: bool = False) -> Render:
    parts: list[Render] = []
    for node in nodes:
        kind = node[0]
        if kind == "text":
            parts.append(lambda scope, x=node[1]: iter(((x, generated),)))
        elif kind == "out":
            parts.append(lambda scope, f=_evaluator(node[1], filters): iter(((str(f(scope)), generated),)))
        elif kind == "generation":
            parts.append(_closure(node[1], filters, True))
        elif kind == "for":
            parts.append(_loop(node[1], node[2], _closure(node[3], filters, generated)))
        else:
            parts.append(_branch([(_evaluator(t, filters), _closure(b, filters, generated)) for t, b in node[1]]))

    def render(scope: dict[str, Any]) -> Iterator[tuple[str, bool]]:
        for part in parts:
            yield from part(scope)

    return render


def _loop(name: str, items: str, body: Render) -> Render:
    def render(scope: dict[str, Any]) -> Iterator[tuple[str, bool]]:
        over, end = iter(scope[items]), object()
        item, index = next(over, end), 0
        while item is not end:
            following = next(over, end)
            yield from body(scope | {name: item, "loop": {"first": index == 0, "last": following is end, "index0": str(index)}})
            item, index = following, index + 1

    return render


def _branch(arms: list) -> Render:
    def render(scope: dict[str, Any]) -> Iterator[tuple[str, bool]]:
        for test, body in arms:
            if test(scope):
                yield from body(scope)
                return

    return render


def compile_template(source: str, filters: dict[str, Filter] | None = None) -> Callable[[Iterable[dict[str, Any]]], Iterator[tuple[str, bool]]]:
    """A function of messages (dictionaries) that yields (piece, whether a model should learn to generate it)."""
    filters = filters or {}
    render = _closure(_fold_nodes(_parse(source), filters), filters)
    return lambda messages: render({"messages": messages})
