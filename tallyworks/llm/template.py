"""A small sandboxed template language, compiled to Python closures.

    {{ expression }}                                   prints a value
    {% for name in expression %} ... {% endfor %}      loops over messages; loop.index, loop.first
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% set name = expression %}
    {% generation %} ... {% endgeneration %}           what the model is to learn to write
    {# comment #}                                      ``-`` inside a tag trims white space beside it

Expressions have strings, whole numbers, true, false, none, names, ``a.b`` (a key, never an
attribute), ``==`` ``!=`` ``+`` ``~`` ``and`` ``or`` ``not``, brackets and ``value|filter``. There are
no calls, no attributes and no imports; filters are the only code a template can reach.

``compiled`` parses the text to a syntax tree, folds what is constant and returns a function
that renders lazily, segment by segment, so that a conversation never has to be held whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

Scope = dict[str, Any]
# A piece of output and whether it lies inside a generation block.
Segment = tuple[str, bool]
Filters = Mapping[str, Callable[[Any], Any]]


class TemplateError(ValueError):
    """The template cannot be read, or asks for what does not exist."""


# --- syntax tree ----------------------------------------------------------------


@dataclass(frozen=True)
class Constant:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Key:
    of: Any
    key: str


@dataclass(frozen=True)
class Filtered:
    of: Any
    filter: str


@dataclass(frozen=True)
class Not:
    of: Any


@dataclass(frozen=True)
class Both:
    operator: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Print:
    of: Any


@dataclass(frozen=True)
class Loop:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Choice:
    test: Any
    then: tuple
    otherwise: tuple


@dataclass(frozen=True)
class Bind:
    name: str
    to: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


# --- parsing ----------------------------------------------------------------------

_TAG = re.compile(r"(\{\{-?|\{%-?|\{#-?)(.*?)(-?\}\}|-?%\}|-?#\})", re.S)
_TOKEN = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(\d+)|([A-Za-z_]\w*)|(==|!=|[.|()+~=]))""")
_CLOSED_BY = {"{{": "}}", "{%": "%}", "{#": "#}"}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _tokens(source: str) -> list[tuple[str, Any]]:
    out, at, source = [], 0, source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:]!r}")
        string, number, name, sign = m.groups()
        if string is not None:
            out.append(("constant", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), string[1:-1], flags=re.S)))
        elif number is not None:
            out.append(("constant", int(number)))
        elif name in ("true", "false", "none"):
            out.append(("constant", {"true": True, "false": False, "none": None}[name]))
        else:
            out.append(("name", name) if name else ("sign", sign))
        at = m.end()
    return out


class _Expression:
    """Precedence from loose to tight: or, and, not, == !=, + ~, | and dots."""

    def __init__(self, source: str, filters: Filters):
        self.tokens, self.at, self.filters, self.source = _tokens(source), 0, filters, source

    def peek(self, *wanted: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "constant" and self.tokens[self.at][1] in wanted

    def take(self) -> tuple[str, Any]:
        if self.at == len(self.tokens):
            raise TemplateError(f"{self.source!r} ends too soon")
        self.at += 1
        return self.tokens[self.at - 1]

    def name(self) -> str:
        kind, value = self.take()
        if kind != "name":
            raise TemplateError(f"expected a name in {self.source!r}")
        return value

    def whole(self):
        tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"did not expect {self.tokens[self.at][1]!r} in {self.source!r}")
        return tree

    def chain(self, operators: tuple[str, ...], below: Callable):
        tree = below()
        while self.peek(*operators):
            tree = Both(self.take()[1], tree, below())
        return tree

    def either(self):
        return self.chain(("or",), self.all)

    def all(self):
        return self.chain(("and",), self.negated)

    def negated(self):
        if self.peek("not"):
            self.take()
            return Not(self.negated())
        return self.chain(("==", "!="), self.joined)

    def joined(self):
        return self.chain(("+", "~"), self.filtered)

    def filtered(self):
        tree = self.atom()
        while self.peek("|", "."):
            if self.take()[1] == ".":
                tree = Key(tree, self.name())
                continue
            name = self.name()
            if name not in self.filters:
                raise TemplateError(f"there is no filter {name!r}")
            tree = Filtered(tree, name)
        return tree

    def atom(self):
        kind, value = self.take()
        if kind == "constant":
            return Constant(value)
        if kind == "name" and value not in ("and", "or", "not", "in"):
            return Name(value)
        if value == "(":
            tree = self.either()
            if self.take() != ("sign", ")"):
                raise TemplateError(f"a bracket is not closed in {self.source!r}")
            return tree
        raise TemplateError(f"did not expect {value!r} in {self.source!r}")


def parsed(source: str, filters: Filters) -> tuple:
    """The template's syntax tree."""
    # A frame is (what opened it, its nodes); blocks in the making are nested frames.
    frames: list[tuple[str, Any, list]] = [("", None, [])]
    at, trim = 0, False

    def add(node) -> None:
        if isinstance(node, Text) and re.search(r"\{[{%#]", node.text):
            raise TemplateError(f"a tag is not closed in {node.text!r}")
        frames[-1][2].append(node)

    def close(*openers: str):
        if frames[-1][0] not in openers:
            raise TemplateError(f"nothing to end here: {frames[-1][0]!r} is open")
        return frames.pop()

    def expression(text: str):
        return _Expression(text, filters).whole()

    for m in _TAG.finditer(source):
        opener, body, closer = m.groups()
        if closer.lstrip("-") != _CLOSED_BY[opener[:2]]:
            raise TemplateError(f"{m[0]!r} is not closed as it was opened")
        text = source[at : m.start()]
        text = text.lstrip() if trim else text
        add(Text(text.rstrip() if opener.endswith("-") else text))
        at, trim = m.end(), closer.startswith("-")
        if opener.startswith("{#"):
            continue
        if opener.startswith("{{"):
            add(Print(expression(body)))
            continue
        word, _, rest = body.strip().partition(" ")
        if word == "for":
            loop = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.*)", rest.strip(), re.S)
            if not loop:
                raise TemplateError(f"cannot read {m[0]!r}")
            frames.append(("for", (loop[1], expression(loop[2])), []))
        elif word == "endfor":
            _, (name, over), nodes = close("for")
            add(Loop(name, over, tuple(nodes)))
        elif word == "if":
            frames.append(("if", [(expression(rest), None)], []))
        elif word in ("elif", "else", "endif"):
            kind, branches, nodes = close("if", "else") if word == "endif" else close("if")
            branches[-1] = (branches[-1][0], tuple(nodes))
            if word == "endif":
                otherwise = branches.pop()[1] if kind == "else" else ()
                for test, then in reversed(branches):
                    otherwise = (Choice(test, then, otherwise),)
                add(otherwise[0])
            else:
                branches.append((expression(rest) if word == "elif" else None, None))
                frames.append(("else" if word == "else" else "if", branches, []))
        elif word == "set":
            name, sign, value = rest.partition("=")
            if not sign or not re.fullmatch(r"[A-Za-z_]\w*", name.strip()):
                raise TemplateError(f"cannot read {m[0]!r}")
            add(Bind(name.strip(), expression(value)))
        elif word == "generation":
            frames.append(("generation", None, []))
        elif word == "endgeneration":
            add(Generation(tuple(close("generation")[2])))
        else:
            raise TemplateError(f"there is no {word!r}")
    tail = source[at:]
    add(Text(tail.lstrip() if trim else tail))
    if len(frames) > 1:
        raise TemplateError(f"{frames[-1][0]!r} is not ended")
    return tuple(frames[0][2])


# --- folding ------------------------------------------------------------------------

_OPERATORS: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "~": lambda a, b: _shown(a) + _shown(b),
}


def _shown(value: Any) -> str:
    """What printing a value writes; nothing for none."""
    return "" if value is None else str(value)


def _sum(a: Any, b: Any) -> Any:
    return a + b if isinstance(a, int) and isinstance(b, int) else _shown(a) + _shown(b)


def _folded_value(tree, filters: Filters):
    if isinstance(tree, Key):
        return Key(_folded_value(tree.of, filters), tree.key)
    if isinstance(tree, Filtered):
        of = _folded_value(tree.of, filters)
        return Constant(filters[tree.filter](of.value)) if isinstance(of, Constant) else Filtered(of, tree.filter)
    if isinstance(tree, Not):
        of = _folded_value(tree.of, filters)
        return Constant(not of.value) if isinstance(of, Constant) else Not(of)
    if isinstance(tree, Both):
        left, right = _folded_value(tree.left, filters), _folded_value(tree.right, filters)
        if isinstance(left, Constant) and tree.operator in ("and", "or"):
            return right if bool(left.value) == (tree.operator == "and") else left
        whole = Both(tree.operator, left, right)
        return Constant(_value(whole, filters)({})) if isinstance(left, Constant) and isinstance(right, Constant) else whole
    return tree


def folded(nodes: tuple, filters: Filters) -> tuple:
    """The tree with constant expressions computed, decided branches taken and texts run together."""
    out: list = []
    for node in nodes:
        if isinstance(node, Print):
            of = _folded_value(node.of, filters)
            made = [Text(_shown(of.value))] if isinstance(of, Constant) else [Print(of)]
        elif isinstance(node, Choice):
            test = _folded_value(node.test, filters)
            then, otherwise = folded(node.then, filters), folded(node.otherwise, filters)
            made = (list(then) if test.value else list(otherwise)) if isinstance(test, Constant) else [Choice(test, then, otherwise)]
        elif isinstance(node, Loop):
            made = [Loop(node.name, _folded_value(node.over, filters), folded(node.body, filters))]
        elif isinstance(node, Bind):
            made = [Bind(node.name, _folded_value(node.to, filters))]
        elif isinstance(node, Generation):
            made = [Generation(folded(node.body, filters))]
        else:
            made = [node]
        for n in made:
            if isinstance(n, Text) and out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].text + n.text)
            elif n != Text(""):
                out.append(n)
    return tuple(out)


# --- closures -----------------------------------------------------------------------


def _value(tree, filters: Filters) -> Callable[[Scope], Any]:
    if isinstance(tree, Constant):
        return lambda scope, v=tree.value: v
    if isinstance(tree, Name):

        def named(scope: Scope, name=tree.name):
            if name not in scope:
                raise TemplateError(f"there is no {name!r}")
            return scope[name]

        return named
    if isinstance(tree, Key):
        of = _value(tree.of, filters)

        def looked_up(scope: Scope, key=tree.key):
            found = of(scope)
            if not isinstance(found, dict):
                raise TemplateError(f".{key} of what has no keys")
            return found.get(key)

        return looked_up
    if isinstance(tree, Filtered):
        of, apply = _value(tree.of, filters), filters[tree.filter]
        return lambda scope: apply(of(scope))
    if isinstance(tree, Not):
        of = _value(tree.of, filters)
        return lambda scope: not of(scope)
    left, right = _value(tree.left, filters), _value(tree.right, filters)
    if tree.operator == "and":
        return lambda scope: left(scope) and right(scope)
    if tree.operator == "or":
        return lambda scope: left(scope) or right(scope)
    apply2 = _sum if tree.operator == "+" else _OPERATORS[tree.operator]
    return lambda scope: apply2(left(scope), right(scope))


def _rendered(node, filters: Filters) -> Callable[[Scope, bool], Iterator[Segment]]:
    if isinstance(node, Text):

        def text(scope: Scope, learnt: bool, t=node.text) -> Iterator[Segment]:
            yield t, learnt

        return text
    if isinstance(node, Print):
        of = _value(node.of, filters)

        def printed(scope: Scope, learnt: bool) -> Iterator[Segment]:
            yield _shown(of(scope)), learnt

        return printed
    if isinstance(node, Bind):
        to = _value(node.to, filters)

        def bind(scope: Scope, learnt: bool) -> Iterator[Segment]:
            scope[node.name] = to(scope)
            return iter(())

        return bind
    if isinstance(node, Generation):
        inside = _block(node.body, filters)
        return lambda scope, learnt: inside(scope, True)
    if isinstance(node, Choice):
        test, then, otherwise = _value(node.test, filters), _block(node.then, filters), _block(node.otherwise, filters)
        return lambda scope, learnt: then(scope, learnt) if test(scope) else otherwise(scope, learnt)
    over, body = _value(node.over, filters), _block(node.body, filters)

    def loop(scope: Scope, learnt: bool) -> Iterator[Segment]:
        items = over(scope)
        if not isinstance(items, Iterable) or isinstance(items, (str, bytes, dict)):
            raise TemplateError("can only loop over a list")
        for i, item in enumerate(items):
            yield from body({**scope, node.name: item, "loop": {"index": i + 1, "first": i == 0}}, learnt)

    return loop


def _block(nodes: tuple, filters: Filters) -> Callable[[Scope, bool], Iterator[Segment]]:
    steps = [_rendered(n, filters) for n in nodes]

    def run(scope: Scope, learnt: bool) -> Iterator[Segment]:
        for step in steps:
            yield from step(scope, learnt)

    return run


def compiled(source: str, filters: Filters) -> Callable[..., Iterator[Segment]]:
    """A function of the template's names that yields its output in segments."""
    block = _block(folded(parsed(source, filters), filters), filters)
    return lambda **names: block(dict(names), False)
