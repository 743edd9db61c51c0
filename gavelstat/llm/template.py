"""A small template language without access to anything but its inputs.

``{{ value }}`` writes a value, ``{% for x in list %} {% endfor %}`` repeats, ``{% if %} {% elif %} {% else %}
{% endif %}`` chooses, ``{% generation %} {% endgeneration %}`` marks what a model is to learn.  Values are string
and whole-number literals, names, ``x.field``, ``==``, ``!=``, ``and``, ``or``, ``not``, ``~`` (joins texts),
brackets and ``| filter``.  There are no calls, no imports, no attributes of Python objects: a field is a key of
a dict.  Loops have ``loop.index``, ``loop.first`` and ``loop.last``, and take their rows one at a time.

``compile_template`` parses to a tree, folds what is constant and returns a function made of closures.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field


class TemplateError(ValueError):
    pass


# ---- tree ----


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: object
    name: str


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    of: object


@dataclass(frozen=True)
class Out:
    value: object


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    rows: object
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


OPERATORS: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "~": lambda a, b: f"{a}{b}",
    "not": lambda a: not a,
}

# ---- parser ----

_TAG = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<text>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|[~|.()]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}
_WORDS = {"and", "or", "not", "in"}


class _Expression:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def take(self, value: str | None = None, kind: str | None = None) -> str:
        if self.at >= len(self.tokens) or value and self.peek() != value or kind and self.tokens[self.at][0] != kind:
            raise TemplateError(f"expected {value or kind}, found {self.peek()!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self):
        tree = self.either()
        if self.peek() is not None:
            raise TemplateError(f"left over: {self.peek()!r}")
        return tree

    def either(self):
        return self._chain("or", lambda: self._chain("and", self.negation))

    def _chain(self, word: str, part):
        tree = part()
        while self.peek() == word:
            self.take()
            tree = Op(word, (tree, part()))
        return tree

    def negation(self):
        if self.peek() == "not":
            self.take()
            return Op("not", (self.negation(),))
        tree = self.joined()
        while self.peek() in ("==", "!="):
            tree = Op(self.take(), (tree, self.joined()))
        return tree

    def joined(self):
        tree = self.filtered()
        while self.peek() == "~":
            self.take()
            tree = Op("~", (tree, self.filtered()))
        return tree

    def filtered(self):
        tree = self.atom()
        while self.peek() in (".", "|"):
            sign = self.take()
            name = self.take(kind="name")
            tree = Field(tree, name) if sign == "." else Filter(name, tree)
        return tree

    def atom(self):
        if self.at >= len(self.tokens):
            raise TemplateError("a value is missing")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "text":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), value[1:-1], flags=re.S))
        if kind == "int":
            return Const(int(value))
        if kind == "name" and value not in _WORDS:
            return Name(value)
        if value == "(":
            tree = self.either()
            self.take(")")
            return tree
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> tuple:
    pieces = [p for p in _TAG.split(source) if p]
    body, at, _ = _block(pieces, 0, ())
    if at != len(pieces):
        raise TemplateError(f"unexpected {pieces[at]}")
    return body


def _block(pieces: list[str], at: int, ends: tuple[str, ...]) -> tuple[tuple, int, str]:
    """Nodes up to a tag of ``ends``; the place of that tag and what it says."""
    nodes: list = []
    while at < len(pieces):
        piece = pieces[at]
        if piece.startswith("{{"):
            nodes.append(Out(_Expression(piece[2:-2]).whole()))
        elif piece.startswith("{%"):
            inside = piece[2:-2].strip()
            word, _, rest = inside.partition(" ")
            if word in ends:
                return tuple(nodes), at, inside
            node, at = _tag(pieces, at, word, rest)
            nodes.append(node)
        else:
            nodes.append(Out(Const(piece)))
        at += 1
    if ends:
        raise TemplateError(f"missing {' or '.join(ends)}")
    return tuple(nodes), at, ""


def _tag(pieces: list[str], at: int, word: str, rest: str):
    if word == "for":
        head = _Expression(rest)
        name = head.take(kind="name")
        head.take("in")
        rows = head.whole()
        body, at, _ = _block(pieces, at + 1, ("endfor",))
        return For(name, rows, body), at
    if word == "generation":
        body, at, _ = _block(pieces, at + 1, ("endgeneration",))
        return Generation(body), at
    if word in ("if", "elif"):
        then, at, end = _block(pieces, at + 1, ("elif", "else", "endif"))
        other: tuple = ()
        if end.startswith("elif"):
            node, at = _tag(pieces, at, "elif", end[4:])
            other = (node,)
        elif end == "else":
            other, at, _ = _block(pieces, at + 1, ("endif",))
        return If(_Expression(rest).whole(), then, other), at
    raise TemplateError(f"unknown tag {word!r}")


# ---- constant folding ----


def fold(body: tuple, filters: dict[str, Callable]) -> tuple:
    """The same block with constant parts computed and neighbouring constant texts joined."""
    out: list = []
    for node in body:
        for new in _fold_node(node, filters):
            if isinstance(new, Out) and isinstance(new.value, Const) and out and isinstance(out[-1], Out) and isinstance(out[-1].value, Const):
                out[-1] = Out(Const(f"{out[-1].value.value}{new.value.value}"))
            elif not (isinstance(new, Out) and new.value == Const("")):
                out.append(new)
    return tuple(out)


def _fold_node(node, filters) -> tuple:
    if isinstance(node, Out):
        return (Out(_fold_value(node.value, filters)),)
    if isinstance(node, If):
        test = _fold_value(node.test, filters)
        if isinstance(test, Const):
            return fold(node.then if test.value else node.other, filters)
        return (If(test, fold(node.then, filters), fold(node.other, filters)),)
    if isinstance(node, For):
        return (For(node.name, _fold_value(node.rows, filters), fold(node.body, filters)),)
    return (Generation(fold(node.body, filters)),)


def _fold_value(tree, filters):
    if isinstance(tree, Op):
        args = tuple(_fold_value(a, filters) for a in tree.args)
        if tree.op in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (tree.op == "and") else args[0]
        if all(isinstance(a, Const) for a in args) and tree.op in OPERATORS:
            return Const(OPERATORS[tree.op](*(a.value for a in args)))
        return Op(tree.op, args)
    if isinstance(tree, Filter):
        of = _fold_value(tree.of, filters)
        if tree.name not in filters:
            raise TemplateError(f"unknown filter {tree.name!r}")
        return Const(filters[tree.name](of.value)) if isinstance(of, Const) else Filter(tree.name, of)
    if isinstance(tree, Field):
        return Field(_fold_value(tree.of, filters), tree.name)
    return tree


# ---- closures ----

Piece = tuple[str, bool]  # text, and whether it is under the generation mark


def _value(tree, filters) -> Callable[[dict], object]:
    if isinstance(tree, Const):
        return lambda env, v=tree.value: v
    if isinstance(tree, Name):

        def name(env, n=tree.name):
            if n not in env:
                raise TemplateError(f"unknown name {n!r}")
            return env[n]

        return name
    if isinstance(tree, Field):
        of = _value(tree.of, filters)

        def get(env, n=tree.name):
            found = of(env)
            if not isinstance(found, dict) or n not in found:
                raise TemplateError(f"no field {n!r}")
            return found[n]

        return get
    if isinstance(tree, Filter):
        of, apply = _value(tree.of, filters), filters[tree.name]
        return lambda env: apply(of(env))
    args = [_value(a, filters) for a in tree.args]
    if tree.op == "and":
        return lambda env: args[0](env) and args[1](env)
    if tree.op == "or":
        return lambda env: args[0](env) or args[1](env)
    apply = OPERATORS[tree.op]
    return lambda env: apply(*[a(env) for a in args])


def _render(body: tuple, filters) -> Callable[[dict, bool], Iterator[Piece]]:
    parts = [_node(n, filters) for n in body]

    def run(env, marked):
        for part in parts:
            yield from part(env, marked)

    return run


def _node(node, filters) -> Callable[[dict, bool], Iterator[Piece]]:
    if isinstance(node, Out):
        value = _value(node.value, filters)
        return lambda env, marked: iter(((str(value(env)), marked),))
    if isinstance(node, Generation):
        inner = _render(node.body, filters)
        return lambda env, marked: inner(env, True)
    if isinstance(node, If):
        test, then, other = _value(node.test, filters), _render(node.then, filters), _render(node.other, filters)
        return lambda env, marked: then(env, marked) if test(env) else other(env, marked)
    rows, inner = _value(node.rows, filters), _render(node.body, filters)

    def loop(env, marked):
        ahead = iter(rows(env))
        row = next(ahead, ahead)
        index = 0
        while row is not ahead:
            following = next(ahead, ahead)
            index += 1
            state = {"index": index, "first": index == 1, "last": following is ahead}
            yield from inner({**env, node.name: row, "loop": state}, marked)
            row = following

    return loop


@dataclass(frozen=True)
class Template:
    tree: tuple
    _run: Callable = field(repr=False)

    def pieces(self, **env: object) -> Iterator[Piece]:
        """Texts in order, each with its generation mark."""
        return self._run(env, False)


def compile_template(source: str, filters: dict[str, Callable[[str], str]] | None = None) -> Template:
    filters = filters or {}
    tree = fold(parse(source), filters)
    return Template(tree, _render(tree, filters))


def joined(pieces: Iterable[Piece]) -> tuple[str, list[tuple[int, int]]]:
    """The whole text and the spans under the generation mark, in code points."""
    out, spans, at = [], [], 0
    for text, marked in pieces:
        if marked and text:
            spans.append((at, at + len(text)))
        out.append(text)
        at += len(text)
    return "".join(out), spans


def render(template: Template, **env: Iterable) -> tuple[str, list[tuple[int, int]]]:
    return joined(template.pieces(**env))
