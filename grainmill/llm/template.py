"""A small sandboxed template language: source -> syntax tree -> folded tree -> Python closures.

    {{ expression }}                          prints a value
    {% for m in messages %} ... {% endfor %}  loop.index, loop.index0, loop.first, loop.last
    {% if a %} ... {% elif b %} ... {% else %} ... {% endif %}
    {% set name = expression %}
    {% generation %} ... {% endgeneration %}  what the model is trained to write
    {# comment #}, and a '-' inside a tag ({%- -%}) trims the white space on that side

Expressions have strings, integers, true, false, none, lists, names, .field, [index], `|filter(arguments)`, not, and, or,
the comparisons, in, not in, + - // %, ~ (joins as text), and `a if c else b`. Nothing can be called but filters of a
fixed list, fields are keys of mappings (never Python attributes), and there is no repetition of strings, so a template can
neither reach the interpreter nor grow its output beyond its loops.

Constant parts are evaluated once, when the template is compiled: operators on constants, filters of constants, branches
whose condition is constant, names given as constants, and neighbouring pieces of text are joined. What is left becomes
nested closures. Loops pull their items one by one (with one item of look-ahead for loop.last) and pieces of output come
one by one, so that a conversation is never held whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

TOKEN = re.compile(r"\s*(?:(?P<int>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|//|[-+%~|.,()\[\]<>=])|(?P<bad>\S))", re.S)
TAG = re.compile(r"\{\{-?(?P<print>.*?)-?\}\}|\{%-?(?P<block>.*?)-?%\}|\{#.*?#\}", re.S)
BACKSLASH = {"n": "\n", "t": "\t", "r": "\r"}
WORDS = {"true": True, "false": False, "none": None}
RESERVED = {"and", "or", "not", "in", "if", "else"} | set(WORDS)


#: Stand in the output where a generation block begins and ends.
BEGIN, END = object(), object()

#: A compiled statement: scope -> pieces of output, one by one.
Statement = Callable[[dict], Iterator]


class TemplateError(ValueError):
    """The template isn't in the language, or asks for what a value doesn't have."""


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Apply:
    """An operator or filter on expressions; `what` is its key in OPERATORS or 'filter:<name>'."""

    what: str
    args: tuple


@dataclass(frozen=True)
class Choice:
    """Conditions with what they give, tried in order; of expressions (one each) or of statements (lists)."""

    arms: tuple
    other: object
    prints: bool = False


@dataclass(frozen=True)
class Print:
    value: object


@dataclass(frozen=True)
class Loop:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Assign:
    name: str
    value: object


@dataclass(frozen=True)
class Generation:
    body: tuple


def text_of(value: object) -> str:
    """A value as output: none prints nothing, booleans print as in the language."""
    if value is None:
        return ""
    return value if type(value) is str else str(value).lower() if type(value) is bool else str(value)


def _field(value: object, key: object) -> object:
    if isinstance(value, dict):
        return value.get(key)
    if isinstance(value, (list, str)) and type(key) is int:
        return value[key] if -len(value) <= key < len(value) else None
    raise TemplateError(f"no field {key!r}")


def _number(f: Callable[[int, int], int]) -> Callable:
    def run(a: object, b: object) -> int:
        if type(a) is not int or type(b) is not int:
            raise TemplateError("numbers wanted")
        return f(a, b)

    return run


OPERATORS: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "not in": lambda a, b: a not in b,
    "+": _number(lambda a, b: a + b),
    "-": _number(lambda a, b: a - b),
    "//": _number(lambda a, b: a // b),
    "%": _number(lambda a, b: a % b),
    "~": lambda a, b: text_of(a) + text_of(b),
    "not": lambda a: not a,
    "field": _field,
    "list": lambda *a: list(a),
}

FILTERS: dict[str, Callable] = {
    "trim": lambda v: text_of(v).strip(),
    "upper": lambda v: text_of(v).upper(),
    "lower": lambda v: text_of(v).lower(),
    "capitalize": lambda v: text_of(v).capitalize(),
    "length": len,
    "default": lambda v, other: other if v is None else v,
    "replace": lambda v, old, new: text_of(v).replace(old, new),
}


class Expressions:
    """Reads one expression from the text of a tag."""

    #: Binary operators from loosest to tightest; `not`, `and`, `or` and the choice are above these.
    LEVELS = (("==", "!=", "<", "<=", ">", ">=", "in", "not in"), ("~",), ("+", "-"), ("//", "%"))

    def __init__(self, source: str):
        self.tokens = [(m.lastgroup, m[m.lastgroup]) for m in TOKEN.finditer(source.strip())]
        self.at = 0

    def peek(self, ahead: int = 0) -> str | None:
        return self.tokens[self.at + ahead][1] if self.at + ahead < len(self.tokens) and self.tokens[self.at + ahead][0] != "str" else None

    def accept(self, *wanted: str) -> str | None:
        if (found := self.peek()) in wanted and found is not None:
            self.at += 1
            return found
        return None

    def expect(self, wanted: str) -> None:
        if not self.accept(wanted):
            raise TemplateError(f"{wanted!r} wanted, {self.peek()!r} found")

    def name(self) -> str:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        if kind != "name" or value in RESERVED:
            raise TemplateError(f"a name wanted, {value!r} found")
        self.at += 1
        return value

    def end(self) -> None:
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def expression(self):
        value = self.disjunction()
        if self.accept("if"):
            condition = self.disjunction()
            self.expect("else")
            return Choice(((condition, value),), self.expression())
        return value

    def disjunction(self):
        left = self.conjunction()
        while self.accept("or"):
            left = Choice(((left, left),), self.conjunction())
        return left

    def conjunction(self):
        left = self.negation()
        while self.accept("and"):
            left = Choice(((left, self.negation()),), left)
        return left

    def negation(self):
        return Apply("not", (self.negation(),)) if self.accept("not") else self.binary(0)

    def binary(self, level: int):
        if level == len(self.LEVELS):
            return self.postfix()
        left = self.binary(level + 1)
        while True:
            if level == 0 and self.peek() == "not" and self.peek(1) == "in":
                self.at += 2
                left = Apply("not in", (left, self.binary(level + 1)))
            elif found := self.accept(*self.LEVELS[level]):
                left = Apply(found, (left, self.binary(level + 1)))
            else:
                return left

    def postfix(self):
        value = self.primary()
        while True:
            if self.accept("."):
                value = Apply("field", (value, Const(self.name())))
            elif self.accept("["):
                value = Apply("field", (value, self.expression()))
                self.expect("]")
            elif self.accept("|"):
                name, args = self.name(), [value]
                if self.accept("("):
                    args += self.several(")")
                value = Apply(f"filter:{name}", tuple(args))
            else:
                return value

    def several(self, close: str) -> list:
        found = []
        while not self.accept(close):
            found.append(self.expression())
            if not self.accept(",") and self.peek() != close:
                raise TemplateError(f"{close!r} wanted")
        return found

    def primary(self):
        if self.at == len(self.tokens):
            raise TemplateError("an expression wanted")
        kind, value = self.tokens[self.at]
        if kind == "str":
            self.at += 1
            return Const(re.sub(r"\\(.)", lambda m: BACKSLASH.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "int":
            self.at += 1
            return Const(int(value))
        if self.accept("-"):
            return Apply("-", (Const(0), self.postfix()))
        if self.accept("("):
            inner = self.expression()
            self.expect(")")
            return inner
        if self.accept("["):
            return Apply("list", tuple(self.several("]")))
        if value in WORDS:
            self.at += 1
            return Const(WORDS[value])
        return Name(self.name())


def _pieces(source: str) -> Iterator[tuple[str, str]]:
    """('text' | 'print' | 'block', content); white space next to a '-' is gone."""
    at, trim = 0, False
    for m in TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if trim else text
        yield "text", text.rstrip() if m[0][2] == "-" else text
        if m.lastgroup:
            yield m.lastgroup, m[m.lastgroup]
        at, trim = m.end(), m[0][-3] == "-"
    yield "text", source[at:].lstrip() if trim else source[at:]


def parse(source: str) -> tuple:
    """The template as a tree of statements."""
    pieces = list(_pieces(source))
    place = 0

    def body(*ends: str) -> tuple[tuple, str, Expressions | None]:
        """Statements up to a tag that starts with one of ends; that word, and what follows it."""
        nonlocal place
        found: list = []
        while place < len(pieces):
            kind, content = pieces[place]
            place += 1
            if kind == "text":
                if content:
                    found.append(Print(Const(content)))
                continue
            e = Expressions(content)
            if kind == "print":
                found.append(Print(e.expression()))
                e.end()
                continue
            word = e.accept("for", "if", "elif", "else", "endif", "endfor", "set", "generation", "endgeneration")
            if word in ends:
                return tuple(found), word, e
            if word == "for":
                name = e.name()
                e.expect("in")
                over = e.expression()
                e.end()
                found.append(Loop(name, over, body("endfor")[0]))
            elif word == "set":
                name = e.name()
                e.expect("=")
                found.append(Assign(name, e.expression()))
                e.end()
            elif word == "generation":
                found.append(Generation(body("endgeneration")[0]))
            elif word == "if":
                arms, other, condition = [], (), e.expression()
                while True:
                    inner, word, e = body("elif", "else", "endif")
                    arms.append((condition, inner))
                    if word == "elif":
                        condition = e.expression()
                        continue
                    if word == "else":
                        other = body("endif")[0]
                    break
                found.append(Choice(tuple(arms), other, prints=True))
            else:
                raise TemplateError(f"unknown tag {content.strip()!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(found), "", None

    return body()[0]


@dataclass
class Compiler:
    """Folds a tree and makes closures of it. filters: names that a template may use; constants: names with fixed values."""

    filters: dict[str, Callable]
    constants: dict[str, object] = field(default_factory=dict)

    def function(self, what: str) -> Callable:
        if what.startswith("filter:"):
            if what[7:] not in self.filters:
                raise TemplateError(f"unknown filter {what[7:]!r}")
            return self.filters[what[7:]]
        return OPERATORS[what]

    def fold(self, e, bound: frozenset[str]):
        """An expression with its constant parts evaluated; bound: names that the template itself sets."""
        if isinstance(e, Name):
            return Const(self.constants[e.name]) if e.name in self.constants and e.name not in bound else e
        if isinstance(e, Apply):
            args = tuple(self.fold(a, bound) for a in e.args)
            run = self.function(e.what)
            if all(isinstance(a, Const) for a in args):
                return Const(run(*[a.value for a in args]))
            return Apply(e.what, args)
        if isinstance(e, Choice):
            arms = []
            for condition, value in e.arms:
                condition, value = self.fold(condition, bound), self.fold(value, bound)
                if not isinstance(condition, Const):
                    arms.append((condition, value))
                elif condition.value:
                    return Choice(tuple(arms), value) if arms else value
            other = self.fold(e.other, bound)
            return Choice(tuple(arms), other) if arms else other
        return e

    def fold_all(self, body: tuple, bound: frozenset[str]) -> tuple:
        """Statements with folded expressions, without dead branches, with neighbouring constant texts joined."""
        out: list = []
        for s in body:
            if isinstance(s, Print):
                out.append(Print(self.fold(s.value, bound)))
            elif isinstance(s, Assign):
                out.append(Assign(s.name, self.fold(s.value, bound)))
            elif isinstance(s, Loop):
                out.append(Loop(s.name, self.fold(s.over, bound), self.fold_all(s.body, bound)))
            elif isinstance(s, Generation):
                out.append(Generation(self.fold_all(s.body, bound)))
            else:
                arms, other = [], s.other
                for condition, inner in s.arms:
                    condition = self.fold(condition, bound)
                    if not isinstance(condition, Const):
                        arms.append((condition, self.fold_all(inner, bound)))
                    elif condition.value:
                        other = inner
                        break
                other = self.fold_all(other, bound)
                out.extend([Choice(tuple(arms), other, prints=True)] if arms else other)
        joined: list = []
        for s in out:
            if isinstance(s, Print) and isinstance(s.value, Const):
                text = text_of(s.value.value)
                if joined and isinstance(joined[-1], Print) and isinstance(joined[-1].value, Const):
                    text = joined.pop().value.value + text
                if text:
                    joined.append(Print(Const(text)))
            else:
                joined.append(s)
        return tuple(joined)

    def value(self, e) -> Callable[[dict], object]:
        if isinstance(e, Const):
            return lambda scope, v=e.value: v
        if isinstance(e, Name):
            return lambda scope, n=e.name: scope.get(n)
        if isinstance(e, Apply):
            run, args = self.function(e.what), [self.value(a) for a in e.args]
            if len(args) == 1:
                return lambda scope, a=args[0]: run(a(scope))
            if e.what == "field" and isinstance(e.args[1], Const):
                return lambda scope, a=args[0], k=e.args[1].value: _field(a(scope), k)
            if len(args) == 2:
                return lambda scope, a=args[0], b=args[1]: run(a(scope), b(scope))
            return lambda scope: run(*[a(scope) for a in args])
        arms, other = [(self.value(c), self.value(v)) for c, v in e.arms], self.value(e.other)

        def choose(scope: dict) -> object:
            for condition, value in arms:
                if condition(scope):
                    return value(scope)
            return other(scope)

        return choose

    def statements(self, body: tuple) -> Statement:
        steps = [self.statement(s) for s in body]
        if len(steps) == 1:
            return steps[0]

        def run(scope: dict) -> Iterator:
            for step in steps:
                yield from step(scope)

        return run

    def statement(self, s) -> Statement:
        if isinstance(s, Print):
            value = self.value(s.value)

            def show(scope: dict) -> Iterator:
                yield text_of(value(scope))

            return show
        if isinstance(s, Assign):
            value = self.value(s.value)

            def assign(scope: dict) -> Iterator:
                scope[s.name] = value(scope)
                yield from ()

            return assign
        if isinstance(s, Generation):
            inner = self.statements(s.body)

            def generation(scope: dict) -> Iterator:
                yield BEGIN
                yield from inner(scope)
                yield END

            return generation
        if isinstance(s, Loop):
            over, inner, name = self.value(s.over), self.statements(s.body), s.name

            def loop(scope: dict) -> Iterator:
                items = iter(over(scope) or ())
                outside = {k: scope[k] for k in (name, "loop") if k in scope}
                item, index = next(items, END), 0
                while item is not END:
                    following = next(items, END)
                    scope[name] = item
                    scope["loop"] = {"index": index + 1, "index0": index, "first": index == 0, "last": following is END}
                    yield from inner(scope)
                    item, index = following, index + 1
                for k in (name, "loop"):
                    scope.pop(k, None)
                scope.update(outside)

            return loop
        arms, other = [(self.value(c), self.statements(b)) for c, b in s.arms], self.statements(s.other)

        def choose(scope: dict) -> Iterator:
            for condition, inner in arms:
                if condition(scope):
                    return inner(scope)
            return other(scope)

        return choose


def _bound(body: Iterable) -> set[str]:
    """Names that a template sets itself; constants of these names aren't folded."""
    found: set[str] = set()
    for s in body:
        if isinstance(s, Assign):
            found.add(s.name)
        elif isinstance(s, Loop):
            found |= {s.name, "loop"} | _bound(s.body)
        elif isinstance(s, Generation):
            found |= _bound(s.body)
        elif isinstance(s, Choice):
            found |= _bound(s.other) | {n for _, b in s.arms for n in _bound(b)}
    return found


def folded(source: str, filters: dict[str, Callable] | None = None, constants: dict[str, object] | None = None) -> tuple:
    """The folded tree of a template."""
    tree = parse(source)
    return Compiler(FILTERS | (filters or {}), constants or {}).fold_all(tree, frozenset(_bound(tree)))


def compile_template(source: str, filters: dict[str, Callable] | None = None, constants: dict[str, object] | None = None) -> Statement:
    """render(scope) gives pieces of output one by one, with BEGIN and END around those of generation blocks."""
    return Compiler(FILTERS | (filters or {}), constants or {}).statements(folded(source, filters, constants))
