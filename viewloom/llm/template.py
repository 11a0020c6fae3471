"""A sandboxed template language for conversations: parsed to a syntax tree, folded, compiled to Python closures.

    {{ expression }}   {% if a %}..{% elif b %}..{% else %}..{% endif %}   {% for x in xs %}..{% endfor %}
    {% set x = expression %}   {% generation %}..{% endgeneration %}   {# comment #}   '-' at a brace trims

Expressions: literals, names, a.b, a[b], filters a | f(b), not/and/or, in, == != < <= > >=, + - * // % ~,
`is defined` and `is none`, a if b else c. Names come from the given context only; `.b` and `[b]` read mapping keys and sequence items,
never Python attributes; only the filters in FILTERS can be called. What stands inside {% generation %} is
marked as text to learn from.

A compiled template streams (text, marked) pieces and pulls its inputs lazily, so a loop over an iterator of
messages holds one message at a time (two with loop.last).
"""

from __future__ import annotations

import json
import operator
import re
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

CONTROL = re.compile(r"<(\\*)\|")
ESCAPED = re.compile(r"<\\(\\*)\|")


class TemplateError(ValueError):
    pass


def escape(text: str) -> str:
    """No '<|' is left: one more backslash goes between '<', the backslashes there and '|'."""
    return CONTROL.sub(lambda m: f"<{m[1]}\\|", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: f"<{m[1]}|", text)


def header(text: str) -> str:
    """Escaped, and on one line."""
    return escape(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unheader(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


FILTERS: dict[str, Callable] = {
    "trim": lambda x: str(x).strip(),
    "upper": lambda x: str(x).upper(),
    "lower": lambda x: str(x).lower(),
    "length": len,
    "string": str,
    "tojson": lambda x: json.dumps(x, ensure_ascii=False),
    "default": lambda x, other="": other if x is None else x,
    "replace": lambda x, old, new: str(x).replace(old, new),
    "join": lambda x, gap="": gap.join(map(str, x)),
    "escape": escape,
    "header": header,
}
#: The longest text that a repetition may make.
MOST_CHARS = 1 << 20


def _times(a, b):
    for text, n in ((a, b), (b, a)):
        if isinstance(text, (str, list, tuple)) and isinstance(n, int) and len(text) * max(n, 0) > MOST_CHARS:
            raise ValueError(f"a repetition longer than {MOST_CHARS}")
    return a * b


BINARY: dict[str, Callable] = {
    "+": operator.add,
    "-": operator.sub,
    "*": lambda a, b: _times(a, b),
    "//": operator.floordiv,
    "%": operator.mod,
    "~": lambda a, b: _show(a) + _show(b),
    "==": operator.eq,
    "!=": operator.ne,
    "<": operator.lt,
    "<=": operator.le,
    ">": operator.gt,
    ">=": operator.ge,
    "in": lambda a, b: a in b,
    "not in": lambda a, b: a not in b,
}
LEVELS = (("==", "!=", "<", "<=", ">", ">=", "in", "not in"), ("~",), ("+", "-"), ("*", "//", "%"))
TOKEN = re.compile(
    r"\s*(?:(?P<number>\d+)|(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|//|[-+*%~<>|.,()\[\]=]))", re.S
)
TAGS = re.compile(r"\{\{-?(?P<out>.*?)-?\}\}|\{%-?(?P<tag>.*?)-?%\}|\{#.*?#\}", re.S)
UNESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _show(x) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


# --- parsing: expressions are tuples (kind, ...), statements too -------------------------------------------


class _Expression:
    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at : at + 10]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "string" and self.tokens[self.at][1] in values

    def accept(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def expect(self, value: str) -> None:
        if not self.accept(value):
            raise TemplateError(f"{value!r} expected")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name expected")

    def whole(self) -> tuple:
        found = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return found

    def choice(self) -> tuple:
        value = self.any_of()
        if self.accept("if"):
            test = self.any_of()
            other = self.choice() if self.accept("else") else ("const", None)
            return ("choice", test, value, other)
        return value

    def any_of(self) -> tuple:
        left = self.all_of()
        while self.accept("or"):
            left = ("or", left, self.all_of())
        return left

    def all_of(self) -> tuple:
        left = self.negated()
        while self.accept("and"):
            left = ("and", left, self.negated())
        return left

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.accept("not") else self.level(0)

    def level(self, k: int) -> tuple:
        if k == len(LEVELS):
            return self.postfix()
        left = self.level(k + 1)
        while True:
            if k == 0 and self.accept("is"):
                negative, what = bool(self.accept("not")), self.name()
                if what not in ("defined", "none"):
                    raise TemplateError(f"no test {what!r}")
                left = ("is", what, left)
                left = ("not", left) if negative else left
            elif k == 0 and self.peek("not"):
                self.at += 1
                self.expect("in")
                left = ("binary", "not in", left, self.level(k + 1))
            elif op := self.accept(*LEVELS[k]):
                left = ("binary", op, left, self.level(k + 1))
            else:
                return left

    def postfix(self) -> tuple:
        value = self.atom()
        while True:
            if self.accept("."):
                value = ("item", value, ("const", self.name()))
            elif self.accept("["):
                value = ("item", value, self.choice())
                self.expect("]")
            elif self.accept("|"):
                name, given = self.name(), []
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                if self.accept("("):
                    while not self.accept(")"):
                        given.append(self.choice())
                        self.accept(",")
                value = ("filter", name, value, *given)
            else:
                return value

    def atom(self) -> tuple:
        if self.accept("("):
            value = self.choice()
            self.expect(")")
            return value
        if self.accept("-"):
            return ("binary", "-", ("const", 0), self.atom())
        if self.at == len(self.tokens):
            raise TemplateError("an expression ends early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return ("const", int(text))
        if kind == "string":
            return ("const", re.sub(r"\\(.)", lambda m: UNESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "name":
            return ("const", {"true": True, "false": False, "none": None}[text.lower()]) if text.lower() in ("true", "false", "none") else ("name", text)
        raise TemplateError(f"unexpected {text!r}")


def _pieces(source: str) -> list[tuple[str, str]]:
    found, at = [], 0
    for m in TAGS.finditer(source):
        text = source[at : m.start()]
        if found and found[-1][0] == "trim":
            found.pop()
            text = text.lstrip()
        if m[0][2] == "-":
            text = text.rstrip()
        found.append(("text", text))
        if m["out"] is not None:
            found.append(("out", m["out"]))
        elif m["tag"] is not None:
            found.append(("tag", m["tag"].strip()))
        if m[0][-3] == "-":
            found.append(("trim", ""))
        at = m.end()
    text = source[at:]
    if found and found[-1][0] == "trim":
        found.pop()
        text = text.lstrip()
    return [*found, ("text", text)]


def parse(source: str) -> list[tuple]:
    pieces, at = _pieces(source), 0

    def body(*ends: str) -> tuple[list[tuple], str]:
        nonlocal at
        found: list[tuple] = []
        while at < len(pieces):
            kind, text = pieces[at]
            at += 1
            if kind == "text":
                found.append(("text", text))
            elif kind == "out":
                found.append(("out", _Expression(text).whole()))
            elif (word := text.split(None, 1)[0] if text else "") in ends:
                return found, text
            elif word == "if":
                found.append(condition(text[2:]))
            elif word == "for":
                m = re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+(.+)", text, re.S)
                if not m:
                    raise TemplateError(f"bad loop {text!r}")
                found.append(("for", m[1], _Expression(m[2]).whole(), body("endfor")[0]))
            elif word == "set":
                m = re.fullmatch(r"set\s+([A-Za-z_]\w*)\s*=(?!=)(.+)", text, re.S)
                if not m:
                    raise TemplateError(f"bad assignment {text!r}")
                found.append(("set", m[1], _Expression(m[2]).whole()))
            elif word == "generation":
                found.append(("generation", body("endgeneration")[0]))
            else:
                raise TemplateError(f"unexpected tag {text!r}")
        if ends:
            raise TemplateError(f"{ends[0]} is missing")
        return found, ""

    def condition(test: str) -> tuple:
        inside, end = body("elif", "else", "endif")
        other: list[tuple] = []
        if end.startswith("elif"):
            other = [condition(end[4:])]
        elif end == "else":
            other = body("endif")[0]
        return ("if", _Expression(test).whole(), inside, other)

    return body()[0]


# --- folding -----------------------------------------------------------------------------------------------


def fold_expression(e: tuple) -> tuple:
    if e[0] in ("const", "name"):
        return e
    e = tuple(fold_expression(x) if isinstance(x, tuple) else x for x in e)
    if e[0] == "choice" and e[1][0] == "const":
        return e[2] if e[1][1] else e[3]
    if e[0] in ("and", "or") and e[1][0] == "const":
        return e[2] if bool(e[1][1]) == (e[0] == "and") else e[1]
    if e[0] != "item" and all(x[0] == "const" for x in e if isinstance(x, tuple)):
        try:
            return ("const", expression(e)({}))
        except (TypeError, ValueError, ZeroDivisionError):
            return e  # it fails when it is rendered, if it is
    return e


def fold(nodes: Iterable[tuple]) -> list[tuple]:
    """Constant expressions become text, constant conditions their branch, neighbouring texts one text."""
    found: list[tuple] = []
    for node in nodes:
        if node[0] == "out":
            value = fold_expression(node[1])
            new = [("text", _show(value[1]))] if value[0] == "const" else [("out", value)]
        elif node[0] == "if":
            test = fold_expression(node[1])
            new = fold(node[2] if test[1] else node[3]) if test[0] == "const" else [("if", test, fold(node[2]), fold(node[3]))]
        elif node[0] == "for":
            new = [("for", node[1], fold_expression(node[2]), fold(node[3]))]
        elif node[0] == "set":
            new = [("set", node[1], fold_expression(node[2]))]
        elif node[0] == "generation":
            new = [("generation", fold(node[1]))]
        else:
            new = [node]
        for x in new:
            if x[0] == "text" and found and found[-1][0] == "text":
                found[-1] = ("text", found[-1][1] + x[1])
            elif x != ("text", ""):
                found.append(x)
    return found


# --- closures ----------------------------------------------------------------------------------------------


def _item(value, key):
    if isinstance(value, Mapping):
        return value.get(key)
    if isinstance(value, Sequence) and isinstance(key, int):
        return value[key] if -len(value) <= key < len(value) else None
    return None


def expression(e: tuple) -> Callable[[dict], object]:
    kind = e[0]
    if kind == "const":
        value = e[1]
        return lambda env: value
    if kind == "name":
        name = e[1]
        return lambda env: env.get(name)
    if kind == "is":
        inner = expression(e[2])
        if e[1] == "defined" and e[2][0] == "name":
            name = e[2][1]
            return lambda env: name in env
        return (lambda env: inner(env) is not None) if e[1] == "defined" else (lambda env: inner(env) is None)
    if kind == "binary":
        f, (a, b) = BINARY[e[1]], map(expression, e[2:])
        return lambda env: f(a(env), b(env))
    if kind == "filter":
        f, value, given = FILTERS[e[1]], expression(e[2]), [expression(x) for x in e[3:]]
        return (lambda env: f(value(env), *(g(env) for g in given))) if given else (lambda env: f(value(env)))
    a, *rest = map(expression, e[1:])
    if kind == "not":
        return lambda env: not a(env)
    if kind == "and":
        return lambda env: a(env) and rest[0](env)
    if kind == "or":
        return lambda env: a(env) or rest[0](env)
    if kind == "choice":
        return lambda env: rest[0](env) if a(env) else rest[1](env)
    return lambda env: _item(a(env), rest[0](env))


def _uses(nodes, name: str) -> bool:
    return any(x == ("name", name) or isinstance(x, (tuple, list)) and _uses(x, name) for x in nodes)


def statement(node: tuple) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    kind = node[0]
    if kind == "text":
        piece = (node[1], False)

        def run(env):
            yield piece
    elif kind == "out":
        value = expression(node[1])

        def run(env):
            yield _show(value(env)), False
    elif kind == "set":
        name, value = node[1], expression(node[2])

        def run(env):
            env[name] = value(env)
            return iter(())
    elif kind == "if":
        test, yes, no = expression(node[1]), block(node[2]), block(node[3])

        def run(env):
            return yes(env) if test(env) else no(env)
    elif kind == "generation":
        inside = block(node[1])

        def run(env):
            for text, _ in inside(env):
                yield text, True
    else:
        name, items, inside, looks_on = node[1], expression(node[2]), block(node[3]), _uses(node[3], "loop")

        def run(env):
            outer = dict(env)
            source = iter(items(env) or ())
            if not looks_on:
                for value in source:
                    env[name] = value
                    yield from inside(env)
            else:
                end = object()
                value, k = next(source, end), 0
                while value is not end:
                    after = next(source, end)
                    env[name], env["loop"] = value, {"index0": k, "index": k + 1, "first": k == 0, "last": after is end}
                    yield from inside(env)
                    value, k = after, k + 1
            env.clear()
            env.update(outer)

    return run


def block(nodes: list[tuple]) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    runs = [statement(x) for x in nodes]
    if len(runs) == 1:
        return runs[0]

    def run(env):
        for f in runs:
            yield from f(env)

    return run


def compile_template(source: str) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    """A function of the context that streams (text, whether it is marked) pieces."""
    run = block(fold(parse(source)))
    return lambda context: run(dict(context))
