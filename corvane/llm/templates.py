"""A small sandboxed template language for chats, compiled to Python closures.

    {{ expression }}                                  puts a value
    {% for m in list %} ... {% else %} ... {% endfor %}   with loop.index, index0, first, last; else for an empty list
    {% if a %} ... {% elif b %} ... {% else %} ... {% endif %}
    {% set name = expression %}
    {% generation %} ... {% endgeneration %}          what a model is to learn: its place in the output is marked
    {# comment #}                                     and a - inside a tag takes off the white space on its side

Expressions: strings, integers, true, false, none, names, m.field or m['field'], list[0], filters (x | trim), a if b else c, or, and, not,
==, !=, <, <=, >, >=, in, ~ (joins as text), +, -, %. Values are texts, integers, booleans, None, lists and dicts: fields are looked
up in dicts only, filters come from a given table, nothing is called, and there is no loop but over a list, so a template reaches
nothing but its input and ends. Expressions and blocks are nested 40 deep at most.

A template becomes a syntax tree of tuples, constant parts are computed once and joined, and each node becomes a closure.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

DEEPEST = 40
_TAG = re.compile(r"(\{\{-?|\{%-?|\{#-?)(.*?)(-?\}\}|-?%\}|-?#\})", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<int>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>|.\[\]()~+%-]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_CONSTANTS = {"true": True, "false": False, "none": None}
_WORDS = {"and", "or", "not", "in", "if", "else", *_CONSTANTS}


class TemplateError(ValueError):
    """A template that doesn't parse, or asks for what the language doesn't have."""


def _text(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (str, int)):
        return str(value)
    raise TemplateError(f"a {type(value).__name__} has no text")


FILTERS: dict[str, Callable] = {
    "trim": lambda x: _text(x).strip(), "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(),
    "capitalize": lambda x: _text(x).capitalize(), "string": _text, "length": len,
}


# --- expressions: ("const", v), ("name", n), ("item", a, b), ("filter", name, a), ("if", cond, a, b), ("not", a), ("op", name, a, b) ---

_LEVELS = (("or",), ("and",), ("not",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("~", "+", "-"), ("%",))


class _Expression:
    """Reads one expression."""

    def __init__(self, source: str, filters: dict[str, Callable]):
        self.filters, self.at, self.deep = filters, 0, 0
        self.tokens: list[tuple[str, str]] = []
        place, source = 0, source.rstrip()
        while place < len(source):
            found = _TOKEN.match(source, place)
            if not found:
                raise TemplateError(f"can't read {source[place:place + 20]!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            place = found.end()

    def whole(self) -> tuple:
        node = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def _next(self, *wanted: str) -> str | None:
        """The next token, if it is one of these operators or words."""
        if self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def _need(self, wanted: str) -> None:
        if not self._next(wanted):
            raise TemplateError(f"{wanted!r} is missing")

    def choice(self) -> tuple:
        self.deep += 1
        if self.deep > DEEPEST:
            raise TemplateError("nested too deep")
        node = self.level(0)
        if self._next("if"):
            cond = self.level(0)
            node = ("if", cond, node, self.choice() if self._next("else") else ("const", None))
        self.deep -= 1
        return node

    def level(self, n: int) -> tuple:
        if n == len(_LEVELS):
            return self.value()
        if _LEVELS[n] == ("not",):
            nots = 0
            while self._next("not"):
                nots += 1
            node = self.level(n + 1)
            for _ in range(nots):
                node = ("not", node)
            return node
        node = self.level(n + 1)
        while op := self._next(*_LEVELS[n]):
            node = ("op", op, node, self.level(n + 1))
        return node

    def value(self) -> tuple:
        if self.at == len(self.tokens):
            raise TemplateError("an expression ends too early")
        kind, token = self.tokens[self.at]
        self.at += 1
        if kind == "int":
            node = ("const", int(token))
        elif kind == "str":
            node = ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S))
        elif kind == "name" and token in _CONSTANTS:
            node = ("const", _CONSTANTS[token])
        elif kind == "name" and token not in _WORDS:
            node = ("name", token)
        elif token == "(":
            node = self.choice()
            self._need(")")
        elif token == "-":
            node = ("op", "-", ("const", 0), self.value())
        else:
            raise TemplateError(f"unexpected {token!r}")
        while op := self._next(".", "[", "|"):
            if op == "[":
                node = ("item", node, self.choice())
                self._need("]")
                continue
            name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if name[0] != "name":
                raise TemplateError(f"a name is missing after {op!r}")
            self.at += 1
            if op == "|" and name[1] not in self.filters:
                raise TemplateError(f"no filter {name[1]!r}")
            node = ("filter", name[1], node) if op == "|" else ("item", node, ("const", name[1]))
        return node


# --- blocks: ("text", s), ("put", e), ("for", name, e, body, other), ("if", [(e, body)], other), ("set", name, e), ("generation", body) ---


class _Blocks:
    """Reads a template's blocks."""

    def __init__(self, source: str, filters: dict[str, Callable]):
        self.filters, self.parts, self.at = filters, [*self._split(source)], 0

    def _split(self, source: str) -> Iterator[tuple[str, str]]:
        end, trim = 0, False
        for m in _TAG.finditer(source):
            text = source[end : m.start()]
            text = text.lstrip() if trim else text
            yield "text", text.rstrip() if m[1].endswith("-") else text
            opened, closed = m[1].rstrip("-"), m[3].lstrip("-")
            if {"{{": "}}", "{%": "%}", "{#": "#}"}[opened] != closed:
                raise TemplateError(f"{opened} isn't closed")
            if opened != "{#":
                yield ("put" if opened == "{{" else "tag"), m[2].strip()
            end, trim = m.end(), m[3].startswith("-")
        rest = source[end:]
        if re.search(r"\{\{|\{%|\{#", rest):
            raise TemplateError("a tag isn't closed")
        yield "text", rest.lstrip() if trim else rest

    def expression(self, source: str) -> tuple:
        return _Expression(source, self.filters).whole()

    def body(self, ends: tuple[str, ...], deep: int = 0) -> tuple[list[tuple], str, str]:
        """(nodes, the word that ended them, the rest of its tag)"""
        if deep > DEEPEST:
            raise TemplateError("nested too deep")
        nodes: list[tuple] = []
        while self.at < len(self.parts):
            kind, source = self.parts[self.at]
            self.at += 1
            if kind == "text":
                nodes.append(("text", source))
            elif kind == "put":
                nodes.append(("put", self.expression(source)))
            else:
                word, _, rest = source.partition(" ")
                if word in ends:
                    return nodes, word, rest.strip()
                nodes.append(self.tag(word, rest.strip(), deep))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return nodes, "", ""

    def tag(self, word: str, rest: str, deep: int) -> tuple:
        if word == "for" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)) and m[1] not in _WORDS:
            body, ended, _ = self.body(("else", "endfor"), deep + 1)
            other = self.body(("endfor",), deep + 1)[0] if ended == "else" else []
            return ("for", m[1], self.expression(m[2]), body, other)
        if word == "if":
            arms, cond = [], rest
            while True:
                body, ended, then = self.body(("elif", "else", "endif"), deep + 1)
                arms.append((self.expression(cond), body))
                if ended == "elif":
                    cond = then
                    continue
                return ("if", arms, self.body(("endif",), deep + 1)[0] if ended == "else" else [])
        if word == "set" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s*=\s*(.+)", rest, re.S)) and m[1] not in _WORDS:
            return ("set", m[1], self.expression(m[2]))
        if word == "generation" and not rest:
            return ("generation", self.body(("endgeneration",), deep + 1)[0])
        raise TemplateError(f"unknown tag {word!r} {rest!r}")


def parsed(source: str, filters: dict[str, Callable] = FILTERS) -> list[tuple]:
    """The syntax tree of a template."""
    return _Blocks(source, filters).body(())[0]


# --- constant folding ---


def _operated(op: str, a: object, b: object) -> object:
    if op in ("==", "!="):
        return (a == b) is (op == "==")
    if op == "in":
        if isinstance(b, (list, dict)) or (isinstance(b, str) and isinstance(a, str)):
            return a in b
    elif op == "~":
        return _text(a) + _text(b)
    elif (isinstance(a, str) and isinstance(b, str) and op in ("+", "<", "<=", ">", ">=")) or (isinstance(a, int) and isinstance(b, int)):
        if op == "%" and not b:
            raise TemplateError("% by zero")
        return {"+": lambda: a + b, "-": lambda: a - b, "%": lambda: a % b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b}[op]()
    raise TemplateError(f"no {op} for {type(a).__name__} and {type(b).__name__}")


def folded(node: tuple, filters: dict[str, Callable] = FILTERS) -> tuple:
    """An expression with its constant parts computed. What would fail is left to fail when it is reached."""
    kind = node[0]
    if kind in ("const", "name"):
        return node
    keep = 2 if kind in ("op", "filter") else 1
    node = (*node[:keep], *(folded(x, filters) for x in node[keep:]))
    if kind == "if" and node[1][0] == "const":
        return node[2] if node[1][1] else node[3]
    if kind == "op" and node[1] in ("and", "or") and node[2][0] == "const":
        return node[3] if bool(node[2][1]) is (node[1] == "and") else node[2]
    if all(x[0] == "const" for x in node[keep:]):
        try:
            return ("const", _compiled(node, filters)({}))
        except (TemplateError, TypeError):
            return node
    return node


def folded_blocks(nodes: list[tuple], filters: dict[str, Callable] = FILTERS) -> list[tuple]:
    """Blocks with constants put as text, neighbouring texts joined, and arms that can't be reached left out."""
    out: list[tuple] = []

    def add(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in nodes:
        kind = node[0]
        if kind == "put":
            value = folded(node[1], filters)
            plain = value[0] == "const" and not isinstance(value[1], (list, dict))
            add(("text", _text(value[1])) if plain else ("put", value))
        elif kind == "set":
            add(("set", node[1], folded(node[2], filters)))
        elif kind == "generation":
            add(("generation", folded_blocks(node[1], filters)))
        elif kind == "for":
            add(("for", node[1], folded(node[2], filters), folded_blocks(node[3], filters), folded_blocks(node[4], filters)))
        elif kind == "if":
            arms, other = [], node[2]
            for cond, body in node[1]:
                cond = folded(cond, filters)
                if cond[0] != "const":
                    arms.append((cond, folded_blocks(body, filters)))
                elif cond[1]:
                    other = body
                    break
            other = folded_blocks(other, filters)
            if arms:
                add(("if", arms, other))
            else:
                for x in other:
                    add(x)
        else:
            add(node)
    return out


# --- closures ---


class Output:
    """What a template puts: texts, and (start, end) of what a model is to learn, in code points."""

    def __init__(self):
        self.texts: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []
        self.marked = 0  # generation blocks that are open

    def put(self, text: str) -> None:
        if text:
            self.texts.append(text)
            self.length += len(text)


def _compiled(node: tuple, filters: dict[str, Callable]) -> Callable[[dict], object]:
    """An expression as a function of the variables."""
    kind = node[0]
    if kind == "const":
        return lambda env, v=node[1]: v
    if kind == "name":

        def name(env, n=node[1]):
            return env.get(n)

        return name
    if kind == "not":
        inner = _compiled(node[1], filters)
        return lambda env: not inner(env)
    if kind == "filter":
        f, inner = filters[node[1]], _compiled(node[2], filters)
        return lambda env: f(inner(env))
    if kind == "if":
        cond, a, b = (_compiled(x, filters) for x in node[1:])
        return lambda env: a(env) if cond(env) else b(env)
    if kind == "item":
        a, b = _compiled(node[1], filters), _compiled(node[2], filters)

        def item(env):
            of, key = a(env), b(env)
            if isinstance(of, dict) and isinstance(key, (str, int)):
                return of.get(key)
            if isinstance(of, list) and isinstance(key, int):
                return of[key] if -len(of) <= key < len(of) else None
            if of is None:
                return None
            raise TemplateError(f"a {type(of).__name__} has no fields")

        return item
    op, a, b = node[1], _compiled(node[2], filters), _compiled(node[3], filters)
    if op == "and":
        return lambda env: a(env) and b(env)
    if op == "or":
        return lambda env: a(env) or b(env)
    return lambda env: _operated(op, a(env), b(env))


#: A block's closure: it puts its text, and yields where a turn of an outermost loop ends, so that what was put so far can be taken away.
Block = Callable[[dict, Output], Iterator[None]]


def _chained(nodes: list[tuple], filters: dict[str, Callable]) -> Callable[[dict, Output], None]:
    """Blocks without a break."""
    made = [_block(n, filters) for n in nodes]

    def run(env: dict, out: Output) -> None:
        for f in made:
            f(env, out)

    return run


def _looped(values: Iterable, env: dict, name: str) -> Iterator[None]:
    """Sets the loop's variables for each value; the values may come from an iterator, one of which is read ahead."""
    it, index = iter(values), 0
    ahead = next(it, _END)
    saved = {k: env[k] for k in (name, "loop") if k in env}
    while ahead is not _END:
        value, ahead = ahead, next(it, _END)
        env[name], env["loop"] = value, {"index0": index, "index": index + 1, "first": index == 0, "last": ahead is _END}
        index += 1
        yield
    for k in (name, "loop"):
        env.pop(k, None)
    env.update(saved)


_END = object()


def _block(node: tuple, filters: dict[str, Callable]) -> Callable[[dict, Output], None]:
    kind = node[0]
    if kind == "text":
        return lambda env, out, s=node[1]: out.put(s)
    if kind == "put":
        value = _compiled(node[1], filters)
        return lambda env, out: out.put(_text(value(env)))
    if kind == "set":
        value = _compiled(node[2], filters)

        def assign(env, out, n=node[1]):
            env[n] = value(env)

        return assign
    if kind == "generation":
        body = _chained(node[1], filters)

        def generation(env, out):
            start = out.length
            out.marked += 1
            body(env, out)
            out.marked -= 1
            if not out.marked:  # of nested ones the outermost counts
                out.spans.append((start, out.length))

        return generation
    if kind == "if":
        arms, other = [(_compiled(c, filters), _chained(b, filters)) for c, b in node[1]], _chained(node[2], filters)

        def choose(env, out):
            next((body for cond, body in arms if cond(env)), other)(env, out)

        return choose
    values, body, other = _compiled(node[2], filters), _chained(node[3], filters), _chained(node[4], filters)

    def loop(env, out, name=node[1]):
        turns = 0
        for _ in _looped(_listed(values(env)), env, name):
            body(env, out)
            turns += 1
        if not turns:
            other(env, out)

    return loop


def _listed(value: object) -> Iterable:
    if value is None:
        return ()
    if isinstance(value, (str, int, dict)):
        raise TemplateError(f"a {type(value).__name__} isn't a list")
    return value


def _uses(node: object, name: str) -> int:
    """How often a tree has a variable."""
    if isinstance(node, tuple) and node[:1] == ("name",):
        return int(node[1] == name)
    return sum(_uses(x, name) for x in node) if isinstance(node, (tuple, list)) else 0


class Template:
    """A compiled template. The variables given to it are plain values; the list of an outermost loop may be an iterator, which is read once."""

    def __init__(self, source: str, filters: dict[str, Callable] | None = None):
        self.filters = FILTERS | (filters or {})
        self.tree = folded_blocks(parsed(source, self.filters), self.filters)
        self._blocks = [self._outer(n) for n in self.tree]

    def _outer(self, node: tuple) -> Block:
        if node[0] != "for":
            run = _block(node, self.filters)

            def once(env, out):
                run(env, out)
                yield

            return once
        values, body, other = _compiled(node[2], self.filters), _chained(node[3], self.filters), _chained(node[4], self.filters)

        def turns(env, out, name=node[1]):
            none = True
            for _ in _looped(_listed(values(env)), env, name):
                none = False
                body(env, out)
                yield
            if none:
                other(env, out)
                yield

        return turns

    def streams(self, name: str) -> bool:
        """Whether a variable is used by one outermost loop alone, which goes through it once, so that it may be an iterator."""
        loops = sum(n[0] == "for" and n[2] == ("name", name) for n in self.tree)
        return loops == 1 == _uses(self.tree, name)

    def render(self, **variables: object) -> tuple[str, list[tuple[int, int]]]:
        """(text, spans of what a model is to learn)"""
        out, env = Output(), dict(variables)
        for block in self._blocks:
            for _ in block(env, out):
                pass
        return "".join(out.texts), out.spans

    def pieces(self, most: int, **variables: object) -> Iterator[tuple[int, str, list[tuple[int, int]]]]:
        """(start, text, spans) of pieces that end where an outermost loop's turn does, once they have `most` code points. Joined they are what render() gives; there is always one."""
        out, env, start = Output(), dict(variables), 0
        for block in self._blocks:
            for _ in block(env, out):
                if out.length - start >= most:
                    yield start, "".join(out.texts), out.spans
                    out.texts, out.spans, start = [], [], out.length
        if out.texts or out.spans or not out.length:
            yield start, "".join(out.texts), out.spans
