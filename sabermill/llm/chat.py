"""Chat formatting by a small sandboxed template language, compiled to Python closures.

    {{ expression }}   {% for m in messages %} .. {% endfor %}   {% if .. %} {% elif .. %} {% else %} {% endif %}
    {% set name = expression %}   {% generation %} .. {% endgeneration %}   {# comment #}

Expressions: 'text', integers, true, false, none, names, m.field, m['field'], loop.first / last / index / index0, + ~ == != < <= > >= in not and or,
``a if c else b`` and the filters trim, upper, lower, escape, length, default(x), string. Fields are looked up in messages and ``loop`` alone; there are no calls,
no Python attributes and no loops but over messages, so a template cannot reach the host. Nesting is at most DEPTH deep and a source at most SOURCE_CHARS long, what + and ~ join
is at most VALUE_CHARS long, and whatever goes wrong in a template, when it is read or when it runs, is a TemplateError.

A template is parsed into a tree, constant parts are folded, and each node becomes a closure. Rendering is a stream over a stream of messages, so that a conversation of any
length takes the memory of one message.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Strings that only the template may write.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")

TEMPLATE = (
    "{% for m in messages %}<s>[INST] {{ m.role | escape }} [/INST]"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "</s>{% endfor %}"
)

#: Rendered text is returned in parts of whole turns of about this many characters.
PART_CHARS = 1 << 20

#: Bounds of what a template may ask for.
DEPTH, SOURCE_CHARS, VALUE_CHARS = 40, 1 << 16, 1 << 24

_ESCAPE = re.compile(r"\\|" + "|".join(re.escape(c[0]) + f"(?={re.escape(c[1:])})" for c in CONTROL))
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """No control string is left in the result: a backslash goes after its first character, and backslashes are doubled."""
    return _ESCAPE.sub(lambda m: "\\\\" if m.group() == "\\" else m.group() + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


class TemplateError(ValueError):
    """The template is not in the language, or asks for what messages don't have."""


# ---- syntax tree: expressions are ("const", v), ("name", n), ("field", e, key), ("op", o, a, b), ("not", e), ("cond", c, a, b), ("filter", n, e, args)
# ---- statements are ("text", e), ("for", var, body), ("if", [(test, body)], rest), ("set", n, e), ("gen", body)

_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>|().,\[\]=]))")
_BLOCK = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.DOTALL)
_WORDS = {"true": True, "false": False, "none": None}
_FILTERS: dict[str, Callable] = {
    "trim": lambda x: str(x).strip(),
    "upper": lambda x: str(x).upper(),
    "lower": lambda x: str(x).lower(),
    "escape": lambda x: escape(str(x)),
    "string": lambda x: "" if x is None else str(x),
    "length": lambda x: len(str(x)),
    "default": lambda x, other="": other if x is None else x,
}
_OPS: dict[str, Callable] = {
    "+": lambda a, b: _joined(a, b),
    "~": lambda a, b: _joined(_text(a), _text(b)),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: _text(a) in _text(b),
}


def _text(x) -> str:
    return "" if x is None else str(x)


def _joined(a, b):
    if isinstance(a, str) and isinstance(b, str) and len(a) + len(b) > VALUE_CHARS:
        raise TemplateError(f"a value of over {VALUE_CHARS} characters")
    return a + b


def _safe(f: Callable, *args):
    """What a template's own mistakes raise is its error, not the engine's."""
    try:
        return f(*args)
    except (TypeError, ValueError, AttributeError) as error:
        raise error if isinstance(error, TemplateError) else TemplateError(str(error)) from error


class _Expression:
    """Recursive descent over one expression's tokens."""

    def __init__(self, source: str) -> None:
        self.tokens, at, self.depth = [], 0, 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m or m.end() == at:
                raise TemplateError(f"unreadable expression: {source!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else None

    def take(self, value: str) -> bool:
        if self.peek() == value:
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def whole(self):
        out = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"left over: {self.tokens[self.at][1]!r}")
        return out

    def deeper(self, parse: Callable):
        self.depth += 1
        if self.depth > DEPTH:
            raise TemplateError(f"an expression nested over {DEPTH} deep")
        out = parse()
        self.depth -= 1
        return out

    def choice(self):
        value = self.either()
        if self.take("if"):
            test = self.either()
            other = self.deeper(self.choice) if self.take("else") else ("const", "")
            return ("cond", test, value, other)
        return value

    def chained(self, part: Callable, joints: tuple[str, ...], node: Callable):
        """Parts joined from the left; a tree is as deep as its chain, so chains count as nesting."""
        out, links = part(), 0
        while (joint := self.peek()) in joints:
            self.at += 1
            links += 1
            if links > DEPTH:
                raise TemplateError(f"a chain of over {DEPTH} {joint!r}")
            out = node(joint, out, part())
        return out

    def either(self):
        return self.chained(self.both, ("or",), lambda _, a, b: ("or", a, b))

    def both(self):
        return self.chained(self.negated, ("and",), lambda _, a, b: ("and", a, b))

    def negated(self):
        return ("not", self.deeper(self.negated)) if self.take("not") else self.compared()

    def compared(self):
        def node(op: str, a, b):
            return ("not", ("op", "in", a, b)) if op == "not" else ("op", op, a, b)

        def side():
            if self.at and self.tokens[self.at - 1] == ("name", "not") and self.peek() == "in":
                self.at += 1
            elif self.at and self.tokens[self.at - 1] == ("name", "not") and self.at != start:
                raise TemplateError("'in' is missing")
            return self.joined()

        start = self.at
        return self.chained(side, ("==", "!=", "<", "<=", ">", ">=", "in", "not"), node)

    def joined(self):
        return self.chained(self.filtered, ("+", "~"), lambda op, a, b: ("op", op, a, b))

    def filtered(self):
        out, links = self.reached(), 0
        while self.take("|"):
            name, links = self.name(), links + 1
            if links > DEPTH:
                raise TemplateError(f"a chain of over {DEPTH} filters")
            if name not in _FILTERS:
                raise TemplateError(f"no filter {name!r}")
            args = []
            if self.take("("):
                while not self.take(")"):
                    args.append(self.deeper(self.choice))
                    self.take(",")
            out = ("filter", name, out, tuple(args))
        return out

    def reached(self):
        out = self.atom()
        for _ in range(DEPTH):
            if self.take("."):
                out = ("field", out, ("const", self.name()))
            elif self.take("["):
                out = ("field", out, self.deeper(self.choice))
                self.need("]")
            else:
                return out
        raise TemplateError(f"a chain of over {DEPTH} fields")

    def name(self) -> str:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return value

    def atom(self):
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        if self.take("("):
            out = self.deeper(self.choice)
            self.need(")")
            return out
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1], flags=re.DOTALL))
        if kind == "int":
            return ("const", _safe(int, value))
        if kind == "name":
            return ("const", _WORDS[value]) if value in _WORDS else ("name", value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> list:
    """The syntax tree of a template."""
    if len(source) > SOURCE_CHARS:
        raise TemplateError(f"a template of over {SOURCE_CHARS} characters")
    pieces, at = [], 0
    for m in _BLOCK.finditer(source):
        if m.start() > at:
            pieces.append(("text", source[at : m.start()]))
        if m[1] is not None:
            pieces.append(("value", m[1]))
        elif m[2] is not None:
            pieces.append(("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        pieces.append(("text", source[at:]))
    body, rest, _ = _body(pieces, 0, ())
    if rest < len(pieces):
        raise TemplateError(f"unexpected tag {pieces[rest][1]!r}")
    return body


def _body(pieces: list, at: int, until: tuple[str, ...], depth: int = 0) -> tuple[list, int, str]:
    if depth > DEPTH:
        raise TemplateError(f"tags nested over {DEPTH} deep")
    out: list = []
    while at < len(pieces):
        kind, value = pieces[at]
        if kind == "text":
            out.append(("text", ("const", value)))
        elif kind == "value":
            out.append(("text", _Expression(value).whole()))
        else:
            word, _, rest = value.partition(" ")
            if word in until:
                return out, at, value
            at = _statement(word, rest.strip(), pieces, at, out, depth + 1)
            continue
        at += 1
    if until:
        raise TemplateError(f"{until[-1]!r} is missing")
    return out, at, ""


def _statement(word: str, rest: str, pieces: list, at: int, out: list, depth: int) -> int:
    if word == "for":
        m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+messages", rest)
        if not m:
            raise TemplateError("loops go over messages alone")
        body, at, _ = _body(pieces, at + 1, ("endfor",), depth)
        out.append(("for", m[1], body))
    elif word == "if":
        arms, other, test = [], [], _Expression(rest).whole()
        while True:
            body, at, end = _body(pieces, at + 1, ("elif", "else", "endif"), depth)
            arms.append((test, body))
            if end.startswith("elif"):
                test = _Expression(end[4:]).whole()
                continue
            if end == "else":
                other, at, _ = _body(pieces, at + 1, ("endif",), depth)
            break
        out.append(("if", arms, other))
    elif word == "set":
        name, eq, value = rest.partition("=")
        if not eq or not re.fullmatch(r"[A-Za-z_]\w*", name.strip()):
            raise TemplateError("set needs a name and a value")
        out.append(("set", name.strip(), _Expression(value).whole()))
    elif word == "generation":
        body, at, _ = _body(pieces, at + 1, ("endgeneration",), depth)
        out.append(("gen", body))
    else:
        raise TemplateError(f"no tag {word!r}")
    return at + 1


def fold(body: list) -> list:
    """Constant expressions evaluated, constant branches chosen, neighbouring constant texts joined."""
    out: list = []
    for node in body:
        kind = node[0]
        if kind == "text":
            e = _folded(node[1])
            if e[0] == "const":
                e = ("const", _text(e[1]))
                if out and out[-1][0] == "text" and out[-1][1][0] == "const":
                    out[-1] = ("text", ("const", out[-1][1][1] + e[1]))
                    continue
                if not e[1]:
                    continue
            out.append(("text", e))
        elif kind == "for":
            out.append(("for", node[1], fold(node[2])))
        elif kind == "gen":
            out.append(("gen", fold(node[1])))
        elif kind == "set":
            out.append(("set", node[1], _folded(node[2])))
        else:
            arms, rest = [], fold(node[2])
            for test, part in node[1]:
                test = _folded(test)
                if test[0] == "const" and not test[1]:
                    continue
                if test[0] == "const":
                    rest = fold(part)
                    break
                arms.append((test, fold(part)))
            if arms:
                out.append(("if", arms, rest))
            else:
                out = fold([*out, *rest])
    return out


def _folded(e: tuple) -> tuple:
    if e[0] in ("const", "name"):
        return e
    parts = tuple(_folded(x) if isinstance(x, tuple) and x and isinstance(x[0], str) else tuple(map(_folded, x)) if isinstance(x, tuple) else x for x in e[1:])
    done = (e[0], *parts)
    inner = [x for x in parts if isinstance(x, tuple) and x and isinstance(x[0], str)] + [y for x in parts if isinstance(x, tuple) and x and isinstance(x[0], tuple) for y in x]
    if e[0] != "field" and all(x[0] == "const" for x in inner):
        return ("const", _value(done)({}))
    return done


def _value(e: tuple) -> Callable[[dict], object]:
    """A closure from the names in scope to the expression's value."""
    kind = e[0]
    if kind == "const":
        return lambda env, v=e[1]: v
    if kind == "name":
        return lambda env, n=e[1]: env.get(n)
    if kind == "field":
        of, key = _value(e[1]), _value(e[2])

        def field(env):
            found = of(env)
            if not isinstance(found, dict):
                raise TemplateError("only messages and loop have fields")
            return _safe(found.get, key(env))

        return field
    if kind == "op":
        f, a, b = _OPS[e[1]], _value(e[2]), _value(e[3])
        return lambda env: _safe(f, a(env), b(env))
    if kind == "not":
        a = _value(e[1])
        return lambda env: not a(env)
    if kind in ("and", "or"):
        a, b = _value(e[1]), _value(e[2])
        return (lambda env: a(env) and b(env)) if kind == "and" else (lambda env: a(env) or b(env))
    if kind == "cond":
        c, a, b = map(_value, e[1:])
        return lambda env: a(env) if c(env) else b(env)
    f, a, args = _FILTERS[e[1]], _value(e[2]), [_value(x) for x in e[3]]
    return lambda env: _safe(f, a(env), *[x(env) for x in args])


Chunk = tuple[str, bool]


def _compiled(body: list) -> Callable[[dict, bool], Iterator[Chunk]]:
    """A closure that streams (text, whether it is generated by the model)."""
    steps = [_step(node) for node in body]

    def run(env: dict, masked: bool) -> Iterator[Chunk]:
        for step in steps:
            yield from step(env, masked)

    return run


def _step(node: tuple) -> Callable[[dict, bool], Iterator[Chunk]]:
    kind = node[0]
    if kind == "text":
        value = _value(node[1])
        return lambda env, masked: iter(((_text(value(env)), masked),))
    if kind == "gen":
        inner = _compiled(node[1])
        return lambda env, masked: inner(env, True)
    if kind == "set":
        name, value = node[1], _value(node[2])

        def assign(env: dict, masked: bool) -> Iterator[Chunk]:
            env[name] = value(env)
            return iter(())

        return assign
    if kind == "if":
        arms, other = [(_value(t), _compiled(b)) for t, b in node[1]], _compiled(node[2])
        return lambda env, masked: next((b for t, b in arms if t(env)), other)(env, masked)
    name, inner = node[1], _compiled(node[2])

    def loop(env: dict, masked: bool) -> Iterator[Chunk]:
        messages, index = iter(env["messages"]), 0
        message = next(messages, None)
        while message is not None:
            following = next(messages, None)
            scope = env | {name: message, "loop": {"first": index == 0, "last": following is None, "index": index + 1, "index0": index}}
            yield from inner(scope, masked)
            yield "", None  # end of a turn: a part may end here
            message, index = following, index + 1

    return loop


class Template:
    """A compiled template."""

    def __init__(self, source: str = TEMPLATE) -> None:
        self.source, self.tree = source, fold(parse(source))
        self._run = _compiled(self.tree)

    def stream(self, messages: Iterable[dict]) -> Iterator[Chunk]:
        """Chunks of text with their mark; an empty chunk marked None ends a turn."""
        return self._run({"messages": messages}, False)

    def render(self, messages: Iterable[dict]) -> tuple[str, list[tuple[int, int]]]:
        """The whole text and the spans that are under generation markers."""
        out, spans, at = [], [], 0
        for text, masked in self.stream(messages):
            if masked and text:
                spans = [*spans[:-1], (spans[-1][0], at + len(text))] if spans and spans[-1][1] == at else [*spans, (at, at + len(text))]
            out.append(text)
            at += len(text)
        return "".join(out), spans


def format_conversations(rows: DataFrame, template: str = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, part, formatted, spans array<struct<start,end>>): each conversation's rendered text in parts of whole turns, in order.

    Turns are ordered by (turn, role, text), nulls first; null role or text: empty; repeated rows are turns of their own; null conversation ids are one conversation. Each
    conversation is rendered as a stream by one task, which holds one turn and one part, never the conversation. ``spans``: code point offsets, in the part, of what
    the model generates. Rows come out grouped by conversation, parts in order. An empty table gives no rows.
    """
    Template(template)  # errors show on the driver
    cols = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = cols.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Template(template)
        stream = ((i, {"role": r, "text": t}) for b in batches for i, r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()))
        held: list[tuple] = []
        size = 0
        for conv, own in groupby(stream, key=lambda x: x[0]):
            text, spans, at, part = [], [], 0, 0
            for chunk, masked in made.stream(m for _, m in own):
                if masked is None and at >= PART_CHARS:
                    held.append((conv, part, "".join(text), spans))
                    size += at
                    text, spans, at, part = [], [], 0, part + 1
                    if size >= 4 * PART_CHARS:
                        yield _parts(held)
                        held, size = [], 0
                if masked:
                    spans.append({"start": at, "end": at + len(chunk)})
                text.append(chunk)
                at += len(chunk)
            if at or not part:
                held.append((conv, part, "".join(text), spans))
                size += at
            if size >= 4 * PART_CHARS or len(held) >= 5000:
                yield _parts(held)
                held, size = [], 0
        yield _parts(held)

    return ordered.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, part long, formatted string, spans array<struct<start:long,end:long>>")


def _parts(held: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
    return pa.RecordBatch.from_arrays([pa.array([h[k] for h in held], kind) for k, kind in enumerate(kinds)], ["conv_id", "part", "formatted", "spans"])


_TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\](.*?)</s>", re.DOTALL)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of what TEMPLATE wrote; anything else in the text is an error."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"text outside a turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"text outside a turn at {at}")
    return out


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of each conversation, read from the parts that ``format_conversations`` returned, in one pass over their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((*r,) for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()))
        out = []
        for conv, own in groupby(rows, key=lambda x: x[0]):
            turns, loss, n, chars, total = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, formatted, spans in own:
                total += len(formatted)
                for role, text in read_turns(formatted):
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                for s in spans:
                    text = unescape(formatted[s["start"] : s["end"]])
                    loss.update(text.encode())
                    chars += len(text)
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), total))
            if len(out) == 5000:
                yield digests(out)
                out = []
        yield digests(out)

    def digests(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return parts.select("conv_id", "formatted", "spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
