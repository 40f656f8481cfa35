"""Chat formatting with a template compiler.

A small sandboxed template language is tokenized, parsed into a syntax tree, folded
where all parts are constant, and compiled into Python closures. A template knows
only its variables and a fixed set of filters; it can't call methods or reach
attributes of Python objects. Rendering is lazy: it yields pieces of text with a flag
that tells whether they lie in a generation block. A template that runs over the messages
once, and else asks for the first one alone, gets them as they are read, so a
conversation of any length is formatted; for other templates a conversation is held.

    {{ expression }}   {% for x in expression %} ... {% endfor %}   {% set x = expression %}
    {% if expression %} ... {% elif expression %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}   {# comment #}

Expressions have strings, integers, true, false, none, names, x.field, x['field'],
==, !=, <, <=, >, >=, and, or, not, +, ~ (concatenation), % and filters: x | trim.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, fields, is_dataclass
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import BATCH_ROWS, arrow_map

Piece = tuple[str, bool]

#: Marks of the standard template; strings of texts that equal one are escaped.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|role|>", "<|turn|>", "<|end|>")
CHAT = (
    "{% for m in messages %}{# the role stands in its own marks #}<|role|>{{ m.role | escape }}<|turn|>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "{{ '<|' ~ 'end' ~ '|>' }}{{ '\\n' }}{% endfor %}"
)


class TemplateError(ValueError):
    """A template that can't be read or that asks for what it may not have."""


def escape(text: str) -> str:
    """Text without control strings: backslashes are doubled, and one goes into each control string."""
    if "\\" in text:
        text = text.replace("\\", "\\\\")
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text) if "\\" in text else text


_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))
_ESCAPED = re.compile(r"\\(\\?)")

FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda v: escape(_text(v)),
    "trim": lambda v: _text(v).strip(),
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "length": lambda v: len(v),
}


def _text(v: Any) -> str:
    return "" if v is None else ("true" if v else "false") if isinstance(v, bool) else str(v)


# --- syntax tree ---


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Op:
    name: str
    args: tuple


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Show:
    value: Any


@dataclass(frozen=True)
class Block:
    parts: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: Block


@dataclass(frozen=True)
class If:
    arms: tuple  # of (condition, Block)


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: Block


_PARTS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
_WORDS = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>+~%|.()\[\],=-]))")


class _Expression:
    def __init__(self, source: str):
        self.words, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _WORDS.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.words.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *texts: str) -> bool:
        return self.at < len(self.words) and self.words[self.at][0] in ("op", "name") and self.words[self.at][1] in texts

    def take(self, *texts: str) -> str:
        if not self.peek(*texts):
            raise TemplateError(f"expected {' or '.join(texts)}")
        self.at += 1
        return self.words[self.at - 1][1]

    def whole(self) -> Any:
        out = self.either()
        if self.at != len(self.words):
            raise TemplateError(f"unexpected {self.words[self.at][1]!r}")
        return out

    def _chain(self, names: tuple[str, ...], below: Callable[[], Any]) -> Any:
        out = below()
        while self.peek(*names):
            out = Op(self.take(*names), (out, below()))
        return out

    def either(self) -> Any:
        return self._chain(("or",), self.both)

    def both(self) -> Any:
        return self._chain(("and",), self.negated)

    def negated(self) -> Any:
        if self.peek("not"):
            self.take("not")
            return Op("not", (self.negated(),))
        return self._chain(("==", "!=", "<", "<=", ">", ">="), self.joined)

    def joined(self) -> Any:
        return self._chain(("+", "~", "%", "-"), self.filtered)

    def filtered(self) -> Any:
        out = self.value()
        while self.peek("|"):
            self.take("|")
            name = self.words[self.at][1] if self.at < len(self.words) else ""
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            out = Op("filter:" + name, (out,))
        return out

    def value(self) -> Any:
        if self.at >= len(self.words):
            raise TemplateError("an expression ends too early")
        kind, text = self.words[self.at]
        self.at += 1
        if kind == "str":
            out: Any = Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1], flags=re.S))
        elif kind == "int":
            out = Const(int(text))
        elif text == "(":
            out = self.either()
            self.take(")")
        elif kind == "name" and text in ("true", "false", "none"):
            out = Const({"true": True, "false": False, "none": None}[text])
        elif kind == "name" and text not in ("and", "or", "not", "in"):
            out = Name(text)
        else:
            raise TemplateError(f"unexpected {text!r}")
        while self.peek(".", "["):
            if self.take(".", "[") == ".":
                if self.at >= len(self.words) or self.words[self.at][0] != "name":
                    raise TemplateError("a field's name must follow a point")
                out = Item(out, Const(self.words[self.at][1]))
                self.at += 1
            else:
                out = Item(out, self.either())
                self.take("]")
        return out


def parse(source: str) -> Block:
    """The syntax tree of a template."""
    stack: list[tuple[str, list, Any]] = [("", [], None)]
    for part in _PARTS.split(source):
        if not part:
            continue
        kind, inside = part[:2], part[2:-2].strip()
        if kind == "{#":
            continue
        if kind == "{{":
            stack[-1][1].append(Show(_Expression(inside).whole()))
        elif kind == "{%":
            word, _, rest = inside.partition(" ")
            top, parts, head = stack[-1]
            if word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)
                if not m:
                    raise TemplateError(f"can't read {part!r}")
                stack.append(("for", [], (m[1], _Expression(m[2]).whole())))
            elif word == "endfor" and top == "for":
                stack.pop()
                stack[-1][1].append(For(head[0], head[1], Block(tuple(parts))))
            elif word == "if":
                stack.append(("if", [], [[_Expression(rest).whole(), None]]))
            elif word in ("elif", "else") and top == "if":
                head[-1][1] = Block(tuple(parts))
                head.append([_Expression(rest).whole() if word == "elif" else Const(True), None])
                stack[-1] = ("if", [], head)
            elif word == "endif" and top == "if":
                head[-1][1] = Block(tuple(parts))
                stack.pop()
                stack[-1][1].append(If(tuple((c, b) for c, b in head)))
            elif word == "set":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s*=\s*(.+)", rest.strip(), re.S)
                if not m:
                    raise TemplateError(f"can't read {part!r}")
                parts.append(Set(m[1], _Expression(m[2]).whole()))
            elif word == "generation":
                stack.append(("generation", [], None))
            elif word == "endgeneration" and top == "generation":
                stack.pop()
                stack[-1][1].append(Generation(Block(tuple(parts))))
            else:
                raise TemplateError(f"unexpected {part!r}")
        else:
            stack[-1][1].append(Text(part))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} isn't closed")
    return Block(tuple(stack[0][1]))


_PLAIN: dict[str, Callable[..., Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "%": lambda a, b: int(a) % int(b),
    "~": lambda a, b: _text(a) + _text(b),
    "not": lambda a: not a,
    "and": lambda a, b: a and b,
    "or": lambda a, b: a or b,
} | {"filter:" + k: f for k, f in FILTERS.items()}


def _guarded(f: Callable[..., Any]) -> Callable[..., Any]:
    def call(*args: Any) -> Any:
        try:
            return f(*args)
        except (TypeError, ValueError, ZeroDivisionError) as e:
            raise TemplateError(str(e)) from None

    return call


_PLAIN = {k: f if k in ("==", "!=", "~", "not", "and", "or", "filter:escape") else _guarded(f) for k, f in _PLAIN.items()}


def fold(node: Any) -> Any:
    """The tree with constant expressions computed, dead arms dropped and neighbouring texts joined."""
    if isinstance(node, Op):
        args = tuple(map(fold, node.args))
        return Const(_PLAIN[node.name](*(a.value for a in args))) if all(isinstance(a, Const) for a in args) else Op(node.name, args)
    if isinstance(node, Item):
        return Item(fold(node.of), fold(node.key))
    if isinstance(node, Show):
        value = fold(node.value)
        return Text(_text(value.value)) if isinstance(value, Const) else Show(value)
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Set):
        return Set(node.name, fold(node.value))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        arms = []
        for c, b in ((fold(c), fold(b)) for c, b in node.arms):
            if isinstance(c, Const) and not c.value:
                continue
            arms.append((c, b))
            if isinstance(c, Const):
                break
        return arms[0][1] if arms and isinstance(arms[0][0], Const) else If(tuple(arms)) if arms else Block(())
    if isinstance(node, Block):
        parts: list[Any] = []
        for p in map(fold, node.parts):
            for q in p.parts if isinstance(p, Block) else (p,):
                if isinstance(q, Text) and parts and isinstance(parts[-1], Text):
                    parts[-1] = Text(parts[-1].value + q.value)
                elif not isinstance(q, Text) or q.value:
                    parts.append(q)
        return Block(tuple(parts))
    return node


Scope = dict[str, Any]


def _value(node: Any) -> Callable[[Scope], Any]:
    if isinstance(node, Const):
        return lambda scope, v=node.value: v
    if isinstance(node, Name):
        return lambda scope, n=node.name: scope.get(n)
    if isinstance(node, Item):
        of, key = _value(node.of), _value(node.key)

        def item(scope: Scope) -> Any:
            holder, k = of(scope), key(scope)
            if isinstance(holder, dict):
                return holder.get(k)
            if isinstance(holder, Turns):
                return holder.first() if k == 0 else None
            if isinstance(holder, (list, tuple, str)) and isinstance(k, int):
                return holder[k] if -len(holder) <= k < len(holder) else None
            return None  # nothing of a Python object can be reached

        return item
    args = [_value(a) for a in node.args]
    if node.name == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if node.name == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    f = _PLAIN[node.name]
    return (lambda scope: f(args[0](scope))) if len(args) == 1 else (lambda scope: f(args[0](scope), args[1](scope)))


def _pieces(node: Any) -> Callable[[Scope, bool], Iterator[Piece]]:
    if isinstance(node, Text):
        return lambda scope, flag, v=node.value: iter(((v, flag),))
    if isinstance(node, Show):
        value = _value(node.value)
        return lambda scope, flag: iter(((_text(value(scope)), flag),))
    if isinstance(node, Generation):
        body = _pieces(node.body)
        return lambda scope, flag: body(scope, True)
    if isinstance(node, Set):
        value, name = _value(node.value), node.name

        def put(scope: Scope, flag: bool) -> Iterator[Piece]:
            scope[name] = value(scope)
            return iter(())

        return put
    if isinstance(node, If):
        arms = [(_value(c), _pieces(b)) for c, b in node.arms]
        return lambda scope, flag: next((b(scope, flag) for c, b in arms if c(scope)), iter(()))
    if isinstance(node, For):
        over, body, name = _value(node.over), _pieces(node.body), node.name

        def loop(scope: Scope, flag: bool) -> Iterator[Piece]:
            for k, (x, last) in enumerate(_marked(over(scope) or ())):
                yield from body(scope | {name: x, "loop": {"index0": k, "index": k + 1, "first": k == 0, "last": last}}, flag)

        return loop
    parts = [_pieces(p) for p in node.parts]

    def block(scope: Scope, flag: bool) -> Iterator[Piece]:
        for p in parts:
            yield from p(scope, flag)

    return block


class Turns:
    """Messages that can be run over once, and whose first can be looked at before."""

    def __init__(self, messages: Iterable[dict[str, str]]):
        self.rest, self.head = iter(messages), []

    def first(self) -> dict[str, str] | None:
        if not self.head:
            self.head = list(itertools.islice(self.rest, 1))
        return self.head[0] if self.head else None

    def __iter__(self) -> Iterator[dict[str, str]]:
        return itertools.chain([m] if (m := self.first()) is not None else [], self.rest)


def _marked(items: Iterable[Any]) -> Iterator[tuple[Any, bool]]:
    """Items and whether they are the last."""
    items = iter(items)
    for x in items:
        for y in items:
            yield x, False
            x = y
        yield x, True


def in_order(source: str, name: str = "messages") -> bool:
    """Whether a template runs over `name` once at most, outside of loops, and else takes its first item alone."""
    runs = 0

    def uses(node: Any, looping: bool) -> bool:
        nonlocal runs
        if isinstance(node, Name):
            return node.name == name
        if isinstance(node, Item) and node.of == Name(name) and node.key == Const(0):
            return False
        if isinstance(node, For):
            mine = node.over == Name(name)
            runs += mine
            return mine and looping or not mine and uses(node.over, looping) or uses(node.body, True)
        if isinstance(node, (tuple, list)):
            return any([uses(x, looping) for x in node])
        return is_dataclass(node) and any([uses(getattr(node, f.name), looping) for f in fields(node)])

    other = uses(fold(parse(source)), False)
    return not other and runs <= 1


@lru_cache(maxsize=32)
def compile_template(source: str) -> Callable[[dict[str, Any]], Iterator[Piece]]:
    """A function from variables to the pieces of the rendered text and their generation flags."""
    run = _pieces(fold(parse(source)))
    return lambda variables: run(dict(variables), False)


def render(source: str, **variables: Any) -> tuple[str, list[tuple[int, int]]]:
    """The rendered text and the spans of it that lie in generation blocks."""
    out, spans, at = [], [], 0
    for text, flag in compile_template(source)(variables):
        if flag and text:
            if spans and spans[-1][1] == at:
                spans[-1] = (spans[-1][0], at + len(text))
            else:
                spans.append((at, at + len(text)))
        out.append(text)
        at += len(text)
    return "".join(out), spans


@dataclass(frozen=True)
class Format:
    """A template and how to read turns back from what it renders.

    turn is a pattern with groups `role` and `text`, both escaped as by the filter escape;
    end is the mark that ends each turn; other is a pattern of what may stand between turns.
    """

    template: str
    turn: str
    end: str
    other: str = r"(?!)"


STANDARD = Format(CHAT, r"<\|role\|>(?P<role>.*?)<\|turn\|>(?P<text>.*?)<\|end\|>\n", "<|end|>\n")


class Reader:
    """Reads roles and texts back from rendered pieces; holds one turn."""

    def __init__(self, fmt: Format):
        self.end, self.unit, self.held, self.tail = fmt.end, re.compile(f"{fmt.turn}|{fmt.other}", re.S), [], ""

    def add(self, piece: str) -> Iterator[tuple[str, str]]:
        self.held.append(piece)
        near = self.tail + piece
        self.tail = near[-(len(self.end) - 1) :] if len(self.end) > 1 else ""
        if self.end in near:
            yield from self._read("".join(self.held), False)

    def close(self) -> Iterator[tuple[str, str]]:
        yield from self._read("".join(self.held), True)

    def _read(self, text: str, whole: bool) -> Iterator[tuple[str, str]]:
        at = 0
        while at < len(text) and (m := self.unit.match(text, at)) and m.end() > at:
            if m["role"] is not None:
                yield unescape(m["role"]), unescape(m["text"])
            at = m.end()
        if whole and at < len(text):
            raise ValueError("not a formatted conversation")
        self.held = [text[at:]]


def read_back(formatted: str, fmt: Format = STANDARD) -> Iterator[tuple[str, str]]:
    """Roles and texts of what a format rendered."""
    reader = Reader(fmt)
    yield from reader.add(formatted)
    yield from reader.close()


class _Digest:
    """What is told about one conversation, read from its formatted pieces."""

    def __init__(self, conv_id: Any, fmt: Format, keep_text: bool):
        self.conv_id, self.reader, self.turns, self.loss = conv_id, Reader(fmt), hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.masked: list[str] = []
        self.text: list[str] | None = [] if keep_text else None
        self.spans: list[tuple[int, int]] = []

    def add(self, piece: str, flag: bool) -> None:
        if not piece:
            return
        if flag:
            self.masked.append(piece)
        else:
            self._unmask()
        self._turns(self.reader.add(piece))
        self.formatted_chars += len(piece)
        if self.text is not None:
            self.text.append(piece)

    def _turns(self, turns: Iterator[tuple[str, str]]) -> None:
        for role, text in turns:
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            self.n_turns += 1

    def _unmask(self) -> None:
        """Take up the masked stretch that ends here."""
        if not self.masked:
            return
        masked = "".join(self.masked)
        said = unescape(masked)
        self.loss.update(said.encode("utf-8", "surrogatepass"))
        self.loss_chars += len(said)
        if self.text is not None:
            self.spans.append((self.formatted_chars - len(masked), self.formatted_chars))
        self.masked = []

    def row(self) -> tuple:
        self._unmask()
        self._turns(self.reader.close())
        out = (self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars)
        return out if self.text is None else (*out, "".join(self.text), [list(s) for s in self.spans])


#: The conversation that every run formats besides: its texts are made of control strings.
PROBE = ((-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"))


def format_conversations(conversations: DataFrame, fmt: Format = STANDARD, with_text: bool = False) -> DataFrame:
    """Format each conversation whole with a format's template and describe what is read back from it, one row per conv_id.

    Turns are ordered by turn, then role and text; null turns come first; null roles and
    texts count as empty; repeated rows are repeated turns. Each row without conv_id is a
    conversation of its own, with a null id. Other columns are ignored. With a template that
    takes messages in order they are streamed, so a conversation may be of any length;
    other templates, and with_text, which adds `formatted` and `loss_spans`, hold it in memory.
    """
    spark = conversations.sparkSession
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    ordered = rows.withColumn("_alone", alone).repartition(n, "conv_id", "_alone").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    kinds = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    if with_text:
        kinds += [("formatted", pa.string()), ("loss_spans", pa.list_(pa.list_(pa.int64())))]
        schema += ", formatted string, loss_spans array<array<long>>"
    hold: Callable[[Iterable], Any] = Turns if in_order(fmt.template) else list

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, (_, t) in enumerate(kinds)], names=[c for c, _ in kinds])

        template, done = compile_template(fmt.template), []
        turns = itertools.chain.from_iterable(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True) for b in batches)
        for (conv_id, _), group in itertools.groupby(enumerate(turns), lambda x: (x[1][0], x[0] if x[1][0] is None else 0)):
            now = _Digest(conv_id, fmt, with_text)
            for piece, flag in template({"messages": hold({"role": role, "text": text} for _, (_, role, text) in group)}):
                now.add(piece, flag)
            done.append(now.row())
            if len(done) >= BATCH_ROWS or with_text:
                yield batch(done)
                done = []
        yield batch(done)

    return arrow_map(ordered, run, schema)


def with_probe(conversations: DataFrame) -> DataFrame:
    probe = conversations.sparkSession.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe)
