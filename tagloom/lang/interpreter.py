"""Tokenizer and stack interpreter of the postfix expression language."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

MAX_STACK, MAX_DEPTH = 1024, 10
_COMMENT = re.compile(r"/\*.*?\*/", re.S)
_UNICODE = re.compile(r"\\u([0-9a-fA-F]{4})")


class ProgramError(ValueError):
    """A program that can't be parsed or executed."""


def tokenize(program: str) -> list[str]:
    """Words between commas, trimmed, without empty ones and comments."""
    return [t for t in (p.strip() for p in _COMMENT.sub("", program).split(",")) if t]


def unescape(token: str) -> str:
    return _UNICODE.sub(lambda m: chr(int(m[1], 16)), token)


@dataclass
class Word:
    """One overload: `matches` looks at the stack, `run` changes the context."""

    name: str
    matches: Callable[[list], bool]
    run: Callable[[Context], None]
    text: str = ""


@dataclass
class Context:
    """Stack (last item on top), variables and frozen items of an execution."""

    interpreter: Interpreter
    stack: list[Any] = field(default_factory=list)
    variables: dict[str, Any] = field(default_factory=dict)
    frozen: list[Any] = field(default_factory=list)
    depth: int = 0

    def pop(self) -> Any:
        if not self.stack:
            raise ProgramError("stack underflow")
        return self.stack.pop()

    def push(self, item: Any) -> None:
        self.stack.append(item)
        if len(self.stack) > MAX_STACK:
            raise ProgramError(f"stack holds more than {MAX_STACK} items")

    def call(self, tokens: list[Any]) -> None:
        self.interpreter.execute(self, tokens)


class Interpreter:
    def __init__(self, vocabulary: list[Word]):
        self.words: dict[str, list[Word]] = {}
        for w in vocabulary:
            self.words.setdefault(w.name, []).append(w)
        self.words.setdefault("fcall", []).append(Word("fcall", lambda s: bool(s), lambda c: (c.call([":get"]), c.call([":call"]))))

    def register(self, name: str, body: str) -> None:
        """Add a word that stands for a program."""
        tokens = tokenize(body)
        self.words.setdefault(name, []).append(Word(name, lambda s: True, lambda c: c.call(tokens), body))

    def run(self, program: str, variables: dict[str, Any] | None = None) -> list[Any]:
        """The stack after a program, frozen items first."""
        c = Context(self, variables=dict(variables or {}))
        self.execute(c, tokenize(program))
        return [*c.frozen, *c.stack]

    def execute(self, c: Context, tokens: list[Any]) -> None:
        c.depth += 1
        if c.depth > MAX_DEPTH:
            raise ProgramError(f"calls are nested more than {MAX_DEPTH} deep")
        at = 0
        while at < len(tokens):
            t = tokens[at]
            at += 1
            if t == "(":
                depth, inner = 1, []
                while at < len(tokens):
                    x = tokens[at]
                    at += 1
                    depth += (x == "(") - (x == ")")
                    if not depth:
                        break
                    inner.append(x)
                if depth:
                    raise ProgramError("unmatched opening parenthesis")
                c.push(inner)
            elif t == ")":
                raise ProgramError("unmatched closing parenthesis")
            elif isinstance(t, str) and t.startswith(":") and len(t) > 1:
                self._word(c, t[1:])
            else:
                c.push(unescape(t) if isinstance(t, str) else t)
        c.depth -= 1

    def _word(self, c: Context, name: str) -> None:
        found = self.words.get(name)
        if not found:
            raise ProgramError(f"unknown word ':{name}'")
        for w in found:
            if w.matches(c.stack):
                w.run(c)
                return
        shown = ", ".join(str(x) for x in c.stack[-4:])
        raise ProgramError(f"no matches for word ':{name}' with stack [{shown}]")
