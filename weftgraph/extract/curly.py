"""Tokens and statements of languages with braces: what Java and JavaScript have in common.

Expressions stay runs of tokens; they are only rendered, or read by patterns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<doc>/\*\*.*?\*/)|(?P<comment>/\*.*?\*/|//[^\n]*)|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)
    |(?P<number>0[xX][0-9a-fA-F_]+[lL]?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][-+]?\d+)?[fFdDlLn]?)|(?P<name>[#@]?[A-Za-z_$][\w$]*)
    |(?P<sign>>>>=|===|!==|\*\*=|\.\.\.|<<=|>>=|&&=|\|\|=|\?\?=|=>|->|::|\?\.|\+\+|--|&&|\|\||\?\?|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<|[-+*/%=<>!&|^~?:;,.(){}\[\]])""",
    re.S | re.X,
)
_CLOSE = {"(": ")", "[": "]", "{": "}"}
BINARY = {"==", "!=", "===", "!==", "<=", ">=", "&&", "||", "??", "+=", "-=", "*=", "/=", "%=", "=", "+", "-", "*", "/", "%", "<", ">", "&", "|", "^", "=>", "->", "?", ":", "**", "<<"}
WORDS = {"instanceof", "in", "of", "new", "return", "typeof", "delete", "void", "await", "throw", "case", "extends", "const", "let", "var", "final"}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    doc: str | None = None


def tokens(source: str, language: str) -> list[Token]:
    out, at, doc = [], 0, None
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise ValueError(f"Invalid {language} source: unexpected {source[at]!r}")
        at = m.end()
        if m.lastgroup == "doc":
            doc = m[0]
        elif m.lastgroup not in ("space", "comment"):
            out.append(Token(m.lastgroup, m[0], doc))
            doc = None
    stack = []
    for t in out:
        if t.kind == "sign" and t.text in _CLOSE:
            stack.append(_CLOSE[t.text])
        elif t.kind == "sign" and t.text in ")]}" and (not stack or stack.pop() != t.text):
            raise ValueError(f"Invalid {language} source: unexpected {t.text!r}")
    if stack:
        raise ValueError(f"Invalid {language} source: missing {stack[-1]!r}")
    return out


def rendered(run: list[Token]) -> str:
    """An expression as it is usually spaced."""
    out, prior = "", None
    for k, t in enumerate(run):
        unary = t.text in ("+", "-", "!", "~") and (prior is None or prior.text in BINARY or prior.text in ("(", "[", ",", "return", "!"))
        if t.text in BINARY and not unary and t.kind == "sign":
            out = out.rstrip(" ") + f" {t.text} "
        elif t.text == ",":
            out += ", "
        elif t.kind == "name" and prior is not None and prior.kind in ("name", "number", "string") or prior is not None and prior.text in WORDS and t.text not in (".", ")", ";", ","):
            out += (" " if out and not out.endswith(" ") else "") + t.text
        elif t.text in WORDS:
            out += (" " if out and out[-1] not in " (" else "") + t.text + " "
        else:
            out += t.text
        prior = t
        if unary and k + 1 < len(run):
            prior = Token("sign", "(")
    return " ".join(out.split())


class Cursor:
    def __init__(self, run: list[Token], language: str):
        self.run, self.at, self.language = run, 0, language

    def peek(self, ahead: int = 0) -> str:
        return self.run[self.at + ahead].text if self.at + ahead < len(self.run) else ""

    def kind(self, ahead: int = 0) -> str:
        return self.run[self.at + ahead].kind if self.at + ahead < len(self.run) else ""

    def take(self, text: str | None = None) -> Token:
        if self.at >= len(self.run) or text is not None and self.peek() != text:
            raise ValueError(f"Invalid {self.language} source: expected {text or 'more'}, found {self.peek()!r}")
        self.at += 1
        return self.run[self.at - 1]

    def has(self, *texts: str) -> bool:
        """Takes the next token if it is one of the texts."""
        if self.peek() in texts and self.kind() != "string":
            self.at += 1
            return True
        return False

    def group(self) -> list[Token]:
        """What stands between the next bracket and its match."""
        begin, depth = self.at + 1, 0
        while True:
            t = self.take()
            if t.kind == "sign":
                depth += (t.text in _CLOSE) - (t.text in (")", "]", "}"))
            if not depth:
                return self.run[begin : self.at - 1]

    def until(self, *stops: str) -> list[Token]:
        """Up to a stop at this depth, which stays."""
        begin = self.at
        while self.at < len(self.run) and not (self.kind() == "sign" and self.peek() in stops):
            if self.peek() in _CLOSE and self.kind() == "sign":
                self.group()
            else:
                self.at += 1
        return self.run[begin : self.at]


def split(run: list[Token], mark: str = ",", angles: bool = False) -> list[list[Token]]:
    """A run's parts between marks at its own depth."""
    out, depth = [[]], 0
    for t in run:
        if t.kind == "sign":
            depth += (t.text in _CLOSE) - (t.text in (")", "]", "}")) + (angles and t.text == "<") - (angles and t.text == ">")
        if t.kind == "sign" and t.text == mark and not depth:
            out.append([])
        else:
            out[-1].append(t)
    return [x for x in out if x]


class Statements:
    """Statements of a body as the tree that flows.py draws; subclasses know declarations and loops of their language."""

    question = "exception thrown?"
    typed_catch = True

    def __init__(self, language: str):
        self.language = language

    def body(self, run: list[Token]) -> list[tuple]:
        c, out = Cursor(run, self.language), []
        while c.at < len(run):
            out += self.statement(c)
        return out

    def block(self, c: Cursor) -> list[tuple]:
        return self.body(c.group()) if c.peek() == "{" else self.statement(c)

    def statement(self, c: Cursor) -> list[tuple]:
        word = c.peek() if c.kind() in ("name", "sign") else ""
        if c.has(";"):
            return []
        if word == "{":
            return [("scope", None, self.body(c.group()))]
        if word in ("if", "while", "do", "for", "try", "return", "throw", "switch", "synchronized"):
            c.take()
            return [getattr(self, f"on_{word}")(c)]
        if word in ("break", "continue"):
            c.take()
            c.until(";")
            c.has(";")
            return [("do", word)]
        if word in ("function", "class"):
            c.until("{")
            c.group()
            return [("do", f"{word}declaration")]
        run = c.until(";", "}")
        c.has(";")
        return [("do", self.simple(run))]

    def simple(self, run: list[Token]) -> str:
        return rendered(run)

    def on_if(self, c: Cursor) -> tuple:
        condition = rendered(c.group())
        then = self.block(c)
        return "if", condition, then, self.block(c) if c.has("else") else None

    def on_while(self, c: Cursor) -> tuple:
        return "loop", rendered(c.group()), self.block(c)

    def on_do(self, c: Cursor) -> tuple:
        body = self.block(c)
        c.take("while")
        condition = rendered(c.group())
        c.has(";")
        return "loop", condition, body

    def on_for(self, c: Cursor) -> tuple:
        c.has("await")
        return "loop", self.for_label(c.group()), self.block(c)

    def for_label(self, head: list[Token]) -> str:
        raise NotImplementedError

    def on_try(self, c: Cursor) -> tuple:
        opened = bool(c.group()) if c.peek() == "(" else False
        body, handlers, last = self.body(c.group()), [], []
        while c.has("catch"):
            names = [t.text for t in c.group() if t.kind == "name" and t.text != "final"] if c.peek() == "(" else []
            handlers.append((" | ".join(names[:-1]) if self.typed_catch else None, self.body(c.group())))
        if c.has("finally"):
            last = self.body(c.group())
        made = ("try", body, handlers, [], last, "catch", self.question)
        return ("scope", "open resources", [made]) if opened else made

    def _exit(self, c: Cursor, word: str) -> tuple:
        run = c.until(";", "}")
        c.has(";")
        return "exit", f"{word} {rendered(run)}".strip()

    def on_return(self, c: Cursor) -> tuple:
        return self._exit(c, "return")

    def on_throw(self, c: Cursor) -> tuple:
        return self._exit(c, "throw")

    def on_switch(self, c: Cursor) -> tuple:
        c.group()
        c.group()
        return "do", "switch"

    def on_synchronized(self, c: Cursor) -> tuple:
        c.group()
        c.group()
        return "do", "synchronized"
