"""VBA module sources as rows: public Subs without parameters, with their lines. Nothing is executed.

A source is read as the language's grammar has it: characters make tokens (words, literals, signs, ends of statements), tokens make statements, and a
statement is judged by the words it begins with.
"""

from __future__ import annotations

from collections.abc import Iterator
from enum import Enum
from typing import NamedTuple

from pyspark.sql import DataFrame

from docengine.sources.archive import per_file

MACRO = "doc_id string, macro_name string, module_name string, source_line int, qualified_name string, error string"
MOST, LONGEST_NAME = 2_000_000, 255


class Kind(Enum):
    WORD = 1
    LITERAL = 2
    SIGN = 3
    END = 4


class Token(NamedTuple):
    kind: Kind
    text: str
    line: int

    def says(self, *words: str) -> bool:
        return self.kind is Kind.WORD and self.text.casefold() in words


class Reader:
    """Tokens of a source, one character after another."""

    def __init__(self, source: str):
        self.source, self.at, self.line = source.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n"), 0, 1

    def _word(self) -> str:
        end = self.at
        while end < len(self.source) and (self.source[end].isalnum() or self.source[end] == "_"):
            end += 1
        word, self.at = self.source[self.at : end], end
        return word

    def _continued(self) -> bool:
        """Whether an underscore joins this line and the next: blanks around it and nothing more. Steps over the joint."""
        if self.at and not self.source[self.at - 1].isspace():
            return False
        end = self.at + 1
        while end < len(self.source) and self.source[end] in " \t":
            end += 1
        if end < len(self.source) and self.source[end] != "\n":
            return False
        if end + 1 >= len(self.source):
            raise ValueError("a line goes on beyond the end of the source")
        self.at, self.line = end + 1, self.line + 1
        return True

    def _literal(self) -> str:
        """From a quotation mark to the next that isn't doubled, at most to the end of the line."""
        self.at += 1
        said = ""
        while self.at < len(self.source) and self.source[self.at] != "\n":
            c = self.source[self.at]
            self.at += 1
            if c == '"':
                if self.source[self.at : self.at + 1] != '"':
                    break
                self.at += 1
            said += c
        return said

    def _remark(self) -> None:
        """To the end of the line, and of those that it is joined with."""
        while self.at < len(self.source) and self.source[self.at] != "\n":
            if not (self.source[self.at] == "_" and self._continued()):
                self.at += 1

    def tokens(self) -> Iterator[Token]:
        begins = True  # a statement does, here
        while self.at < len(self.source):
            c, line = self.source[self.at], self.line
            if c in "\n:":
                self.at += 1
                self.line += c == "\n"
                begins = True
                yield Token(Kind.END, c, line)
            elif c.isspace():
                self.at += 1
            elif c == "'":
                self._remark()
            elif c == '"':
                begins = False
                yield Token(Kind.LITERAL, self._literal(), line)
            elif c.isalpha():
                word = self._word()
                if begins and word.casefold() == "rem":
                    self._remark()
                    continue
                begins = False
                yield Token(Kind.WORD, word, line)
            elif c != "_" or not self._continued():
                self.at += 1
                begins = False
                yield Token(Kind.SIGN, c, line)
        yield Token(Kind.END, "", self.line)


def statements(source: str) -> Iterator[list[Token]]:
    now: list[Token] = []
    for token in Reader(source).tokens():
        if token.kind is not Kind.END:
            now.append(token)
        elif now:
            yield now
            now = []


def is_name(text: str) -> bool:
    return text[:1].isalpha() and all(c.isalnum() or c == "_" for c in text) and len(text) <= LONGEST_NAME


def module_name(statement: list[Token]) -> str | None:
    """Of `Attribute VB_Name = "..."`, what the literal says."""
    match statement:
        case [a, b, Token(Kind.SIGN, "="), Token(Kind.LITERAL, said)] if a.says("attribute") and b.says("vb_name"):
            return said
    return None


def declared(statement: list[Token]) -> Token | None:
    """The name's token if this declares a Sub that others may call and that takes nothing."""
    rest = list(statement)
    if rest[0].says("private", "friend"):
        return None
    if rest[0].says("public"):
        del rest[0]
    if rest and rest[0].says("static"):
        del rest[0]
    match rest:
        case [sub, Token(Kind.WORD) as name] if sub.says("sub"):
            return name
        case [sub, Token(Kind.WORD) as name, Token(Kind.SIGN, "("), Token(Kind.SIGN, ")")] if sub.says("sub"):
            return name
    return None


def is_closed(statement: list[Token]) -> bool:
    """`Option Private Module`."""
    words = ("option", "private", "module")
    return len(statement) == len(words) and all(t.says(w) for t, w in zip(statement, words))


def macros(source: str) -> list[tuple[str, str, int, str]]:
    """(name, module, line, qualified name) of what can be called; a closed module offers nothing."""
    if len(source) > MOST or "\0" in source:
        raise ValueError("too large or not text")
    every = list(statements(source))
    modules = [m for m in map(module_name, every) if m is not None]
    if len(modules) > 1:
        raise ValueError("the module's name is given twice")
    if modules and not is_name(modules[0]):
        raise ValueError("the module's name is no name")
    if any(map(is_closed, every)):
        return []
    prefix = f"{modules[0]}." if modules else ""
    names: set[str] = set()
    out = []
    for statement in every:
        name = declared(statement)
        if name is None:
            continue
        if len(name.text) > LONGEST_NAME or name.text.casefold() in names:
            raise ValueError("a macro's name is too long or given twice")
        names.add(name.text.casefold())
        out.append((name.text, "".join(modules), statement[0].line, prefix + name.text))
    return out


def read_macros(files: DataFrame) -> DataFrame:
    def rows(name: str, content: bytes) -> Iterator[tuple]:
        if len(content) > MOST:
            raise ValueError("too large")
        for m in macros(content.decode("utf-8-sig")):
            yield (name, *m, None)

    return per_file(files, rows, MACRO)
