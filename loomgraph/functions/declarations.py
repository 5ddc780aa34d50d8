"""Declarations of a source text with what encloses them: one pass, one stack of open scopes.

Strings and comments are blanked first, so that what stands in them declares nothing and closes nothing. The text is read statement by statement; a statement ends at a
line's end, a semicolon or a brace, so that several declarations may share a line. A rule tells from a statement's beginning whether it declares. Scopes close with their brace,
with their `end`, or, in Python, with a line of no greater indentation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

_QUOTED = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''
_C = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
#: What is blanked, by language; others are as the first.
BLANKS = {
    "": rf"{_C}|`(?:\\.|[^`\\])*`|{_QUOTED}",
    "python": rf'#[^\n]*|""".*?(?:"""|\Z)|\'\'\'.*?(?:\'\'\'|\Z)|{_QUOTED}',
    "ruby": rf"#[^\n]*|^=begin.*?^=end|{_QUOTED}",
    "php": rf"{_C}|#(?!\[)[^\n]*|{_QUOTED}",
    "rust": rf'{_C}|"(?:\\.|[^"\\])*"|\'(?:\\.[^\']*|[^\'\\\n])\'',
}
#: Statements that open a scope which only `end` closes, and modifiers that open none at a statement's end.
_RUBY_OPENS = re.compile(r"\s*(?:def|class|module|if|unless|while|until|case|begin|for)\b|.*\bdo\b(?:\s*\|[^|]*\|)?\s*$", re.S)
_ENDLESS_DEF = re.compile(r"\s*def\s+[\w.?!]+\s*(?:\([^)]*\))?\s*=[^=]")


class Declaration(NamedTuple):
    """Lines count from 1; parent: the name of the nearest enclosing declaration; depth: how many enclose it."""

    name: str
    kind: str
    signature: str
    start_line: int
    end_line: int
    parent: str | None
    depth: int


@lru_cache(64)
def _blank(language: str) -> re.Pattern:
    return re.compile(BLANKS.get(language, BLANKS[""]), re.S | re.M)


def blanked(text: str, language: str) -> str:
    """The text with the insides of strings and comments as spaces; lines and places stay."""

    def spaces(m: re.Match) -> str:
        return m[0] if m[0][0] in "\"'" and len(m[0]) == 2 else re.sub(r"[^\n]", " ", m[0])

    return _blank(language).sub(spaces, text)


def _statements(text: str) -> Iterator[tuple[int, int, str]]:
    """(begin, end, what ends it) of each statement; a brace, semicolon or line's end, or nothing at the text's end."""
    at = 0
    for m in re.finditer(r"[{};\n]", text):
        yield at, m.start(), m[0]
        at = m.end()
    yield at, len(text), ""


class _Open:
    __slots__ = ("found", "level")

    def __init__(self, found: int | None, level: int):
        self.found, self.level = found, level


def declarations(text: str, language: str, rules: Sequence[tuple[str, re.Pattern]]) -> list[Declaration]:
    """rules: (kind, pattern) in order; a pattern's first group is the name, and it is matched at a statement's beginning."""
    masked = blanked(text, language)
    found: list[list] = []  # name, kind, signature, start, end, parent, depth
    stack: list[_Open] = []
    by_indent, by_end = language == "python", language == "ruby"
    waiting: int | None = None  # a declaration whose brace may stand on a later line
    line, begin_of_line, last_line = 1, 0, 1

    def close(to: int) -> None:
        o = stack.pop()
        if o.found is not None:
            found[o.found][4] = max(found[o.found][3], to)

    def add(statement: str, at: int, end: int) -> int | None:
        for kind, pattern in rules:
            if m := pattern.match(statement):
                owner = next((found[o.found][0] for o in reversed(stack) if o.found is not None), None)
                depth = sum(o.found is not None for o in stack)
                found.append([m[1], kind, text[at:end].strip(), line, line, owner, depth])
                return len(found) - 1
        return None

    for begin, end, stop in _statements(masked):
        statement = masked[begin:end]
        if statement.strip():
            if by_indent and not masked[begin_of_line:begin].strip():
                indent = len(statement) - len(statement.lstrip())
                while stack and indent <= stack[-1].level:
                    close(last_line)
                new = add(statement, begin, end)
                if new is not None:
                    stack.append(_Open(new, indent))
            elif by_end:
                word = statement.split()[0].rstrip(".)]},")
                if word == "end" and stack:
                    close(line)
                else:
                    new = add(statement, begin, end)
                    if _RUBY_OPENS.match(statement) and not _ENDLESS_DEF.match(statement):
                        stack.append(_Open(new, 0))
            elif not by_indent:
                new = add(statement, begin, end)
                if new is not None:
                    waiting = new
                elif stop != "{" or statement.lstrip()[:1] not in "({[:=<-w":  # where, ->, : and the like go on with what waits
                    waiting = None
            last_line = line
        if not (by_indent or by_end):
            if stop == "{":
                stack.append(_Open(waiting, 0))
                waiting = None
            elif stop == "}":
                if stack:
                    close(line)
                waiting = None
            elif stop == ";":
                waiting = None
        if stop == "\n":
            line += 1
            begin_of_line = end + 1
    while stack:
        close(last_line)
    return [Declaration(*f) for f in found]
