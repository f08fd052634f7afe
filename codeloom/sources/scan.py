"""Tokens of Go and JS/TS source text, with matched brackets: what the parsers work on."""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

SKIP = r"//[^\n]*|/\*.*?\*/"
STRING = r'"(?:\\.|[^"\\\n])*"|`(?:\\.|[^`\\])*`|\'(?:\\.|[^\'\\\n])*\''
RAW_STRING = r'"(?:\\.|[^"\\\n])*"|`[^`]*`|\'(?:\\.|[^\'\\\n])*\''
NAME = r"[^\W\d]\w*"
REST = NAME + r"|\d[\w.]*|\.\.\.|:=|=>|<-|\+\+|--|&&|\|\||[-+*/%&|^=!<>]=+|\S"
GO = re.compile(f"({SKIP})|({RAW_STRING})|({REST})", re.S)
#: A pattern literal: a slash after what can't end an operand.
PATTERN = r"(?:(?<=[(,=:!&|?])|(?<=[(,=:!&|?] ))/(?![/*])(?:\\.|\[(?:\\.|[^\]\n])*\]|[^/\\\n\[])+/[a-z]*"
JS = re.compile(f"({SKIP})|({STRING}|{PATTERN})|({REST.replace(NAME, r'(?:[^\W\d]|[$#])[\w$]*')})", re.S)
OPEN, CLOSE = "([{", ")]}"


class Token(NamedTuple):
    text: str
    line: int
    at: int
    string: bool


class Source:
    """tokens, and for each opening bracket's index its partner's (and back). Raises ValueError on unmatched brackets."""

    def __init__(self, text: str, grammar: re.Pattern):
        starts = [m.end() for m in re.finditer("\n", text)]
        self.text = text
        self.tokens = [Token(m[0], bisect_right(starts, m.start()) + 1, m.start(), m[2] is not None) for m in grammar.finditer(text) if m[1] is None]
        self.pair, waiting = {}, []
        for i, t in enumerate(self.tokens):
            if t.string:
                continue
            if t.text in OPEN:
                waiting.append(i)
            elif t.text in CLOSE:
                if not waiting or OPEN.index(self.tokens[waiting[-1]].text) != CLOSE.index(t.text):
                    raise ValueError(f"parse: unmatched {t.text} in line {t.line}")
                j = waiting.pop()
                self.pair[i], self.pair[j] = j, i
        if waiting:
            raise ValueError(f"parse: unmatched {self.tokens[waiting[-1]].text} in line {self.tokens[waiting[-1]].line}")

    def __len__(self) -> int:
        return len(self.tokens)

    def is_at(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.tokens) and not self.tokens[i].string and self.tokens[i].text in texts

    def word(self, i: int) -> str:
        """The identifier at i, or ''."""
        t = self.tokens[i] if 0 <= i < len(self.tokens) else None
        return t.text if t and not t.string and (t.text[0].isalpha() or t.text[0] in "_$#") else ""

    def after(self, i: int) -> int:
        """The index after token i, or after its partner if it opens a bracket."""
        return self.pair[i] + 1 if self.is_at(i, *OPEN) else i + 1

    def end_line(self, i: int) -> int:
        """The line on which token i ends."""
        return self.tokens[i].line + self.tokens[i].text.count("\n")

    def split(self, i: int, end: int, by: str = ",") -> list[tuple[int, int]]:
        """Ranges of tokens of [i, end) between separators outside brackets; empty ones left out."""
        out, start = [], i
        while i < end:
            if self.is_at(i, by):
                out.append((start, i))
                start = i + 1
            i = self.after(i)
        return [(a, b) for a, b in [*out, (start, end)] if a < b]
