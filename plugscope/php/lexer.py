"""A PHP lexer: tokens with offsets, comment blanking, matching brackets, argument lists."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""(?P<comment>/\*.*?\*/|//[^\n]*?(?=\?>|\n|\Z)|\#(?!\[)[^\n]*?(?=\?>|\n|\Z))
    |(?P<heredoc><<<[ \t]*(?P<q>['"]?)(?P<tag>[A-Za-z_]\w*)(?P=q)\r?\n.*?\n?[ \t]*(?P=tag)\b)
    |(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")
    |(?P<var>\$[A-Za-z_]\w*)
    |(?P<name>\\?[A-Za-z_]\w*(?:\\[A-Za-z_]\w*)*)
    |(?P<number>\d[\w.]*)
    |(?P<close>\?>)
    |(?P<op>=>|\?->|->|::|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\.=|\.\.\.|[^\s])""",
    re.S | re.X,
)
_OPEN_TAG = re.compile(r"<\?(?:php\b|=)?", re.I)
_COMMENT = re.compile(r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|/\*.*?\*/|//[^\n]*|\#[^\n]*""", re.S)
_PAIRS = {"(": ")", "[": "]", "{": "}"}


def strip_comments(text: str) -> str:
    """Blank comments to spaces, keeping newlines and length; an open ``/*`` stays, strings are left alone."""
    return _COMMENT.sub(lambda m: m[0] if m[1] else re.sub(r"[^\n]", " ", m[0]), text)


def collapse(code: str, most: int = 500) -> str:
    """White space runs as single spaces, cut to ``most`` bytes with a mark."""
    flat = " ".join(code.split())
    data = flat.encode("utf-8", "replace")
    return flat if len(data) <= most else data[:most].decode("utf-8", "ignore") + "..."


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    end: int


class Source:
    """Tokens of a file's PHP parts, without comments, and their matching brackets."""

    def __init__(self, text: str):
        self.text = text
        self.tokens = list(_tokens(text))
        self.lines = [m.start() for m in re.finditer("\n", text)]
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind == "op":
                if t.text in _PAIRS:
                    stack.append(i)
                elif t.text in ")]}":
                    while stack and _PAIRS[self.tokens[stack[-1]].text] != t.text:
                        stack.pop()  # malformed code: drop what cannot match
                    if stack:
                        o = stack.pop()
                        self.match[o], self.match[i] = i, o

    def line(self, offset: int) -> int:
        return bisect_right(self.lines, offset - 1) + 1 if offset else 1

    def close(self, i: int) -> int:
        """The token that closes bracket ``i``, or the last one."""
        return self.match.get(i, len(self.tokens) - 1)

    def span(self, first: int, last: int) -> str:
        """Source text of tokens first..last-1."""
        return self.text[self.tokens[first].start : self.tokens[last - 1].end] if first < last else ""

    def split(self, first: int, last: int, by: str = ",") -> list[tuple[int, int]]:
        """Token ranges between top-level ``by`` in first..last-1, without a trailing empty one."""
        out, start, i = [], first, first
        while i < last:
            t = self.tokens[i]
            if t.kind == "op" and t.text in _PAIRS and i in self.match and self.match[i] < last:
                i = self.match[i]
            elif t.kind == "op" and t.text == by:
                out.append((start, i))
                start = i + 1
            i += 1
        if start < last:
            out.append((start, last))
        return out


def _tokens(text: str):
    at, end = 0, len(text)
    inside = _OPEN_TAG.search(text) is None  # a fragment without tags is code
    while at < end:
        if not inside:
            m = _OPEN_TAG.search(text, at)
            if not m:
                return
            at, inside = m.end(), True
            continue
        m = _TOKEN.search(text, at)
        if not m:
            return
        at = m.end()
        kind = m.lastgroup if m.lastgroup not in ("q", "tag") else "heredoc"
        if m["heredoc"] is not None:
            kind = "heredoc"
        if kind == "close":
            inside = False
            yield Token("op", ";", m.start(), m.end())
        elif kind != "comment":
            yield Token(kind, m[0], m.start(), m.end())


def unquote(literal: str) -> str:
    """Value of a string literal, interpolation left as it is."""
    if literal[:1] == "'":
        return re.sub(r"\\([\\'])", r"\1", literal[1:-1])
    if literal[:1] == '"':
        return re.sub(r'\\([\\"$])', r"\1", literal[1:-1])
    return literal
