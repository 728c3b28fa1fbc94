"""Tokens of languages with C-like comments, and their bracket structure.

Enough to read imports, calls and annotations without a parser: comments vanish, strings are one token, brackets are
paired. A template with inserted expressions is one token, too; calls inside of it aren't seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

PAIRS = {")": "(", "]": "[", "}": "{"}
#: A slash behind one of these begins a regular expression.
BEFORE_REGEX = {"(", ",", "=", ":", "[", "!", "&", "|", "?", "{", "}", ";", "=>", "return", "typeof"}
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
OPEN_OR_CLOSE = re.compile(r"/\*|\*/")
INSERT = re.compile(r"\\.|`|\$\{", re.S)
BRACE = re.compile(r"[{}`]")


class Token(NamedTuple):
    kind: str  # name, string, raw, char, template, number, sign
    text: str
    line: int


class Language:
    def __init__(self, strings: str, nested: bool = False, templates: bool = False):
        """strings: alternatives of a pattern, named by their kinds. nested: block comments nest."""
        self.nested, self.templates = nested, templates
        self.pattern = re.compile(rf"(?P<space>\s+|//[^\n]*)|(?P<comment>/\*)|{strings}|(?P<name>[^\W\d][\w$]*|[$#][\w$]+)|(?P<number>\d[\w.]*)|(?P<sign>::|=>|\?\.|\.\.\.|.)", re.S)

    def tokens(self, text: str) -> Iterator[Token]:
        at, line, before = 0, 1, "("
        while at < len(text):
            m = self.pattern.match(text, at)
            kind, end = m.lastgroup, m.end()
            if kind == "comment":
                end = self.comment_end(text, end)
            elif self.templates and m[0] == "`":
                kind, end = "template", template_end(text, end)
            elif self.templates and m[0] == "/" and before in BEFORE_REGEX and (literal := REGEX.match(text, at)):
                kind, end = "regex", literal.end()
            if kind not in ("space", "comment"):
                before = text[at:end]
                yield Token(kind, before, line)
            line += text.count("\n", at, end)
            at = end

    def comment_end(self, text: str, at: int) -> int:
        depth = 1
        for m in OPEN_OR_CLOSE.finditer(text, at):
            if m[0] == "*/":
                depth -= 1
            elif self.nested:
                depth += 1
            if not depth:
                return m.end()
        return len(text)


def template_end(text: str, at: int) -> int:
    """Behind the template whose inside begins at a place."""
    while m := INSERT.search(text, at):
        at = m.end()
        if m[0] == "`":
            return at
        if m[0] == "${":
            at = insert_end(text, at)
    return len(text)


def insert_end(text: str, at: int) -> int:
    depth = 1
    while m := BRACE.search(text, at):
        at = m.end()
        if m[0] == "`":
            at = template_end(text, at)
        else:
            depth += 1 if m[0] == "{" else -1
            if not depth:
                return at
    return len(text)


class Source:
    """A file's tokens. ends pairs openings with closings, starts the reverse; depth counts the brackets around a token."""

    def __init__(self, text: str, language: Language):
        self.tokens = [*language.tokens(text)]
        self.ends: dict[int, int] = {}
        self.starts: dict[int, int] = {}
        self.depth: list[int] = []
        self.balanced = True
        stack: list[int] = []
        for k, t in enumerate(self.tokens):
            if t.kind == "sign" and t.text in PAIRS:
                if stack and self.tokens[stack[-1]].text == PAIRS[t.text]:
                    self.starts[k] = stack.pop()
                    self.ends[self.starts[k]] = k
                else:
                    self.balanced = False
            self.depth.append(len(stack))
            if t.kind == "sign" and t.text in PAIRS.values():
                stack.append(k)
        self.balanced &= not stack

    def text(self, k: int) -> str:
        """A token's text if it isn't a literal; nothing outside of the file."""
        return self.tokens[k].text if 0 <= k < len(self.tokens) and self.tokens[k].kind in ("name", "sign") else ""

    def kind(self, k: int) -> str:
        return self.tokens[k].kind if 0 <= k < len(self.tokens) else ""

    def joined(self, i: int, j: int) -> str:
        return "".join(t.text for t in self.tokens[i:j])

    def parts(self, opening: int) -> list[tuple[int, int]]:
        """The ranges between the commas of a bracket; a closing comma adds none."""
        end = self.ends.get(opening)
        out, begin, k = [], opening + 1, opening + 1
        while end is not None and k <= end:
            if k == end or self.text(k) == ",":
                if k > begin:
                    out.append((begin, k))
                begin = k + 1
            k = self.ends.get(k, k) + 1
        return out

    def calls(self) -> Iterator[tuple[int, int]]:
        """(last name of what is called, opening bracket)."""
        for k in self.ends:
            if self.text(k) == "(" and self.kind(k - 1) == "name":
                yield k - 1, k

    def chain_start(self, k: int) -> int:
        """The first token of the chain of selectors and calls that ends with a name."""
        while self.text(k - 1) in (".", "?."):
            k -= 2
            while k in self.starts:
                k = self.starts[k] - 1
        return max(k, 0)

    def literal(self, part: tuple[int, int], kinds: tuple[str, ...] = ("string",)) -> str | None:
        """The text of a range that is one literal."""
        i, j = part
        return self.tokens[i].text if j == i + 1 and self.tokens[i].kind in kinds else None

    def first_string(self, opening: int) -> str:
        """The first string inside of a bracket, without its quotes."""
        return next((t.text.strip('"') for t in self.tokens[opening : self.ends.get(opening, opening)] if t.kind == "string"), "")
