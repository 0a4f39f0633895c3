"""One lexer for the three languages: identifiers, literals, operators; comments apart. Columns count characters."""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple


class Tok(NamedTuple):
    kind: str  # id, num, str, char, op
    text: str
    line: int
    col: int
    end_line: int
    end_col: int
    at: int


_IDENT = re.compile(r"(?:[^\W\d]|\$)[\w$]*|`[^`\n]+`")
#: Where a comment, a string or a quoted name begins; no other token holds any of these.
_MARK = re.compile(r"//|/\*|[\"']|`[^`\n]+`")
_NUM = re.compile(r"0[xX][0-9a-fA-F_]+[lL]?|0[bB][01_]+[lL]?|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?[lLfFdDgG]?")
_OP = re.compile(r"->|::|\?\.|\?:|!!|\.\.\.|\.\.|===|!==|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|=>|.", re.S)


class Source:
    """Tokens, comment and string spans, and what is unterminated."""

    def __init__(self, text: str, language: str) -> None:
        self.text, self.language = text, language
        self.tokens: list[Tok] = []
        self.comments: list[Tok] = []
        self.errors: list[tuple[Tok, str]] = []
        self._starts = [0] + [m.end() for m in re.finditer("\n", text)]
        self._scan()

    def place(self, at: int) -> tuple[int, int]:
        line = bisect_right(self._starts, at) - 1
        return line, at - self._starts[line]

    def _tok(self, kind: str, a: int, b: int) -> Tok:
        return Tok(kind, self.text[a:b], *self.place(a), *self.place(b), a)

    def _scan(self) -> None:
        text, n, i = self.text, len(self.text), 0
        groovy = self.language == "groovy"
        while i < n:
            ch = text[i]
            if ch.isspace():
                i += 1
                continue
            if (after := self._comment(i)) is not None:
                i = after
                continue
            if ch in "\"'":
                i = self._string(i, groovy)
                continue
            m = _IDENT.match(text, i)
            if m:
                self.tokens.append(self._tok("id", i, m.end()))
                i = m.end()
                continue
            m = _NUM.match(text, i)
            if m:
                self.tokens.append(self._tok("num", i, m.end()))
                i = m.end()
                continue
            m = _OP.match(text, i)
            self.tokens.append(self._tok("op", i, m.end()))
            i = m.end()

    def _comment(self, i: int) -> int | None:
        """Where the comment that begins here ends, if one does."""
        text, n = self.text, len(self.text)
        if text.startswith("//", i) or (i == 0 and text.startswith("#!")):
            end = text.find("\n", i)
            end = n if end < 0 else end
        elif text.startswith("/*", i):
            end, depth, at = -1, 1, i + 2
            while depth:  # only Kotlin's comments nest
                close = text.find("*/", at)
                if close < 0:
                    break
                inner = text.find("/*", at, close) if self.language == "kotlin" else -1
                if inner >= 0:
                    depth, at = depth + 1, inner + 2
                else:
                    depth, at, end = depth - 1, close + 2, close + 2
            if depth:
                end = n
                self.errors.append((self._tok("comment", i, n), "unterminated comment"))
        else:
            return None
        self.comments.append(self._tok("comment", i, end))
        return end

    def _string(self, i: int, groovy: bool) -> int:
        text, n, q = self.text, len(self.text), self.text[i]
        triple = text.startswith(q * 3, i)
        j = i + (3 if triple else 1)
        while j < n:
            if text[j] == "\\" and not (triple and self.language == "kotlin"):
                j += 2
            elif triple and text.startswith(q * 3, j):
                j += 3
                break
            elif not triple and text[j] == q:
                j += 1
                break
            elif not triple and text[j] == "\n":
                self.errors.append((self._tok("str", i, j), "unterminated string"))
                break
            elif text.startswith("${", j) and q == '"' and self.language != "java":
                depth, j = 1, j + 2
                while j < n and depth:
                    depth += {"{": 1, "}": -1}.get(text[j], 0)
                    j += 1
            else:
                j += 1
        else:
            self.errors.append((self._tok("str", i, n), "unterminated string"))
        j = min(j, n)
        self.tokens.append(self._tok("str" if q == '"' or groovy or triple else "char", i, j))
        return j


class Outline(Source):
    """Comments, strings and characters alone: what stands between them is passed over in one step."""

    def _scan(self) -> None:
        i = self._comment(0) or 0
        while m := _MARK.search(self.text, i):
            i = m.start()
            if m[0] in ("//", "/*"):
                i = self._comment(i)
            else:
                i = self._string(i, self.language == "groovy") if m[0] in ("'", '"') else m.end()

    def spans(self) -> list[tuple[int, int, str]]:
        """First and last offset (the latter excluded) and kind of each."""
        found = [(t.at, t.at + len(t.text), kind) for kind, ts in (("comment", self.comments), ("string", self.tokens)) for t in ts]
        return sorted(found)


def brackets(tokens: list[Tok]) -> tuple[dict[int, int], list[Tok]]:
    """Index of the closing bracket for each opening one, and the brackets without a partner."""
    pairs, stack, lost = {}, [], []
    close = {")": "(", "]": "[", "}": "{"}
    for i, t in enumerate(tokens):
        if t.kind != "op":
            continue
        if t.text in "([{":
            stack.append(i)
        elif t.text in close:
            if stack and tokens[stack[-1]].text == close[t.text]:
                pairs[stack.pop()] = i
            elif any(tokens[k].text == close[t.text] for k in stack):
                while tokens[stack[-1]].text != close[t.text]:
                    lost.append(tokens[stack.pop()])
                pairs[stack.pop()] = i
            else:
                lost.append(t)
    return pairs, lost + [tokens[k] for k in stack]
