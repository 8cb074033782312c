"""Tokens of PHP and TypeScript sources, with byte spans."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True, slots=True)
class Token:
    kind: str  # name, var, string, number, op, doc
    text: str
    start: int
    end: int


class LexError(ValueError):
    def __init__(self, message: str, at: int) -> None:
        super().__init__(message)
        self.at = at


_NAME = r"[A-Za-z_\x80-\U0010FFFF][A-Za-z0-9_\x80-\U0010FFFF]*"
_PHP = re.compile(
    rf"""(?P<doc>/\*\*(?!/).*?\*/)|(?P<comment>/\*.*?\*/|(?://|\#(?!\[))[^\n]*?(?=\?>|\n|\Z))|(?P<close>\?>\n?)
    |(?P<heredoc><<<[ \t]*(?P<q>["']?)(?P<tag>{_NAME})(?P=q)\n.*?^[ \t]*(?P=tag)\b)
    |(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`(?:[^`\\]|\\.)*`)|(?P<var>\${_NAME})|(?P<name>\\?{_NAME}(?:\\{_NAME})*)
    |(?P<number>0[xX][0-9a-fA-F_]+|[0-9][0-9_]*(?:\.[0-9_]*)?(?:[eE][+-]?[0-9]+)?|\.[0-9][0-9_]*)
    |(?P<op>\?->|->|=>|::|\.\.\.|<=>|===|!==|\*\*=|<<=|>>=|\?\?=|\?\?|&&|\|\||[-+*/.%&|^]=|==|!=|<>|<=|>=|<<|>>|\+\+|--|\*\*|\#\[|[-+*/%=<>!.,;:?@&|^~$(){{}}\[\]\\])|(?P<space>\s+)""",
    re.X | re.S | re.M,
)
_TS_NAME = r"\#?[A-Za-z_$\x80-\U0010FFFF][A-Za-z0-9_$\x80-\U0010FFFF]*"
_TS = re.compile(
    rf"""(?P<doc>/\*\*(?!/).*?\*/)|(?P<comment>/\*.*?\*/|//[^\n]*|\A\#![^\n]*)|(?P<string>'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*")|(?P<name>{_TS_NAME})
    |(?P<number>0[xXbBoO][0-9a-fA-F_]+n?|[0-9][0-9_]*(?:\.[0-9_]*)?(?:[eE][+-]?[0-9]+)?n?|\.[0-9][0-9_]*)
    |(?P<op>=>|\?\.(?![0-9])|\.\.\.|>>>=|===|!==|\*\*=|<<=|>>=|\?\?=|&&=|\|\|=|\?\?|&&|\|\||[-+*/%&|^]=|==|!=|<=|>=|\+\+|--|\*\*|[-+*/%=<>!.,;:?@&|^~(){{}}\[\]])|(?P<space>\s+)""",
    re.X | re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
#: After these a slash starts a regular expression. Fixed values.
_BEFORE_REGEX = {"(", ",", "=", ":", "[", "!", "&", "|", "?", "{", "}", ";", "=>", "&&", "||", "??", "return", "typeof", "case", "+", "-", "in", "of"}


class _Bytes:
    """Byte offsets of code points."""

    def __init__(self, text: str) -> None:
        self.plain = text.isascii()
        if not self.plain:
            at, self.at = 0, []
            for c in text:
                self.at.append(at)
                at += len(c.encode())
            self.at.append(at)

    def __call__(self, k: int) -> int:
        return k if self.plain else self.at[k]


def _run(pattern: re.Pattern, text: str, at: int, end: int, of: _Bytes, out: list[Token], php: bool) -> int:
    """Appends tokens from at; returns where it stopped (behind ?> in PHP)."""
    while at < end:
        if not php and text[at] == "/" and not text.startswith(("//", "/*"), at) and (not out or out[-1].text in _BEFORE_REGEX) and (m := _REGEX.match(text, at)):
            out.append(Token("string", m[0], of(at), of(m.end())))
            at = m.end()
            continue
        if not php and text[at] == "`":
            at = _template(text, at, end, of, out)
            continue
        m = pattern.match(text, at, end)
        if m is None:
            raise LexError(f"unexpected {text[at]!r}", of(at))
        kind = m.lastgroup if m.lastgroup not in ("q", "tag") else "heredoc"
        if m["heredoc"] if php else False:
            kind = "string"
        if kind == "close":
            return m.end()
        if kind not in ("comment", "space"):
            out.append(Token(kind, m[0], of(at), of(m.end())))
        at = m.end()
    return at


def _template(text: str, at: int, end: int, of: _Bytes, out: list[Token]) -> int:
    """A template string; the expressions in it are code."""
    start, k = at, at + 1
    while k < end:
        if text[k] == "\\":
            k += 2
        elif text[k] == "`":
            out.append(Token("string", text[start : k + 1], of(start), of(k + 1)))
            return k + 1
        elif text.startswith("${", k):
            depth, inner = 1, k + 2
            while inner < end and depth:
                depth += (text[inner] == "{") - (text[inner] == "}")
                inner += 1
            out.append(Token("op", "(", of(k), of(k + 1)))
            _run(_TS, text, k + 2, inner - 1, of, out, False)
            out.append(Token("op", ")", of(inner - 1), of(inner)))
            k = inner
        else:
            k += 1
    raise LexError("the template string doesn't end", of(start))


def tokens(language: str, text: str) -> list[Token]:
    of, out = _Bytes(text), []
    if language != "php":
        _run(_TS, text, 0, len(text), of, out, False)
        return out
    at = 0
    while (opened := re.compile(r"<\?(?:php\b|=)").search(text, at)) is not None:
        if out:
            out.append(Token("op", ";", of(opened.start()), of(opened.start())))
        at = _run(_PHP, text, opened.end(), len(text), of, out, True)
    return out
