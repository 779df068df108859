"""Tokens of PHP source text.

A token is (kind, text, line).  Kinds: 'html', 'var', 'name', 'int', 'float', 'str' (a text without
interpolation), 'tpl' (one with: its text is a list of parts, each a string or a list of tokens),
'cast', 'op', 'doc' (a doc comment, kept for the declaration after it), 'comment', 'end'.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class SyntaxProblem(Exception):
    """The text is not valid PHP as far as this reader knows."""


class Token(NamedTuple):
    kind: str
    text: object
    line: int


NAME = re.compile(r"\\?[A-Za-z_\x80-\U0010ffff][A-Za-z0-9_\x80-\U0010ffff]*(?:\\[A-Za-z_\x80-\U0010ffff][A-Za-z0-9_\x80-\U0010ffff]*)*")
VARIABLE = re.compile(r"\$[A-Za-z_\x80-\U0010ffff][A-Za-z0-9_\x80-\U0010ffff]*")
FLOAT = re.compile(r"(?:[0-9][0-9_]*)?\.[0-9][0-9_]*(?:[eE][+-]?[0-9_]+)?|[0-9][0-9_]*\.(?:[eE][+-]?[0-9_]+)?(?![.0-9A-Za-z_])|[0-9][0-9_]*[eE][+-]?[0-9_]+")
INTEGER = re.compile(r"0[xX][0-9A-Fa-f_]+|0[bB][01_]+|0[oO][0-7_]+|[0-9][0-9_]*")
CAST = re.compile(r"\([ \t]*(?:int|integer|float|double|real|string|binary|bool|boolean|array|object|unset)[ \t]*\)", re.I)
SPACE = re.compile(r"[ \t\r\n\f\v]+")
HEREDOC = re.compile(r"<<<[ \t]*(?:\"([A-Za-z_]\w*)\"|'([A-Za-z_]\w*)'|([A-Za-z_]\w*))\r?\n")
OPS = sorted(
    "<<<= **= ... <=> === !== <<= >>= ??= ?-> && || ?? ++ -- += -= *= /= .= %= &= |= ^= -> => :: == != <> <= >= << >> ** |> + - * / % = < > ! . ( ) [ ] { } , ; ? : & | ^ ~ @ $ # \\".split(),
    key=len, reverse=True,
)
OPERATOR = re.compile("|".join(map(re.escape, OPS)))


def tokens(source: str) -> list[Token]:
    out: list[Token] = []
    at, line = 0, 1
    while at < len(source):
        begin = _open_tag(source, at)
        html = source[at : begin[0]]
        if html:
            out.append(Token("html", html, line))
            line += html.count("\n")
        if begin[0] == len(source):
            break
        line += source.count("\n", begin[0], begin[1])
        at, line = _code(source, begin[1], line, out, None)
        if begin[2]:  # <?= echoes what follows
            out.append(Token("op", ";", line))
    out.append(Token("end", "", line))
    return out


def _open_tag(s: str, at: int) -> tuple[int, int, bool]:
    m = re.compile(r"<\?(?:php(?:[ \t]|\r?\n|$)|=)", re.I).search(s, at)
    return (m.start(), m.end(), m[0] == "<?=") if m else (len(s), len(s), False)


def _code(s: str, at: int, line: int, out: list[Token], closing: str | None) -> tuple[int, int]:
    """Read code up to a closing tag, or, for ``closing``, to the brace that ends an interpolation."""
    depth = 0
    while at < len(s):
        c = s[at]
        if m := SPACE.match(s, at):
            line += m[0].count("\n")
            at = m.end()
            continue
        if s.startswith("?>", at):
            out.append(Token("op", ";", line))
            at += 2
            if s.startswith("\n", at):
                at, line = at + 1, line + 1
            elif s.startswith("\r\n", at):
                at, line = at + 2, line + 1
            return at, line
        if s.startswith("#[", at):
            out.append(Token("op", "#[", line))
            at += 2
            continue
        if c == "#" or s.startswith("//", at):
            m = re.compile(r"\r?\n|\?>").search(s, at)
            end = m.start() if m else len(s)
            out.append(Token("comment", s[at:end], line))
            at = end
            continue
        if s.startswith("/*", at):
            end = s.find("*/", at + 2)
            if end < 0:
                raise SyntaxProblem(f"Unterminated comment starting line {line}")
            text = s[at : end + 2]
            out.append(Token("doc" if text.startswith("/**") and text[3:4].isspace() else "comment", text, line))
            line += text.count("\n")
            at = end + 2
            continue
        if c == "'":
            at, line = _single(s, at, line, out)
            continue
        if c in "\"`":
            at, line = _double(s, at, line, out, c)
            continue
        if m := HEREDOC.match(s, at):
            at, line = _heredoc(s, m, line, out)
            continue
        if m := VARIABLE.match(s, at):
            out.append(Token("var", m[0][1:], line))
            at = m.end()
            continue
        if m := NAME.match(s, at):
            if m[0] in ("b", "B") and s[m.end() : m.end() + 1] in ("'", '"'):  # a prefix of binary texts
                at = m.end()
                continue
            out.append(Token("name", m[0], line))
            at = m.end()
            if m[0] == "__halt_compiler":
                return len(s), line
            continue
        for kind, pattern in (("float", FLOAT), ("int", INTEGER), ("cast", CAST), ("op", OPERATOR)):
            if m := pattern.match(s, at):
                text = m[0]
                if kind == "op" and closing:
                    depth += (text == "{") - (text == "}")
                    if depth < 0:
                        return m.end(), line
                out.append(Token(kind, text, line))
                at = m.end()
                break
        else:
            raise SyntaxProblem(f"Unexpected character {c!r} on line {line}")
    if closing:
        raise SyntaxProblem(f"Unterminated interpolation on line {line}")
    return at, line


def _single(s: str, at: int, line: int, out: list[Token]) -> tuple[int, int]:
    m = re.compile(r"'((?:[^'\\]|\\.)*)'", re.S).match(s, at)
    if not m:
        raise SyntaxProblem(f"Unterminated text starting line {line}")
    out.append(Token("str", re.sub(r"\\([\\'])", r"\1", m[1]), line))
    return m.end(), line + m[0].count("\n")


_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "v": "\v", "e": "\x1b", "f": "\f", "\\": "\\", "$": "$", '"': '"', "`": "`"}


def _unescape(text: str, quote: str) -> str:
    def one(m: re.Match) -> str:
        x = m[0]
        if x[1] == "u":
            return chr(min(int(m["u"], 16), 0x10FFFF))
        if x[1] == "x":
            return chr(int(m["x"], 16))
        if m["o"]:
            return chr(int(m["o"], 8) & 255)
        return x if x[1] in "\"`" and x[1] != quote else _ESCAPES.get(x[1], x)

    return re.sub(r"\\(?:u\{(?P<u>[0-9A-Fa-f]+)\}|x(?P<x>[0-9A-Fa-f]{1,2})|(?P<o>[0-7]{1,3})|[ntrvef\\$\"`])", one, text)


def _double(s: str, at: int, line: int, out: list[Token], quote: str) -> tuple[int, int]:
    begin, at = line, at + 1
    parts: list[object] = []
    at, line = _parts(s, at, line, parts, lambda i: i if s.startswith(quote, i) else None, quote)
    if at is None:
        raise SyntaxProblem(f"Unterminated text starting line {begin}")
    out.append(_text(parts, begin))
    return at + 1, line


def _text(parts: list[object], line: int) -> Token:
    if any(not isinstance(p, str) for p in parts):
        return Token("tpl", parts, line)
    return Token("str", "".join(parts), line)


def _heredoc(s: str, m: re.Match, line: int, out: list[Token]) -> tuple[int, int]:
    label = m[1] or m[2] or m[3]
    close = re.compile(r"[ \t]*" + label + r"(?![A-Za-z0-9_\x80-\U0010ffff])")
    begin, at = line, m.end()

    def ends(i: int) -> int | None:
        if i == at or s[i - 1] == "\n":
            return i if close.match(s, i) else None
        return None

    if m[2]:
        i = at
        while i is not None and i < len(s) and ends(i) is None:
            i = s.find("\n", i) + 1 or None
        if i is None or i >= len(s) and ends(i) is None:
            raise SyntaxProblem(f"Unterminated text starting line {begin}")
        out.append(Token("str", s[at:i], begin))
        stop, line = i, line + 1 + s.count("\n", at, i)
    else:
        parts: list[object] = []
        stop, line = _parts(s, at, line + 1, parts, ends, "")
        if stop is None:
            raise SyntaxProblem(f"Unterminated text starting line {begin}")
        out.append(_text(parts, begin))
    return close.match(s, stop).end(), line


_SIMPLE = re.compile(r"\$[A-Za-z_\x80-\U0010ffff][A-Za-z0-9_\x80-\U0010ffff]*(?:\[(?:-?[0-9]+|[A-Za-z_]\w*|\$[A-Za-z_]\w*)\]|\??->[A-Za-z_]\w*)?")


def _parts(s: str, at: int, line: int, parts: list[object], ends, quote: str) -> tuple[int | None, int]:
    """Split a text at its interpolations; gives where it ends, None if it doesn't."""
    plain = at
    while at < len(s):
        if (stop := ends(at)) is not None:
            parts.append(_unescape(s[plain:at], quote))
            return stop, line
        c = s[at]
        if c == "\\" and at + 1 < len(s):
            line += s[at + 1] == "\n"
            at += 2
            continue
        inner: list[Token] = []
        if s.startswith("{$", at) or s.startswith("${", at):
            parts.append(_unescape(s[plain:at], quote))
            start = at + 1 if c == "{" else at + 2
            at, line = _code(s, start, line, inner, "}")
            if c == "$" and inner and inner[0].kind == "name":
                inner[0] = Token("var", inner[0].text, inner[0].line)
            inner.append(Token("end", "", line))
            parts.append(inner)
            plain = at
            continue
        if c == "$" and (m := _SIMPLE.match(s, at)):
            parts.append(_unescape(s[plain:at], quote))
            text = re.sub(r"\[([A-Za-z_]\w*)\]", r"['\1']", m[0])
            _code(text, 0, line, inner, None)
            inner.append(Token("end", "", line))
            parts.append(inner)
            at = plain = m.end()
            continue
        line += c == "\n"
        at += 1
    return None, line
