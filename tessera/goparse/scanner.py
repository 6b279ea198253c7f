"""Go tokens with byte offsets, white space and comments between them, and the semicolons that line ends imply.

One expression per kind of token does the scanning. Pieces (tokens and trivia) always put together the input again,
whatever it holds: what is no token becomes a piece of kind ``invalid`` and an error.
"""

from __future__ import annotations

import re
from typing import NamedTuple

# Fixed values of the language.
KEYWORDS = frozenset(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
)
OPERATORS = (
    "&^= <<= >>= ... && || <- ++ -- == != <= >= := += -= *= /= %= &= |= ^= << >> &^ + - * / % & | ^ < > = ! ( ) [ ] { } , ; . : ~".split()
)
#: A line that ends with one of these has a semicolon at its end.
ENDS_STATEMENT = frozenset(["ident", "int", "float", "imag", "rune", "string"])
ENDING_KEYWORDS = frozenset("break continue fallthrough return".split())
ENDING_OPERATORS = frozenset("++ -- ) ] }".split())

_DIGITS = r"[0-9](?:_?[0-9])*"
_HEX = r"0[xX](?:_?[0-9a-fA-F])+"
_PARTS = [
    ("newline", r"\r?\n"),
    ("space", r"[ \t\r]+"),
    ("line_comment", r"//[^\n]*"),
    ("block_comment", r"/\*(?s:.*?)\*/"),
    ("ident", r"[^\W\d]\w*"),
    ("punctuation", r"[(){}\[\],;]"),  # operators that begin no longer one, before the many others
    ("imag", rf"(?:{_HEX}|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:{_DIGITS})?\.?{_DIGITS}(?:[eE][+-]?{_DIGITS})?|{_DIGITS}\.(?:[eE][+-]?{_DIGITS})?)i\b"),
    ("float", rf"0[xX](?:_?[0-9a-fA-F])*\.?(?:[0-9a-fA-F](?:_?[0-9a-fA-F])*)?[pP][+-]?{_DIGITS}|{_DIGITS}\.(?:{_DIGITS})?(?:[eE][+-]?{_DIGITS})?|{_DIGITS}[eE][+-]?{_DIGITS}|\.{_DIGITS}(?:[eE][+-]?{_DIGITS})?"),
    ("int", rf"{_HEX}|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|{_DIGITS}"),
    ("string", r'"(?:\\.|[^"\\\n])*"|`[^`]*`'),
    ("rune", r"'(?:\\(?:[abfnrtv\\']|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3})|[^'\\\n])'"),
    ("operator", "|".join(map(re.escape, OPERATORS))),
    ("invalid", r"(?s:.)"),
]
_TOKEN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _PARTS))
TRIVIA = frozenset(["newline", "space", "line_comment", "block_comment", "bom"])


class Piece(NamedTuple):
    """kind, byte range, text. A ``semicolon`` that a line end implies has no text and an empty range."""

    kind: str
    start: int
    end: int
    text: str

    @property
    def inserted(self) -> bool:
        return self.kind == "semicolon" and self.start == self.end


def scan(source: bytes) -> tuple[list[Piece], list[str]]:
    """(pieces in order, errors) of a file. Bytes that aren't UTF-8 are told as an error and kept."""
    errors: list[str] = []
    pieces: list[Piece] = []
    try:
        text = source.decode("utf-8")
        plain = True
    except UnicodeDecodeError as e:
        errors.append(f"{e.start}: not UTF-8")
        text = source.decode("utf-8", "surrogateescape")
        plain = False
    if "\0" in text:
        errors.append(f"{len(text[: text.index(chr(0))].encode('utf-8', 'surrogateescape'))}: byte NUL")
    at, ends = 0, False  # byte offset; whether a line end here ends a statement
    ascii_only = text.isascii()
    add, new = pieces.append, tuple.__new__
    for m in _TOKEN.finditer(text):
        kind, own = m.lastgroup, m.group()
        end = at + (len(own) if ascii_only or own.isascii() else len(own.encode("utf-8", "surrogateescape")))
        if kind == "space":
            add(new(Piece, ("space", at, end, own)))
        elif kind in TRIVIA:
            if ends and (kind != "block_comment" or "\n" in own):
                add(new(Piece, ("semicolon", at, at, "")))
                ends = False
            add(new(Piece, (kind, at, end, own)))
        elif kind == "ident":
            if own in KEYWORDS:
                add(new(Piece, ("keyword", at, end, own)))
                ends = own in ENDING_KEYWORDS
            else:
                add(new(Piece, ("ident", at, end, own)))
                ends = True
        elif kind == "punctuation" or kind == "operator":
            add(new(Piece, ("semicolon" if own == ";" else "operator", at, end, own)))
            ends = own in ENDING_OPERATORS
        elif kind != "invalid":
            add(new(Piece, (kind, at, end, own)))
            ends = True  # a literal
        elif m.start() == 0 and own == "\ufeff":
            add(new(Piece, ("bom", at, end, own)))
        else:
            errors.append(f"{at}: no token begins with {own!r}" if plain else f"{at}: no token")
            add(new(Piece, ("invalid", at, end, own)))
            ends = False
        at = end
    if ends:
        pieces.append(Piece("semicolon", at, at, ""))
    return pieces, errors


def rebuilt(pieces: list[Piece]) -> bytes:
    return "".join(p.text for p in pieces).encode("utf-8", "surrogateescape")
