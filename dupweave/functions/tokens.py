"""Token streams: prose vectorised over whole batches, code by a small lexer.

A token is a run of ASCII letters, digits, `_` and non-ASCII characters, or one ASCII mark. Its hash takes
its kind and text; hash 0 is kept for separators, which stand between independent parts of a file and which
no run crosses.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from . import constants as C

U = np.uint64
TOKEN_PATTERN = r"[A-Za-z0-9_\x{80}-\x{10FFFF}]+|[!-/:-@\[-^`{-~]"
BASE = 0xC2B2AE3D27D4EB4F | 1
INVERSE = pow(BASE, -1, 1 << 64)
SLICE = 1 << 20

WORD = np.zeros(256, bool)
WORD[[*b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_"]] = True
WORD[128:] = True
MARK = np.zeros(256, bool)
MARK[[b for b in range(33, 127) if not WORD[b]]] = True


def finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def chained(values: np.ndarray, up: np.ndarray | None = None) -> np.ndarray:
    """Running sums of values times powers of BASE, with a 0 first."""
    up = ladder(len(values), BASE) if up is None else up
    return np.concatenate((np.zeros(1, U), np.cumsum(values * up, dtype=U)))


_ladders: dict[int, np.ndarray] = {}


def ladder(n: int, base: int) -> np.ndarray:
    if base not in _ladders or len(_ladders[base]) < n:
        steps = np.full(max(n, 1 << 16), U(base), U)
        steps[0] = 1
        _ladders[base] = np.cumprod(steps, dtype=U)
    return _ladders[base][:n]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each pair, from one running sum."""
    sums = chained(values)
    return finish((sums[ends] - sums[starts]) * ladder(len(values) + 1, INVERSE)[starts] + (ends - starts).astype(U))


@dataclass
class Stream:
    """Hashes (as signed 64-bit numbers) and first and last lines, counted from 1, of a file's tokens."""

    hashes: np.ndarray
    start_lines: np.ndarray
    end_lines: np.ndarray


def batch_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = pc.fill_null(texts.cast(pa.large_utf8()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def prose_streams(texts: pa.Array) -> Iterator[Stream]:
    """A stream for each text, in order; about SLICE bytes at a time."""
    offsets, data = batch_bytes(texts)
    a = 0
    while a < len(texts):
        b = min(len(texts), max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, "right")) - 1))
        own, part = offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
        edge = np.zeros(len(part) + 1, bool)
        edge[own] = True
        word, mark = WORD[part], MARK[part]
        starts = np.flatnonzero(mark | word & (edge[:-1] | ~np.concatenate(([False], word[:-1])))) if len(part) else np.zeros(0, np.int64)
        ends = np.flatnonzero(mark | word & (edge[1:] | ~np.concatenate((word[1:], [False])))) + 1 if len(part) else starts
        hashes = finish(run_hashes(part.astype(U) + U(1), starts, ends) + mark[starts].astype(U) if len(part) else np.zeros(0, U))
        hashes[hashes == 0] = 1
        breaks = np.concatenate(([0], np.cumsum(part == 10)))
        bounds = np.searchsorted(starts, own)
        for t in range(b - a):
            i, j = bounds[t], bounds[t + 1]
            lines = (breaks[starts[i:j]] - breaks[own[t]] + 1).astype(np.int32)
            yield Stream(hashes[i:j].view(np.int64), lines, lines)
        a = b


# What lexers skip and read, by family.
_C_COMMENT, _HASH_COMMENT, _DASH_COMMENT, _XML_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)", r"#[^\n]*", r"--[^\n]*|/\*.*?(?:\*/|\Z)", r"<!--.*?(?:-->|\Z)"
_SEMICOLON_COMMENT, _PERCENT_COMMENT, _BANG_COMMENT, _QUOTE_COMMENT, _PAREN_COMMENT = r";[^\n]*", r"%[^\n]*", r"![^\n]*", r"'[^\n]*", r"\(\*.*?(?:\*\)|\Z)"
_TEXT = r'"""(?:.*?)"""|\'\'\'(?:.*?)\'\'\'|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`'
_COMMENTS = {
    _HASH_COMMENT: "bash elixir julia makefile perl powershell python r ruby yaml toml graphql cmake coffeescript crystal gherkin hcl nim nix puppet tcl systemd turtle sparql",
    _DASH_COMMENT: "sql lua haskell elm ada vhdl idris purescript applescript",
    _XML_COMMENT: "markup vue svelte astro markdown aspnet",
    _SEMICOLON_COMMENT: "clojure lisp scheme racket asm6502 autohotkey wasm",
    _PERCENT_COMMENT: "erlang latex matlab prolog",
    _BANG_COMMENT: "fortran",
    _QUOTE_COMMENT: "vbnet basic",
    _PAREN_COMMENT: "ocaml pascal",
}
_FAMILY = {f: comment for comment, names in _COMMENTS.items() for f in names.split()}
_SEGMENT = re.compile(r"<(script|style)\b[^>]*>(.*?)</\1\s*>|^```([^\n]*)\n(.*?)^```", re.S | re.M | re.I)


class _Lexicon(dict):
    """Token text -> number, for a family of comments: kind, hash and line breaks of a text are worked out once.

    Alone, a token's text matches as it did in its place. Comments and line ends have hash 0 and aren't tokens.
    """

    held = 0

    def __init__(self, comment: str) -> None:
        kinds = {"comment": comment, "string": _TEXT, "number": r"\d[\w.]*", "word": r"\w+", "mark": r"[^\w\s]", "end": r"\n"}
        self.kind = re.compile("|".join(f"(?P<{k}>{pattern})" for k, pattern in kinds.items()), re.S)
        self.split = re.compile("|".join(kinds.values()), re.S).findall
        self.hashes, self.breaks = array("q"), array("q")

    def __missing__(self, text: str) -> int:
        kind = self.kind.match(text).lastgroup
        number = self[text] = len(self.hashes)
        self.hashes.append(0 if kind in ("comment", "end") else token_hash(kind, text))
        self.breaks.append(text.count("\n"))
        _Lexicon.held += ENTRY_BYTES + len(text)
        return number


#: A worker's lexicons hold about this much at most before the next file; then they begin anew.
LEXICON_BYTES, ENTRY_BYTES = 1 << 25, 200
_LEXICONS: dict[str, _Lexicon] = {}


def _lexicon(comment: str) -> _Lexicon:
    if _Lexicon.held > LEXICON_BYTES:
        _LEXICONS.clear()
        _Lexicon.held = 0
    if comment not in _LEXICONS:
        _LEXICONS[comment] = _Lexicon(comment)
    return _LEXICONS[comment]


def token_hash(kind: str, text: str) -> int:
    h = xxhash.xxh3_64_intdigest(f"{kind}\xff{text}")
    return (h or 1) - ((h >> 63) << 64)


def _lex(text: str, line: int, format_: str) -> np.ndarray:
    """Rows of hashes, first and last lines; `line` is the text's first."""
    lexicon = _lexicon(_FAMILY.get(format_, _C_COMMENT))
    found = lexicon.split(text)
    at = np.fromiter(map(lexicon.__getitem__, found), np.int64, len(found))
    hashes, breaks = (np.frombuffer(column, np.int64)[at] if len(at) else at for column in (lexicon.hashes, lexicon.breaks))
    ends = line + np.cumsum(breaks)
    return np.stack((hashes, ends - breaks, ends))[:, hashes != 0]


def code_stream(text: str | None, format_: str) -> Stream:
    """Tokens without comments and layout. Block formats give one part for each embedded language, parted by separators."""
    text = text or ""
    parts = []
    if format_ in C.BLOCK_FORMATS or format_ == "markup":
        outside, last = [], 0
        for m in _SEGMENT.finditer(text):
            outside.append(text[last : m.start()])
            outside.append("\n" * text.count("\n", m.start(), m.end()))
            last = m.end()
            tag = (m.group(1) or m.group(3) or "").lower()
            body, begin = (m.group(2), m.start(2)) if m.group(1) else (m.group(4), m.start(4))
            parts.append(_lex(body, 1 + text.count("\n", 0, begin), "css" if tag == "style" else tag or "javascript"))
        if format_ != "markdown":
            parts.insert(0, _lex("".join([*outside, text[last:]]), 1, format_))
    else:
        parts.append(_lex(text, 1, format_))
    rows = [np.zeros((3, 0), np.int64)]
    for part in (p for p in parts if p.shape[1]):
        if len(rows) > 1:
            end = rows[-1][2, -1]
            rows.append(np.array([[C.SEPARATOR], [end], [end]]))
        rows.append(part)
    hashes, starts, ends = np.concatenate(rows, axis=1)
    return Stream(hashes, starts.astype(np.int32), ends.astype(np.int32))


def streams(texts: pa.Array, formats: list[str | None]) -> Iterator[Stream]:
    """A stream for each text: code formats by the lexer, anything else as prose."""
    code = [name in C.FORMAT_EXTENSIONS and name != "txt" for name in formats]
    prose = prose_streams(texts.filter(pa.array([not c for c in code], pa.bool_())) if any(code) else texts)
    for text, name, is_code in zip(texts, formats, code, strict=True):
        yield code_stream(text.as_py(), name) if is_code else next(prose)
