"""Folding, tokens and snippets of text."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"


def _accents() -> tuple[str, str]:
    """Letters of the Latin blocks that decompose into an ASCII letter and marks, and these letters; then the marks, which go."""
    pairs = {}
    for n in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(n).lower())[0]
        if base.isascii() and base.isalpha():
            pairs[chr(n)] = base
    return "".join(pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(pairs.values())


FROM, TO = _accents()
_FOLD = {ord(c): (TO[n] if n < len(TO) else None) for n, c in enumerate(FROM)}


def fold(text: Column) -> Column:
    """Lower case without Latin accents; plain ASCII, told by its length, takes the short way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(F.lower(text), FROM, TO))


def fold_text(text: str) -> str:
    return text.lower().translate(_FOLD)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


_PIECE = re.compile(r"[^\W_]+")


def phrases(term: str) -> list[list[str]]:
    """The phrases of a search term: one a blank-separated word, each the tokens of the word; words without tokens match nothing."""
    words = [w.replace('"', "") for w in term.split()]
    words = [w for w in words if w] or ([term] if term.strip() else [])
    return [p for p in (_PIECE.findall(fold_text(w)) for w in words) if p]


def snippet(text: str | None, wanted: list[list[str]], size: int = 12, mark: str = "…") -> str:
    """About ``size`` tokens of a text around its first hit, each token of a hit between marks; see the rules in README."""
    text = text or ""
    spans = [m.span() for m in _PIECE.finditer(text)]
    words = [fold_text(text[a:b]) for a, b in spans]
    if not words:
        return text
    hits = [False] * len(words)
    first = None
    for i in range(len(words)):
        for p in wanted:
            if words[i : i + len(p)] == p:
                first = i if first is None else first
                hits[i : i + len(p)] = [True] * len(p)
    start = 0
    if first is not None:
        start = max(0, first - (size - 1) // 2)
        for i in range(first, max(-1, first - size), -1):
            # The last sentence that starts before the hit begins the window if it still holds the hit.
            if i == 0 or re.search(r"[.:]\s+$", text[spans[i - 1][1] : spans[i][0]]):
                start = i
                break
        start = max(0, min(start, len(words) - size))
    end = min(len(words), start + size)
    out, at = [mark] if start else [], spans[start][0] if start else 0
    for i in range(start, end):
        a, b = spans[i]
        out += [text[at:a], mark if hits[i] else "", text[a:b], mark if hits[i] else ""]
        at = b
    out.append(mark if end < len(words) else text[at:])
    return "".join(out)
