"""Words of a text in a form in which spelling, marks and character forms don't matter."""

from __future__ import annotations

import unicodedata

import regex

from askmill.llm.lookalike import ALIKE_FROM, ALIKE_TO

_ALIKE = str.maketrans(ALIKE_FROM, ALIKE_TO)
#: Small letters whose capitals are drawn like Latin ones: with case levelled they have to follow them.
_SMALL_ALIKE = str.maketrans("квнмтκβημτζχ", "kbhmtkbhmtzx")
_ALIKE_ANY = regex.compile(r"[\u0370-\u058f]")
_PLAIN_MARKS = regex.compile(r"[^A-Za-z0-9\s/|]+")
_PARTS = str.maketrans("/|", "  ")
_OPENS = regex.compile(r"[<&\[{]")
_MARKUP = regex.compile(r"<[^<>]{1,200}>|&(?:\w{2,8}|#\d+);|\[\d+\]|\{\{[^{}]*\}\}")
_BREAK = regex.compile(r"(?<=\p{L})-\n(?=\p{Ll})")
_SPLIT = regex.compile(r"[\s\p{Z}–—/|]+")
_MARKS = regex.compile(r"[^\p{L}\p{M}\p{N}\s\p{Z}–—/|]+")


def words(text: str | None) -> list[str]:
    """Lower-case words: compatibility forms, look-alike letters, tags, references and marks are levelled.

    Marks within a word are dropped and don't part it; dashes, slashes and bars part words, hyphens don't.
    """
    if not text:
        return []
    plain = text.isascii()
    if not plain:
        text = unicodedata.normalize("NFKC", text)
    if "-\n" in text:
        text = _BREAK.sub("", text)
    if _OPENS.search(text):
        text = _MARKUP.sub(" ", text)
    if plain:  # nothing to level but case, marks and spaces
        return _PLAIN_MARKS.sub("", text).lower().translate(_PARTS).split()
    if _ALIKE_ANY.search(text):
        text = text.translate(_ALIKE)
    text = unicodedata.normalize("NFC", _MARKS.sub("", text)).casefold()
    if _ALIKE_ANY.search(text):
        text = text.translate(_SMALL_ALIKE)
    return [w for w in _SPLIT.split(text) if w]


def slip(a: str, b: str) -> bool:
    """True if one slip of typing (a letter more, less, other, or two swapped) leads from ``a`` to ``b``."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    if abs(la - lb) > 1:
        return False
    i = 0
    while i < min(la, lb) and a[i] == b[i]:
        i += 1
    if la == lb:
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if la > lb else a[i:] == b[i + 1 :]
