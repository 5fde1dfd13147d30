"""Cutting texts at places where byte-level BPE pre-tokenization certainly has a boundary.

The pre-tokenizer joins at most one space to the word after it, and looks ahead only past white space. So a lone
space or newline between two other characters always starts a new pre-token, and what lies between two such places is
encoded by itself. Words repeat, so encodings of these pieces are kept in a dictionary of bounded size.
"""

from __future__ import annotations

import re

#: White space that is neither a lone space nor a lone newline.
ODD = re.compile(r"[^\S \n]|[ \n]{2}")
#: Before a lone space or newline.
SAFE = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Pieces kept by a worker before it starts anew, and the longest that is kept.
CACHE_SIZE = 400_000
CACHE_LENGTH = 60


def cut(text: str) -> list[str]:
    """The text's pieces, in order. A piece begins with its space or newline; the first has none."""
    if not text:
        return []
    if ODD.search(text) or text[0] in " \n" or text[-1] in " \n":
        return SAFE.split(text)
    first, *rest = text.replace("\n", " \n").split(" ")
    return [first, *[x if x[0] == "\n" else f" {x}" for x in rest]]


def cut_special(text: str, special: str) -> list[str]:
    """As cut(), with each occurrence of a special string as its own piece."""
    if special not in text:
        return cut(text)
    out: list[str] = []
    for i, part in enumerate(text.split(special)):
        if i:
            out.append(special)
        out += cut(part)
    return out


def bounded(cache: dict, size: int = CACHE_SIZE) -> dict:
    """The cache, emptied if it has outgrown its size; call between batches."""
    if len(cache) > size:
        cache.clear()
    return cache
