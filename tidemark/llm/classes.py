"""Where a library's classes of characters differ from those of the ``regex`` module.

Tokenizers cut text by the Unicode tables that they were built with. A code point that is a letter, a number or white
space for one table and not for the other would be cut differently, so the library itself is asked once for every code
point, and texts are seen through a stand-in of the class that the library gives it.
"""

from __future__ import annotations

from collections.abc import Callable

import regex

POINTS = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
CLASSES = {r"\p{L}": "a", r"\p{N}": "1", r"\s": "\t"}  # with a character that every table has in the class
OTHER = "!"


def stand_ins(members: Callable[[str, str], str]) -> dict[int, str]:
    """Code point to stand-in, for those that the library puts elsewhere. members(pattern, text) gives the characters
    of text that the library takes for members of a class."""
    text = "".join(POINTS)
    out: dict[int, str] = {}
    ours: dict[str, str] = {}
    theirs: dict[str, str] = {}
    for pattern, example in CLASSES.items():
        ours |= dict.fromkeys(regex.findall(pattern, text), example)
        theirs |= dict.fromkeys(members(pattern, text), example)
    for c in ours.keys() | theirs.keys():
        if ours.get(c, OTHER) != theirs.get(c, OTHER):
            out[ord(c)] = theirs.get(c, OTHER)
    return out


class Cutter:
    """Matches of a pattern in a text, as the library finds them."""

    def __init__(self, pattern: str, instead: dict[int, str]):
        self.instead = instead
        compiled = regex.compile(pattern)
        self.find, self.spans = compiled.findall, compiled.finditer
        self.differs = regex.compile("[" + "".join(f"\\U{c:08x}" if c == d else f"\\U{c:08x}-\\U{d:08x}" for c, d in ranges(instead)) + "]").search if instead else lambda text: None

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or not self.differs(text):
            return self.find(text)
        return [text[m.start() : m.end()] for m in self.spans(text.translate(self.instead))]


def ranges(points: dict[int, str]) -> list[tuple[int, int]]:
    """Code points as ranges of neighbours."""
    out: list[tuple[int, int]] = []
    for c in sorted(points):
        if out and out[-1][1] == c - 1:
            out[-1] = (out[-1][0], c)
        else:
            out.append((c, c))
    return out
