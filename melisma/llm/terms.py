"""Counts of the terms of one text: runs of the bytes that a pattern takes, only A-Z lower-cased."""

from __future__ import annotations

import re
from collections import Counter

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes of letters, and of letters and digits; every byte of a character beyond ASCII is one.
LETTERS, LETTERS_AND_DIGITS = re.compile(rb"[A-Za-z\x80-\xff]+"), re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Terms of longer texts are counted one by one, and never stand in a list.
LONG = 1 << 22


def occurrences(text: bytes | None, term: re.Pattern[bytes]) -> list[bytes] | Counter:
    """The terms of a text in UTF-8, of a long one their numbers; a null text has none."""
    if not text:
        return []
    text = text.translate(LOWER)
    return term.findall(text) if len(text) < LONG else Counter(m[0] for m in term.finditer(text))


def count(text: bytes | None, term: re.Pattern[bytes]) -> Counter:
    """Occurrences of each term of a text."""
    return Counter(occurrences(text, term))
