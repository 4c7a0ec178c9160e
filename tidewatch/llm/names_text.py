"""Normalisation of names as people type them; shared by the operators on names."""

from __future__ import annotations

import re
import unicodedata

# Letters that canonical decomposition leaves alone. Fixed values.
_LETTERS = str.maketrans({"ß": "ss", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ı": "i", "þ": "th", "ð": "d", "’": "'", "‘": "'", "`": "'", "´": "'"})
_INVISIBLE = re.compile("[­​-‏‪-‮⁠﻿]")


def fold(text: str) -> str:
    """Compatibility form without accents and invisible characters; case is kept."""
    text = _INVISIBLE.sub("", unicodedata.normalize("NFKD", text).translate(_LETTERS))
    return "".join(c for c in text if not unicodedata.combining(c))


def split_joined(text: str) -> str:
    """Space before a capital that follows a small letter ("NorthRiver")."""
    return re.sub(r"(?<=[a-z])(?=[A-Z])", " ", text)


def grams(text: str, size: int = 3) -> list[str]:
    """Distinct character n-grams of every word, padded by one mark on both sides."""
    out = set()
    for word in text.split():
        padded = f"^{word}$"
        out.update(padded[i : i + size] for i in range(max(1, len(padded) - size + 1)))
    return sorted(out)


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, replacements and swaps of neighbours between two words; more than ``most`` counts as most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [0] * (len(b) + 1), list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], before[j - 2] + 1)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)
