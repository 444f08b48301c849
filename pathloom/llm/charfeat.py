"""Hashed character n-grams of whole texts, for the linear text classifiers.

Letters are lower-cased, runs of anything else become one space, and the text gets a space at
either end, so n-grams know word boundaries. Work is done on numpy code-point arrays.
"""

from __future__ import annotations

import numpy as np

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
_LAST = np.uint64(0x94D049BB133111EB)


def letter_table() -> np.ndarray:
    """Of each code point below 65536 the lower-case letter, or 32 if it is none."""
    out = np.full(65536, 32, np.uint32)
    for c in range(65536):
        if (ch := chr(c)).isalpha():
            out[c] = ord(ch.lower()[0])
    return out


def letters(text: str, table: np.ndarray) -> np.ndarray:
    """Code points of the text's words with single spaces between and around them; length 1 if it has no letter."""
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    if raw.size and raw.max() >= 65536:
        far = raw >= 65536
        x = table[np.where(far, 32, raw)]
        x[far] = [ord(chr(c).lower()[0]) if chr(c).isalpha() else 32 for c in raw[far]]
    else:
        x = table[raw]
    is_letter = x != 32
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[:1] |= True
    x = x[keep]
    if x.size == 0 or x[0] != 32:
        x = np.concatenate((np.array([32], np.uint32), x))
    if x.size > 1 and x[-1] != 32:
        x = np.concatenate((x, np.array([32], np.uint32)))
    return x


def hashed(x: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """The bin of every n-gram of the code points, order after order."""
    x = x.astype(np.uint64)
    out = []
    for n in orders:
        if x.size < n:
            continue
        h = np.full(x.size - n + 1, n, np.uint64)
        for t in range(n):
            h += x[t : x.size - n + 1 + t] * _MIX[t]
            h ^= h >> np.uint64(31)
        h *= _LAST
        out.append((h >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)
