"""Code points of a UTF-8 buffer and their classes, as arrays."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0


@cache
def classes() -> np.ndarray:
    """Class of each code point: \\p{L}, \\p{N}, White_Space or other."""
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    # The White_Space property.
    table[[0x20, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    table[0x09:0x0E] = SPACE
    table[0x2000:0x200B] = SPACE
    return table


def decode(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, byte position of each) of valid UTF-8."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    lead = buf[at].astype(np.uint32)
    high = np.flatnonzero(lead >= 0xC0)
    if len(high):
        padded = np.append(buf, np.zeros(3, np.uint8)).astype(np.uint32)
        p, c = at[high], lead[high]
        b1, b2, b3 = padded[p + 1] & 63, padded[p + 2] & 63, padded[p + 3] & 63
        two, three = ((c & 31) << 6) | b1, ((c & 15) << 12) | (b1 << 6) | b2
        four = ((c & 7) << 18) | (b1 << 12) | (b2 << 6) | b3
        lead[high] = np.where(c < 0xE0, two, np.where(c < 0xF0, three, four))
    return lead, at


def has_letter(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    cps, at = decode(buf)
    found = at[classes()[np.minimum(cps, 0x10FFFF)] == LETTER]
    return np.searchsorted(found, offsets[1:]) > np.searchsorted(found, offsets[:-1])
