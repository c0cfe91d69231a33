"""Texts as streams of lower-case letters and single spaces, with rolling hashes of runs of characters."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np

#: Spaces before each text.
PAD = 8
_BASE = 0x9E3779B97F4A7C15


@cache
def _kinds() -> np.ndarray:
    """By code point: 1 letter, 2 the pad mark, else 0."""
    kinds = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    kinds[1] = 2
    return kinds


def stream(texts: list[str], pad: int = PAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters, text of each, whether it counts) of texts end to end.

    Letters stay, in lower case; whatever stands between letters becomes one
    space. Each text has `pad` spaces before it, which do not count.
    """
    mark = "\x01" * pad
    low = [t.lower().replace("\x01", " ") for t in texts]
    sizes = np.fromiter(map(len, low), np.int64, len(low)) + pad
    if not low:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, bool)
    # one mark more, where the last text's last word can end
    points = np.frombuffer((mark + mark.join(low) + "\x01").encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _kinds()[points]
    letter = kinds == 1
    after = np.zeros(len(points), bool)
    after[1:] = letter[:-1]
    keep = letter | after | (kinds == 2)
    owner = np.append(np.repeat(np.arange(len(low)), sizes), len(low))[keep]
    chars = np.where(letter, points, 32)[keep]
    counts = (letter | after)[keep]
    # the space that ends a text's last word lies in the next one's pad
    owner[1:][counts[1:] & (kinds[keep][1:] == 2)] -= 1
    return chars.astype(np.uint64), np.minimum(owner, len(low) - 1), counts


def rolling(chars: np.ndarray, longest: int) -> list[np.ndarray]:
    """hashes[k][i] of the k characters that end at i, for k = 0 ... longest; the first `longest` places are not used."""
    out = [np.zeros(len(chars), np.uint64)]
    power = 1
    for k in range(1, longest + 1):
        power = power * _BASE % (1 << 64)
        h = out[-1].copy()
        h[k - 1 :] += (chars[: max(0, len(chars) - k + 1)] + np.uint64(1)) * np.uint64(power)
        out.append(h)
    return out


def hashed(chars: np.ndarray, longest: int, size: int = 1 << 18) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(a, hashes) of the places from a on, `size` at a time: hashes[k][i] of the k characters that end at a + i."""
    for a in range(0, len(chars), size):
        lead = min(a, longest)
        yield a, [h[lead:] for h in rolling(chars[a - lead : a + size], longest)]
