"""Texts as arrays of code points in a plain form: lower case, with one space for each run of other characters."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np


@lru_cache(maxsize=2)
def _kept(digits: bool) -> np.ndarray:
    return np.array([(chr(i).isalnum() if digits else chr(i).isalpha()) for i in range(0x110000)])


def plain(text: str, digits: bool) -> np.ndarray:
    """uint32 code points of the letters (and digits) of text in lower case; whatever lies between becomes one space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = _kept(digits)[codes]
    stays = kept.copy()
    stays[1:] |= kept[:-1]
    return np.where(kept, codes, np.uint32(32))[stays]


def parts(text: str, size: int = 1 << 20) -> Iterator[str]:
    """text in parts that end at white space where there is any within reach."""
    at = 0
    while len(text) - at > size:
        to = text.find(" ", at + size, at + 2 * size)
        to = at + size if to < 0 else to
        yield text[at:to]
        at = to
    yield text[at:]
