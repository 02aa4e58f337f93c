"""Hashed character n-grams of whole texts, many texts at a time in numpy.

A text is read as its letters in lower case; every run of other characters is
one separator, and each text begins and ends with one. Batches are cut into
groups of about ``GROUP_CHARS`` characters, a longer text at white space into
parts of its own, so memory does not follow the longest text.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

GROUP_CHARS = 300_000
_FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D)


@functools.cache
def _letters() -> np.ndarray:
    """Code point -> lower-case letter, or 0 if it is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            table[cp] = ord(c.lower()[0])
    return table


def groups(texts: list[str], most: int = GROUP_CHARS) -> Iterator[tuple[np.ndarray, list[str], list[int]]]:
    """(rows, parts, offsets): parts of texts, the row that each is from, in
    order, and its place in the row's text."""
    rows: list[int] = []
    offsets: list[int] = []
    parts: list[str] = []
    size = 0
    for row, text in enumerate(texts):
        start = 0
        while True:
            end = len(text)
            if end - start > most:
                cut = text.find(" ", start + most)
                end = cut if cut >= 0 else end
            part = text[start:end]
            if parts and size + len(part) > most:
                yield np.array(rows), parts, offsets
                rows, parts, offsets, size = [], [], [], 0
            rows.append(row)
            offsets.append(start)
            parts.append(part)
            size += len(part)
            start = end
            if start >= len(text):
                break
    if parts:
        yield np.array(rows), parts, offsets


class Stream:
    """codes: letters, and 0 for separators; part: which part each is of; at:
    its place in the characters of all parts, each with one before and after."""

    def __init__(self, parts: list[str]):
        raw = np.frombuffer("".join(f"\n{p}\n" for p in parts).encode("utf-32-le"), np.uint32)
        self.chars = raw
        starts = np.concatenate([[0], np.cumsum([len(p) + 2 for p in parts])])[:-1]
        codes = _letters()[raw]
        keep = codes != 0
        keep[1:] |= codes[:-1] != 0
        keep[starts] = True
        self.at = np.flatnonzero(keep)
        self.codes = codes[self.at]
        self.part = np.searchsorted(starts, self.at, side="right") - 1
        self.starts = starts

    def hashed(self, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, valid) of the n-gram at each place but the last n - 1."""
        c, size = self.codes, max(0, len(self.codes) - n + 1)
        h = np.full(size, n * 0x7FEB352D & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h += c[k : k + size] * np.uint32(_FACTORS[k])
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x846CA68B)
        h ^= h >> np.uint32(16)
        return h >> np.uint32(32 - bits), self.part[:size] == self.part[n - 1 : n - 1 + size]
