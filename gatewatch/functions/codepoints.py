"""Character counts of many texts at once, inside a task.

A batch's texts are decoded to one array of code points, in pieces of at most
``CHARS`` characters (a longer text is a piece of its own), and counted by
(row, character) with numpy, a few nanoseconds a character.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Characters that are counted at a time.
CHARS = 1 << 20
#: Most cells of a dense (row, character) table per character; beyond it the
#: keys are sorted instead.
DENSE = 8
_CODES = 0x110000
LETTER, DIGIT, SPACE, OTHER, REST = range(5)


def pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code points, characters per row) of consecutive rows of UTF-8 bytes;
    null is an empty text, malformed bytes are replaced."""
    held, size = [], 0
    for v in texts:
        b = v.as_py()
        t = b.decode("utf-8", "replace") if b else ""
        if held and size + len(t) > CHARS:
            yield _code_points(held)
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield _code_points(held)


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.array([len(t) for t in texts], np.int64)


def _log2(x: np.ndarray) -> np.ndarray:
    """As Spark's ``log2``: the quotient of natural logarithms."""
    return np.log(x) / np.log(2.0)


def count_entropy(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log2(n) - sum(c * log2 c) / n per row, c the count of a distinct character."""
    if not len(codes):
        return np.zeros(len(sizes))
    seen = np.zeros(_CODES, bool)
    seen[codes] = True
    chars = np.flatnonzero(seen)
    place = np.empty(_CODES, np.int64)
    place[chars] = np.arange(len(chars))
    key = np.repeat(np.arange(len(sizes)) * len(chars), sizes) + place[codes]
    if len(sizes) * len(chars) <= max(DENSE * len(codes), 1 << 16):
        count = np.bincount(key)
        cell = np.flatnonzero(count)
        count = count[cell]
    else:
        cell, count = np.unique(key, return_counts=True)
    total = np.bincount(cell // len(chars), count * _log2(count), minlength=len(sizes))
    n = np.maximum(sizes, 1)
    return np.where(sizes > 0, np.abs(_log2(n) - total / n), 0.0)


@lru_cache(maxsize=1)
def class_of() -> np.ndarray:
    """Class of every code point: letters, digits (decimal ones and others with
    a digit value), space and tab, other numbers (the rest), everything else."""
    out = np.full(_CODES, OTHER, np.uint8)
    for c in range(_CODES):
        kind = unicodedata.category(chr(c))
        if kind[0] == "L":
            out[c] = LETTER
        elif kind[0] == "N":
            out[c] = DIGIT if unicodedata.digit(chr(c), None) is not None else REST
    out[[ord(" "), ord("\t")]] = SPACE
    return out


def class_counts(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Characters per row of the letter, digit, space and other class."""
    key = np.repeat(np.arange(len(sizes)) * 5, sizes) + class_of()[codes]
    return np.bincount(key, minlength=5 * len(sizes)).reshape(-1, 5)[:, :REST]


def class_count_entropy(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Entropy over the four classes' shares of a row's characters."""
    p = class_counts(codes, sizes) / np.maximum(sizes, 1)[:, None]
    terms = np.where(p > 0, -p * _log2(np.where(p > 0, p, 1.0)), 0.0)
    h = np.zeros(len(sizes))
    for k in (LETTER, DIGIT, OTHER, SPACE):
        h = h + terms[:, k]
    return np.abs(h)


def per_row(texts: pa.Array, of) -> pa.Array:
    found = [of(codes, sizes) for codes, sizes in pieces(texts)]
    return pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())


def entropies(texts: pa.Array) -> pa.Array:
    return per_row(texts, count_entropy)


def class_entropies(texts: pa.Array) -> pa.Array:
    return per_row(texts, class_count_entropy)
