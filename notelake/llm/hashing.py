"""Vectorised 64-bit hashes of words and windows of bytes.

A byte string b has the polynomial hash sum of T[b[j]] * P**j modulo 2**64, T a fixed table of
random odd numbers, finished by a multiply-shift mixer. Prefix sums give the hash of any part.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240229))
_T = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_cache: dict[str, np.ndarray] = {}

#: The white space of ``[\x20\x09-\x0D]``.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    name, base = ("inv", _P_INV) if inverse else ("pow", _P)
    got = _cache.get(name)
    if got is None or len(got) < n:
        size = 1 << max(16, (n - 1).bit_length())
        got = np.full(size, base, dtype=np.uint64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        _cache[name] = got
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def word_spans(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes b with inside[b]."""
    flags = np.zeros(len(data) + 2, dtype=np.int8)
    flags[1:-1] = inside[data]
    edge = np.flatnonzero(flags[1:] != flags[:-1])
    return edge[0::2], edge[1::2]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash, never 0, of data[s:e] for each span."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_T[data] * _powers(len(data)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _powers(len(data) + 1, True)[starts]
    return mix(h + (ends - starts).astype(np.uint64)) | np.uint64(1)


def window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of data[i:i+size] for each i."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_T[data] * _powers(len(data)), out=sums[1:])
    return mix((sums[size:] - sums[:n]) * _powers(n, True))


_SPACE_AT = re.compile(rb"[ \t\n\r\x0b\x0c]")


def segments(texts: Iterable[bytes], size: int) -> Iterator[list[tuple[int, bytes]]]:
    """Buffers of (number of the text, part of it), about `size` bytes each, long texts cut after white space."""
    held, used = [], 0
    for k, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > size:
                cut = next(_SPACE_AT.finditer(text, at + size), None)
                end = cut.end() if cut else end
            held.append((k, text[at:end]))
            used, at = used + end - at, end
            if used >= size:
                yield held
                held, used = [], 0
    if held:
        yield held
