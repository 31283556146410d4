"""Sets of word shingles of whole texts as sorted arrays of 64-bit hashes, computed on Arrow buffers with numpy.

A text's words are maximal runs of bytes other than ASCII white space, A-Z lower-cased. Words are hashed by a
polynomial over random byte values modulo 2**64, shingles by a mix of their words' hashes. Two different shingles
are taken for one with a probability of about 2**-64 a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(of: int, n: int) -> np.ndarray:
    have = _POWERS.get(of)
    if have is None or len(have) < n:
        size = -(-max(n, CHUNK_BYTES) // CHUNK_BYTES) * CHUNK_BYTES
        have = np.full(size, of, np.uint64)
        have[0] = 1
        have = _POWERS[of] = np.multiply.accumulate(have)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def _of_chunk(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    n, rows = len(data), len(offsets) - 1
    nothing = np.empty(0, np.uint64)
    if not n:
        return [nothing] * rows
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    gap = _SPACE[data]
    prev = np.empty(n, bool)
    prev[0], prev[1:] = True, gap[:-1]
    starts = np.flatnonzero(~gap & (prev | begins[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, gap[1:]
    ends = np.flatnonzero(~gap & (after | begins[1:])) + 1
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_VALUES[_LOWER[data]] * _powers(_BASE, n), out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * _powers(_INVERSE, n)[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, offsets)  # the words of row i: first[i] .. first[i + 1]
    joined = h.copy() if len(h) else nothing
    if len(h) >= width:
        joined = np.zeros(len(h) - width + 1, np.uint64)
        for k in range(width):
            joined = mix(joined + h[k : len(h) - width + 1 + k] + np.uint64(k + 1))
    out = []
    for i in range(rows):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= width:
            out.append(np.unique(joined[a : b - width + 1]))
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for k in range(a, b):
                whole = mix(whole + h[k : k + 1] + np.uint64(k - a + 1))
            out.append(mix(whole + np.uint64(b - a)))
        else:
            out.append(nothing)
    return out


def sets(texts: pa.StringArray, width: int):
    """The shingle set of each text (none may be null), in chunks of about ``CHUNK_BYTES``: (first row, list of sets)."""
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    rows = len(texts)
    if not rows:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + rows + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        part = offsets[at : to + 1]
        yield at, _of_chunk(data[part[0] : part[-1]], part - part[0], width)
        at = to


def signature(s: np.ndarray) -> bytes | None:
    """128 bits that tell sets apart; None for the empty set."""
    if not len(s):
        return None
    return np.array([mix(s + np.uint64(7)).sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64).tobytes()
