"""Words of Arrow text columns as numpy arrays: bounds and 64-bit hashes, without a Python object for each word.

A word is a longest run of bytes other than space and 0x09-0x0D. Its hash is multilinear (random weight by
position, random value by byte, modulo 2**64) and mixed once more; two different words share it with a
probability of about 2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

Pair = tuple[np.ndarray, np.ndarray]
SLICE_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.array([chr(i).isalnum() or i > 127 for i in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = np.random.Generator(np.random.PCG64(20_011)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_VALUE[_SPACE] = 0
_VALUE_LOWER = _VALUE[_LOWER]
_weights = np.empty(0, np.uint64)


def weights(n: int) -> np.ndarray:
    """At least n random odd numbers; longer requests begin like shorter ones."""
    global _weights
    if len(_weights) < n:
        size = 1 << max(10, (n - 1).bit_length())
        _weights = np.random.PCG64(77_003).random_raw(size) | np.uint64(1)
    return _weights


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(texts: pa.Array) -> Pair:
    """(offsets, bytes) of a string or binary array; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    buffers = texts.buffers()
    if not len(texts) or buffers[2] is None:
        return np.zeros(len(texts) + 1, np.int64), np.empty(0, np.uint8)
    offsets = np.frombuffer(buffers[1], np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer text is a range of its own."""
    offsets, _ = raw(texts)
    a, n = 0, len(texts)
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


def words(texts: pa.Array, lower: bool = False, letters: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, first word of each text and the total, bytes); starts and ends are byte places.

    With ``letters``, words are runs of ASCII letters, digits and all bytes beyond ASCII instead."""
    offsets, data = raw(texts)
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, np.zeros(len(texts) + 1, np.int64), data
    inside = (_LETTER if letters else ~_SPACE)[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < n)]
    start[edges] = inside[edges]
    end = inside.copy()
    end[:-1] &= start[1:] | ~inside[1:]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends, first, data
    span = np.diff(np.append(starts, n))
    place = np.arange(starts[0], n) - np.repeat(starts, span)
    if int(span.max()) > 4096:  # runs of spaces between words need no weight
        place[~inside[starts[0] :]] = 0
    terms = weights(int(place.max()) + 1)[place]
    terms *= (_VALUE_LOWER if lower else _VALUE)[data[starts[0] :]]
    if letters:
        terms[~inside[starts[0] :]] = 0
    sums = np.add.reduceat(terms, starts - starts[0])
    return mix(sums + (ends - starts).astype(np.uint64)), starts, ends, first, data
