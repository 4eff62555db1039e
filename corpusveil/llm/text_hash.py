"""Vectorised hashing of the words of an Arrow text column; used inside tasks only."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at once; a longer word is hashed by itself.
BLOCK = 1 << 20
#: Places in a word with a table of their own; later ones mix the number of their run of places in.
PLACES = 64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_values: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every input bit over all output bits."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table() -> np.ndarray:
    """A 64-bit value for every byte at every place of a word."""
    if not _values:
        _values.append(mix(mix(np.arange(256 * PLACES, dtype=np.uint64)) ^ np.uint64(0x5851F42D4C957F2D)))
    return _values[0]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the rows' offsets in them; a null row is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64, len(column) + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for ascending, non-overlapping spans: the sum of the values
    of its bytes at their places. Values of different places have nothing in common, so no
    pattern of bytes cancels out as it does in polynomials modulo 2**64."""
    table = _table()
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(ends, starts[i] + BLOCK, "right"))
        if j <= i:
            digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
            out[i] = int.from_bytes(digest, "little")
            i += 1
            continue
        low, high = int(starts[i]), int(ends[j - 1])
        s, e = starts[i:j] - low, ends[i:j] - low
        # bytes before a span's end count from its start, those behind it (no word's) as well
        place = np.arange(high - low) - np.repeat(s, np.diff(np.append(s, high - low)))
        values = table[data[low:high] + 256 * (place % PLACES)]
        far = np.flatnonzero(place >= PLACES)
        if len(far):
            values[far] = mix(values[far] ^ mix((place[far] // PLACES).astype(np.uint64)))
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(values, out=sums[1:])
        out[i:j] = sums[e] - sums[s]
        i = j
    return mix(out ^ mix((ends - starts).astype(np.uint64)))


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of every row, A-Z lower-cased, and the place of
    each row's first word in them (one more entry than rows)."""
    data, offsets = text_bytes(column)
    data = _LOWER[data]
    letter = ~_SPACE[data]
    fresh = np.ones(len(data), bool)  # no word before this byte in its row
    fresh[1:] = ~letter[:-1]
    fresh[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(letter & fresh)
    last = np.ones(len(data), bool)
    last[:-1] = fresh[1:] | ~letter[1:]
    ends = np.flatnonzero(letter & last) + 1
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


#: Bytes of text hashed at once.
PART = 2_000_000


def parts(column: pa.Array):
    """Slices of the column of some PART bytes each, a longer row by itself."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    low, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > low and held + size > PART:
            yield column.slice(low, i - low)
            low, held = i, 0
        held += size
    if low < len(column):
        yield column.slice(low)


def shingle_sets(column: pa.Array, size: int):
    """For each row its distinct word shingles as ascending uint64 hashes. A row with fewer
    words has its whole word sequence as one shingle; a row without words has none."""
    for part in parts(column):
        yield from _shingle_sets(part, size)


def _shingle_sets(column: pa.Array, size: int):
    hashes, first = words(column)
    runs = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for k in range(size):
        runs = mix(runs * np.uint64(3) + hashes[k : k + len(runs)])
    for i in range(len(first) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= size:
            yield np.unique(runs[a : b - size + 1])
        elif b > a:
            few = np.array([b - a], np.uint64)
            for k in range(a, b):
                few = mix(few * np.uint64(5) + hashes[k : k + 1])
            yield few
        else:
            yield np.zeros(0, np.uint64)
