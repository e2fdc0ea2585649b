"""Words of many texts at once as 64-bit hashes, without a Python loop over words.

A batch of texts is one byte buffer. With prefix sums of byte_value * base ** position
(modulo 2 ** 64) the hash of every word is one subtraction and one product, so a batch costs
a few passes of numpy over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2 ** 64
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything but letters, digits and bytes of characters beyond ASCII.
PUNCTUATED = np.ones(256, bool)
PUNCTUATED[0x30:0x3A] = PUNCTUATED[0x41:0x5B] = PUNCTUATED[0x61:0x7B] = PUNCTUATED[0x80:] = False


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 2**64))):
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def chunks(texts: list, most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about `most` characters together (a longer text is alone)."""
    start = held = 0
    for k, text in enumerate(texts):
        n = len(text) if text is not None else 0
        if held and held + n > most:
            yield start, k
            start, held = k, 0
        held += n + 1
    if start < len(texts):
        yield start, len(texts)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches of at most `rows` rows, so that a task holds few texts as Python values at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def hash_words(blobs: list[bytes], breaks: np.ndarray = WHITE, prefixes: tuple[int, ...] = ()) -> tuple:
    """Hashes of the words of all texts in order, and offsets: text k has words offsets[k]:offsets[k+1].

    With `prefixes`, also the hashes of each word's first so many bytes (of all, if it has fewer).
    """
    data = np.frombuffer(b"\n".join(blobs) + b"\n", np.uint8)
    white = breaks[data]
    edge = np.diff(white, prepend=True)
    starts, ends = np.flatnonzero(edge & ~white), np.flatnonzero(edge & white)
    powers, inverses = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverses[starts])
    first = np.cumsum([0, *(len(b) + 1 for b in blobs)])
    at = np.searchsorted(starts, first)
    if not prefixes:
        return hashes, at
    return hashes, at, [mix((sums[np.minimum(ends, starts + p)] - sums[starts]) * inverses[starts] + np.uint64(p)) for p in prefixes]


def hash_windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for every run of `width` neighbouring words (callers keep the runs within a text)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out + hashes[k : k + n]) * np.uint64(BASE)
    return mix(out)
