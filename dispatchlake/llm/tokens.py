"""Vectorised word splitting and hashing of text batches.

Texts of a batch are laid out in one byte buffer, separated by a space. Words are byte runs of a class;
since UTF-8 continuation and lead bytes are all 0x80 or more, the byte classes below equal the character
classes of the contracts. Sequence hashes are differences of prefix sums of a polynomial modulo 2**64.
"""

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Every byte but the six of ASCII white space: [^\x20\x09-\x0D]
NON_SPACE = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])
#: ASCII digits and letters and all of non-ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F], for lower-cased bytes
ALNUM = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])

_MASK = (1 << 64) - 1
#: Odd multipliers of the polynomials (for bytes, and two for word sequences).
_BYTE_BASE, _SEQ_BASES = 0x9E3779B97F4A7C15, (0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
_LETTERS = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)

#: Bytes of text worked on at a time.
CHUNK_BYTES = 2 << 20
#: Bytes of words that are hashed at a time.
_HASHED = 1 << 18


@lru_cache(maxsize=8)
def _grown(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    size = 1 << max(16, int(n - 1).bit_length())
    return _grown(base, size)[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over the word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Words:
    """The words of a batch: byte bounds, the text each is in, and 64-bit hashes."""

    def __init__(self, texts: list[bytes], kind: np.ndarray):
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.buffer = b" ".join(texts) + b" "
        raw = np.frombuffer(self.buffer, np.uint8)
        inside = kind[raw]
        edges = np.flatnonzero(np.diff(inside, prepend=False))
        self.starts, self.ends = edges[0::2], edges[1::2]
        text_starts = np.concatenate(([0], np.cumsum(lengths)))
        #: word index at which each text begins, and one past the last
        self.offsets = np.searchsorted(self.starts, text_starts)
        self.text_of = np.repeat(np.arange(len(texts)), np.diff(self.offsets))
        self.raw = raw

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self), np.uint64)
        a = 0
        # some words at a time: a word's hash doesn't depend on where its bytes stand
        while a < len(self):
            at = self.starts[a]
            b = max(a + 1, int(np.searchsorted(self.ends, at + _HASHED, side="right")))
            n = int(self.ends[b - 1] - at)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_LETTERS[self.raw[at : at + n]] * powers(_BYTE_BASE, n), out=sums[1:])
            starts, ends = self.starts[a:b] - at, self.ends[a:b] - at
            out[a:b] = mixed((sums[ends] - sums[starts]) * powers(pow(_BYTE_BASE, -1, 1 << 64), n)[starts])
            a = b
        return out


def sequence_hashes(words: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """The hash of every run of n consecutive entries (fewer entries than n: none)."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    base = _SEQ_BASES[which]
    sums = np.empty(len(words) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(words * powers(base, len(words)), out=sums[1:])
    return mixed((sums[n:] - sums[:-n]) * powers(pow(base, -1, 1 << 64), count))


def span_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each span of entries."""
    base = _SEQ_BASES[1]
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(base, len(words)), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * powers(pow(base, -1, 1 << 64), len(words) + 1)[starts] + (ends - starts).astype(np.uint64))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def utf8(column: pa.Array) -> list[bytes]:
    """A string column as bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def chunks(sizes: list[int], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive runs of about ``most`` bytes; a longer text is a run of its own."""
    first = total = 0
    for i, size in enumerate(sizes):
        if i > first and total + size > most:
            yield first, i
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)
