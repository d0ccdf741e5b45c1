"""Words of many texts at once as numpy arrays: hashes, places and owners, inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts of one batch are taken together up to about this many bytes; a longer one goes alone.
SLICE_BYTES = 1 << 21
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed one-to-one scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def byte_values() -> np.ndarray:
    """A 64-bit number for each byte, the same for upper and lower case of A-Z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
    values[65:91] = values[97:123]
    return values


VALUES = byte_values()
#: Bytes of words parted by white space: all but blank and \t \n \v \f \r.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words of letters and digits: 0-9, A-Z, a-z and whatever is beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


@dataclass
class Words:
    """hashes, first bytes and lengths of all words; `ends[d]` is the first word after document d."""

    hashes: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    ends: np.ndarray

    def of(self, doc: int) -> slice:
        return slice(int(self.ends[doc - 1]) if doc else 0, int(self.ends[doc]))


def slices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of documents: number of the first, all their bytes with a blank after each, ends.

    Null texts are empty.
    """
    texts, size, first = [], 0, 0
    for i, text in enumerate(column.to_pylist()):
        raw = b"" if text is None else text.encode() if isinstance(text, str) else text
        if texts and size + len(raw) > SLICE_BYTES:
            yield first, *_joined(texts)
            texts, size, first = [], 0, i
        texts.append(raw)
        size += len(raw)
    if texts:
        yield first, *_joined(texts)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.frombuffer(b" ".join(texts) + b" ", np.uint8), ends


def words(data: np.ndarray, ends: np.ndarray, kind: np.ndarray = SPACED) -> Words:
    """The words of documents as `slices` gives them."""
    inside = kind[data]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts = np.flatnonzero(edge == 1)
    lengths = np.flatnonzero(edge == -1) - starts
    if not len(starts):
        return Words(np.empty(0, np.uint64), starts, lengths, np.zeros(len(ends), np.int64))
    first = np.cumsum(lengths) - lengths
    offset = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    terms = VALUES[data[inside]] * powers(BASE, int(lengths.max()))[offset]
    hashes = mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64))
    return Words(hashes, starts, lengths, np.searchsorted(starts, ends))


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each `n` successive words; one less than n fewer than there are words."""
    count = max(len(hashes) - n + 1, 0)
    total = np.full(count, np.uint64(n), np.uint64)
    for k, factor in enumerate(powers(_odd(7), n + 1)[1:]):
        total += hashes[k : k + count] * factor
    return mix(total)


def _odd(seed: int) -> int:
    return int(mix(np.array([seed], np.uint64))[0]) | 1
