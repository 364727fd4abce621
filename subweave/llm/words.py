"""Words and word shingles of Arrow text columns as 64-bit hashes, computed over whole batches of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_R = np.random.default_rng(20240607)
_BYTE = _R.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_POWER = _R.integers(1, 2**63, 4096, dtype=np.uint64) | np.uint64(1)
_STEP = _R.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _alphabet(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    terms = _BYTE[_LOWER]
    terms[breaks] = 0
    return breaks, terms


BLANKS = _alphabet(_SPACE)  # words end at ASCII white space
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[:128] = [not chr(b).isalnum() for b in range(128)]
PUNCTUATION = _alphabet(_PUNCTUATION)  # words are runs of ASCII letters and digits and of characters beyond ASCII
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads all bits of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and where each row starts in them (one more than rows); null is as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Cuts rows into runs of about `most` bytes; a longer row is a run of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_hashes(data: np.ndarray, offsets: np.ndarray, alphabet: tuple[np.ndarray, np.ndarray] = BLANKS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of bytes other than breaks, A-Z lower-cased), and each row's first word (one more than rows)."""
    breaks, byte_terms = alphabet
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    solid = ~breaks[data]
    fresh = solid.copy()
    fresh[1:] &= ~solid[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    fresh[heads] = solid[heads]
    starts = np.flatnonzero(fresh)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    data = data[starts[0] :]
    shifted = starts - starts[0]
    at = np.arange(len(data)) - np.repeat(shifted, np.diff(shifted, append=len(data)))
    terms = byte_terms[data] * _POWER[at & 4095]
    far = np.flatnonzero(at >> 12)  # in very long words the powers of each further 4096 bytes differ
    if len(far):
        terms[far] *= mixed((at[far] >> 12).astype(np.uint64)) | np.uint64(1)
    return mixed(np.add.reduceat(terms, shifted)), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's shingles of `size` words, a shorter row's whole sequence as one; and each row's first shingle."""
    counts = np.diff(first)
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(made)])
    n = len(words)
    if n >= size:
        full = words[: n - size + 1] * _STEP[0]
        for k in range(1, size):
            full = full + words[k : n - size + 1 + k] * _STEP[k]
    else:
        full = np.zeros(0, np.uint64)
    out = np.zeros(int(bounds[-1]), np.uint64)
    long = np.flatnonzero(counts >= size)
    take = np.arange(int(made[long].sum())) - np.repeat(np.concatenate([[0], np.cumsum(made[long])])[:-1], made[long])
    out[np.repeat(bounds[long], made[long]) + take] = full[np.repeat(first[long], made[long]) + take]
    for r in np.flatnonzero((counts < size) & (counts > 0)):
        w = words[first[r] : first[r + 1]]
        out[bounds[r]] = (w * _STEP[: len(w)]).sum(dtype=np.uint64) ^ _STEP[40 + len(w)]
    return mixed(out), bounds


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each row's number and its sorted distinct shingle hashes."""
    data, offsets = text_bytes(column)
    for lo, hi in runs(offsets):
        own = offsets[lo : hi + 1]
        words, first = word_hashes(data[own[0] : own[-1]], own - own[0])
        shingles, bounds = shingle_hashes(words, first, size)
        for r in range(hi - lo):
            yield lo + r, np.unique(shingles[bounds[r] : bounds[r + 1]])
