"""Vectorised views of UTF-8 text columns for the Arrow operators.

Everything here works on the column's byte buffer, a few megabytes at a time, so that no
Python object is made for a word, a shingle or a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# a worker gives back what it frees, rather than keep it for the next batch
pa.set_memory_pool(pa.system_memory_pool())

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of text handled at once, and the most documents among them (so that 12 bits number them).
CHUNK_BYTES, CHUNK_DOCS = 1 << 18, 4096


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


class Powers:
    """Powers of the hash base and of its inverse, as long as the longest chunk so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                full = np.full(n, _P, U64)
                full[0] = 1
                self.up = np.cumprod(full)
                full = np.full(n, _PINV, U64)
                full[0] = 1
                self.down = np.cumprod(full)
        return self.up, self.down


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of whole documents, about CHUNK_BYTES together."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, side="right")) - 1
        j = min(max(j, i + 1), i + CHUNK_DOCS, n)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each maximal run of bytes other than ASCII white space."""
    size = len(raw)
    if not size:
        z = np.zeros(0, np.int64)
        return z, z, z
    ink = ~_SPACE[raw]
    cut = np.zeros(size + 1, bool)
    cut[offsets] = True
    before = np.empty(size, bool)
    before[0] = True
    np.logical_not(ink[:-1], out=before[1:])
    before |= cut[:-1]
    starts = np.flatnonzero(ink & before)
    after = np.empty(size, bool)
    after[-1] = True
    np.logical_not(ink[1:], out=after[:-1])
    after |= cut[1:]
    ends = np.flatnonzero(ink & after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """A 64-bit polynomial hash of each span that depends on its bytes alone."""
    up, down = powers.upto(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, U64)
        np.cumsum((raw.astype(U64) + U64(1)) * up[: len(raw)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def shingles(hashes: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each window of ``width`` words; a shorter document gives its whole sequence as one."""
    n = len(hashes)
    with np.errstate(over="ignore"):
        base = [U64(pow(_P, k + 2, 1 << 64)) for k in range(width)]
        if n >= width:
            full = np.flatnonzero(doc[width - 1 :] == doc[: n - width + 1])
            value = np.zeros(len(full), U64)
            for k in range(width):
                value += hashes[full + k] * base[k]
            where = doc[full]
        else:
            value, where = np.zeros(0, U64), np.zeros(0, np.int64)
        if n:
            first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            count = np.diff(np.r_[first, n])
            short = first[count < width]
            lengths = count[count < width]
            tail = np.zeros(len(short), U64)
            for k in range(width - 1):
                live = lengths > k
                tail[live] += hashes[short[live] + k] * base[k]
            value = np.r_[value, tail + lengths.astype(U64) * U64(0xD6E8FEB86659FD93)]
            where = np.r_[where, doc[short]]
    return mix(value), where


def distinct(values: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each of up to 4096 documents, in one order for all, and their documents."""
    if not len(values):
        return values, doc
    key = (doc.astype(U64) << U64(52)) | (values >> U64(12))
    order = np.argsort(key)
    key, out, where = key[order], values[order], doc[order]
    same = out[1:] == out[:-1]
    if ((key[1:] == key[:-1]) & ~same).any():  # values of one document that differ in the last bits alone
        order = np.lexsort((values, doc))
        out, where = values[order], doc[order]
        same = out[1:] == out[:-1]
    first = np.r_[True, ~same | (where[1:] != where[:-1])]
    return out[first], where[first].astype(np.int64)
