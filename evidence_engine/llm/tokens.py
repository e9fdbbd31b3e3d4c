"""Words of whole batches of texts as numpy arrays: boundaries, 64-bit hashes and word shingles.

A batch is a run of texts laid end to end as UTF-8 bytes with their offsets, as Arrow stores
them. Nothing here loops over words in Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Byte classes. Space: what ``[^\x20\x09-\x0D]+`` leaves out. Latin: ``[0-9a-z]`` and all non-ASCII.
SPACE_WORDS = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)], dtype=np.uint8)
LATIN_WORDS = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)], dtype=np.uint8)
#: 0 for space, 1 for letters and digits, 2 for signs: a run of signs is a token of its own.
WORDS_AND_SIGNS = np.where(SPACE_WORDS == 0, 0, np.array([1 if chr(b).isalnum() or b >= 128 else 2 for b in range(256)])).astype(np.uint8)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)

_BASE = 0x9E3779B97F4A7C15
_state: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if _state.get("n", 0) < n:
        n = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            up = np.cumprod(np.full(n, _BASE, dtype=np.uint64))
            down = np.cumprod(np.full(n + 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64))
            table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
        _state.update(n=n, up=up, down=down, table=table)
    return _state["up"], _state["down"], _state["table"]


def runs(column: pa.Array, limit: int = 1 << 20):
    """(first row, UTF-8 bytes, offsets) of runs of rows of about `limit` bytes; null is empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of one class in each text, and each text's first word."""
    n = len(data)
    kind = classes[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    edge[1:n] |= kind[1:] != kind[:-1]
    inside = kind > 0
    starts = np.flatnonzero(inside & edge[:-1])
    ends = np.flatnonzero(inside & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes (a polynomial in random byte values, then mixed)."""
    up, down, table = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(table[data] * up[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def hash_of(word: bytes) -> np.uint64:
    return hashes(np.frombuffer(word, dtype=np.uint8), np.array([0]), np.array([len(word)]))[0]


def shingles(word_hashes: np.ndarray, first: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted. Fewer words than `width`: all of them as one; none: empty."""
    n = len(word_hashes)
    with np.errstate(over="ignore"):
        odd = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
        full = np.zeros(max(0, n - width + 1), dtype=np.uint64)
        for k in range(width):
            full += word_hashes[k : k + len(full)] * odd[k]
        full = mix(full)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= width:
                out.append(np.unique(full[a : b - width + 1]))
            elif b > a:
                out.append(mix(np.array([(word_hashes[a:b] * odd[: b - a]).sum() + np.uint64(b - a)], dtype=np.uint64)))
            else:
                out.append(full[:0])
    return out
