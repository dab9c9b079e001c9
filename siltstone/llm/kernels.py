"""Vectorised text kernels shared by the Arrow-batched operators.

A *word* is a maximal run of ASCII letters, digits and non-ASCII characters of
the lower-cased text, i.e. the regular expression ``[a-z0-9\\x80-\\U0010ffff]+``.
Words are reduced to 64-bit hashes straight from the Arrow byte buffers, so no
Python string is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text hashed at a time; bounds the temporaries, not the text.
BLOCK = 1 << 19

_P = 0x9E3779B97F4A7C15 | 1
_WORD = np.zeros(256, dtype=bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("a") : ord("z") + 1] = True
_WORD[128:] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inv = pow(_P, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _P, np.uint64)]), dtype=np.uint64)
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, inv, np.uint64)]), dtype=np.uint64)
    return up, down


_UP, _DOWN = _powers(BLOCK)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _hash_block(raw: np.ndarray, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(start position, hashes) of each word that lies wholly in ``raw``; a column for the word and each prefix."""
    global _UP, _DOWN
    if len(raw) > len(_UP):  # a single word longer than a block
        _UP, _DOWN = _powers(len(raw))
    mask = _WORD[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum((raw + np.uint64(1)) * _UP[: len(raw)], dtype=np.uint64)])
        value = (total[end] - total[start]) * _DOWN[start]
        found = mix64(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        if not prefixes:
            return start, found
        columns = [found]
        for k in prefixes:
            part = (total[np.minimum(start + k, len(raw))] - total[start]) * _DOWN[start]
            part = mix64(part + np.uint64(k) * np.uint64(0xC2B2AE3D27D4EB4F))
            columns.append(np.where(end - start >= k, part, np.uint64(0)))
        return start, np.stack(columns, axis=1)


def word_hashes(text: pa.Array, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string array, and each row's offsets into them.

    A null row has no words. Returns ``(hashes, offsets)`` where row ``i`` owns
    ``hashes[offsets[i]:offsets[i + 1]]`` in text order. With ``prefixes``,
    lengths in bytes, each word has a row of hashes: its own and those of its
    prefixes, 0 for one that is longer than the word.
    """
    low = pc.utf8_lower(pc.fill_null(text.cast(pa.large_string()), ""))
    if isinstance(low, pa.ChunkedArray):
        low = low.combine_chunks()
    bounds = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    base, size = int(bounds[0]), int(bounds[-1] - bounds[0])
    if not size:
        return np.zeros((0, 1 + len(prefixes)) if prefixes else 0, np.uint64), np.zeros(len(low) + 1, np.int64)
    raw = np.frombuffer(low.buffers()[2], np.uint8)[base : base + size]
    # Rows must not run into each other: a word never crosses a row's end.
    cut = np.unique(bounds - base)
    starts, hashes, at = [], [], 0
    while at < size:
        stop = min(at + BLOCK, size)
        if stop < size:
            k = int(np.searchsorted(cut, stop, "right")) - 1
            if cut[k] > at:
                stop = int(cut[k])
            else:  # inside one long row: back to the last byte that ends no word
                while stop > at and _WORD[raw[stop - 1]]:
                    stop -= 1
                if stop == at:
                    stop = at + BLOCK
                    while stop < size and _WORD[raw[stop]]:
                        stop += 1
                    stop = min(stop, int(cut[k + 1]))
        inner = cut[(cut > at) & (cut < stop)] - at
        block = raw[at:stop]
        if len(inner) and (_WORD[block[inner - 1]] & _WORD[block[inner]]).any():
            block = np.insert(block, inner, 32)
            s, h = _hash_block(block, prefixes)
            s = s - np.searchsorted(inner + np.arange(len(inner)), s, "right")
        else:
            s, h = _hash_block(block, prefixes)
        starts.append(s + at)
        hashes.append(h)
        at = stop
    start, value = np.concatenate(starts), np.concatenate(hashes)
    return value, np.searchsorted(start, bounds - base, "left").astype(np.int64)


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive slices of about ``limit`` bytes of ``column``; a longer row is alone."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    end = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        done = end[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(end, done + limit, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def segments(offsets: np.ndarray) -> np.ndarray:
    """The row number of each element, from offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
