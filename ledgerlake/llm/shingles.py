"""Words and word shingles of whole texts as 64-bit hashes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z in lower case (bytes.lower and bytes.split know only ASCII)."""
    return (text or "").encode().lower().split()


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """xxhash64 of every word of all texts, and the place behind each text's last word. Each distinct word is hashed once."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    offsets, flat = parts.offsets.to_numpy(), parts.flatten()
    coded = flat.dictionary_encode()
    of_word = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_numpy(zero_copy_only=False)), dtype=np.uint64, count=len(coded.dictionary))
    # white space at the ends of a text leaves empty words
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    ends = np.concatenate([[0], np.cumsum(full)])[offsets - offsets[0]][1:]
    return of_word[coded.indices.to_numpy()[full]] if len(flat) else np.zeros(0, np.uint64), ends


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """For each text, its distinct shingles of so many words, sorted; with fewer words, the whole sequence as one."""
    flat, ends = word_hashes(texts)
    n = max(0, len(flat) - width + 1)
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        rolled += mix(flat[k : n + k] ^ np.uint64(k + 1)) * _MULTIPLIERS[k % 5]
    rolled = mix(rolled)
    out, start = [], 0
    for end in ends.tolist():
        if end - start >= width:
            out.append(np.unique(rolled[start : end - width + 1]))
        else:  # the number of words keeps short texts apart from shingles and from each other
            out.append(np.array([xxhash.xxh64_intdigest(flat[start:end].tobytes(), seed=end - start)] if end > start else [], dtype=np.uint64))
        start = end
    return out


def slices(batches: Iterator[pa.RecordBatch], chars: int = 1 << 21, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about so many bytes of text, or so many rows; a text is never cut."""
    for b in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = before = 0
        while start < b.num_rows:
            end = min(b.num_rows, start + rows, int(np.searchsorted(sizes, before + chars)) + 1)
            yield b.slice(start, end - start)
            start, before = end, int(sizes[end - 1])


def give_back() -> None:
    """Returns what Arrow holds in reserve to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
