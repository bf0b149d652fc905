"""Word shingles of texts as sorted arrays of 64-bit hashes, made a block of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SIZE = 5
#: Texts are worked on together up to so many bytes.
BLOCK_BYTES = 1_000_000


def blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many bytes of text each; one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(sizes):
        done = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, done + most, "right")))
        yield start, stop
        start = stop


def words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of lower-cased texts (A-Z only), cut at ASCII white space: codes, the words they stand for, words per text."""
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    codes, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    empty = np.flatnonzero(pc.equal(pc.binary_length(names), 0).to_numpy(zero_copy_only=False))
    if len(empty):
        keep = codes != empty[0]
        owner = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(owner[keep], minlength=len(counts))
        codes = codes[keep]
    return codes, names, counts


def word_hashes(names: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w.as_py()) for w in names.cast(pa.binary())), np.uint64, len(names))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def chain(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of several in order; as many of them make another hash."""
    out = np.full_like(parts[0], len(parts))
    for p in parts:
        out = mix(out) * np.uint64(3) + p
    return mix(out)


def sets(texts: pa.Array, size: int = SIZE) -> list[np.ndarray]:
    """The sorted different shingle hashes of each text; all words together where they are fewer than size, none without words."""
    codes, names, counts = words(texts)
    hashes = word_hashes(names)[codes] if len(codes) else np.zeros(0, np.uint64)
    ends = np.cumsum(counts)
    starts = ends - counts
    last = len(hashes) - size + 1
    runs = chain([hashes[j : last + j] for j in range(size)]) if last > 0 else np.zeros(0, np.uint64)
    out = []
    for s, n in zip(starts.tolist(), counts.tolist(), strict=True):
        if n >= size:
            out.append(np.unique(runs[s : s + n - size + 1]))
        else:
            out.append(chain([hashes[s + j : s + j + 1] for j in range(n)]) if n else hashes[:0])
    return out


def set_key(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of a whole set."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)
