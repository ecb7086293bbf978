"""Vector kernels on Arrow text columns, shared by the operators that run Python in their tasks.

A word is a maximal run of ASCII letters, ASCII digits and bytes of non-ASCII characters; ASCII
letters are folded to lower case. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
SHINGLE_WORDS = 5

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_BASE = _U(0xD6E8FEB86659FD93)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that all bits depend on all bits."""
    out = values ^ (values >> _U(30))
    out *= _U(0xBF58476D1CE4E5B9)
    out ^= out >> _U(27)
    out *= _U(0x94D049BB133111EB)
    out ^= out >> _U(31)
    return out


def byte_codes(folded: bool) -> np.ndarray:
    """A 64-bit code for each byte; with ``folded`` upper-case ASCII letters get the lower-case code."""
    codes = mix((np.arange(256, dtype=np.uint64) + _U(1)) * _ODD)
    if folded:
        codes[ord("A") : ord("Z") + 1] = codes[ord("a") : ord("z") + 1]
    return codes


def powers(count: int) -> np.ndarray:
    out = np.full(max(count, 1), _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def slices(
    batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about ``max_bytes`` of text; a longer text is a slice alone."""
    try:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
            bins = np.cumsum(sizes.astype(np.int64)) // max_bytes
            cuts = [0, *(np.flatnonzero(np.diff(bins)) + 1).tolist(), batch.num_rows]
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                yield batch.slice(start, stop - start)
    finally:
        # the worker lives on; what its next task needs is not known
        pa.default_memory_pool().release_unused()


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets into them."""
    if array.null_count:
        array = pc.fill_null(array, "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offset_buffer, data_buffer = array.buffers()
    if len(array) == 0 or offset_buffer is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    offsets = np.frombuffer(offset_buffer, np.int64 if wide else np.int32)
    offsets = offsets[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data_buffer is None else np.frombuffer(data_buffer, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(kinds: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text index of the maximal runs of equal non-zero kinds within each text."""
    if len(kinds) == 0:
        return (np.zeros(0, np.int64),) * 3
    change = np.empty(len(kinds) + 1, dtype=bool)
    change[0] = change[-1] = True
    np.not_equal(kinds[1:], kinds[:-1], out=change[1:-1])
    change[offsets] = True
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    keep = kinds[starts] != 0
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, folded: bool) -> np.ndarray:
    """A 64-bit hash of each run of bytes."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    begins = np.cumsum(lengths) - lengths
    local = np.arange(lengths.sum()) - np.repeat(begins, lengths)
    codes = byte_codes(folded)[data[local + np.repeat(starts, lengths)]]
    codes *= powers(int(lengths.max()))[local]
    return mix(np.add.reduceat(codes, begins) ^ (lengths.astype(np.uint64) * _ODD))


def word_kinds() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[ord("0") : ord("9") + 1] = 1
    table[ord("A") : ord("Z") + 1] = 1
    table[ord("a") : ord("z") + 1] = 1
    table[128:] = 1
    return table


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of each word."""
    starts, ends, text = runs(word_kinds()[data], offsets)
    return run_hashes(data, starts, ends, folded=True), text


def windows(hashes: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word's index of each run of ``size`` words within a text."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(count, np.uint64)
    for step in range(size):
        out *= _BASE
        out += hashes[step : step + count]
    first = np.flatnonzero(text[:count] == text[size - 1 :])
    return mix(out[first] + _U(size)), first


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of each shingle of ``size`` words; a shorter text with words has one
    shingle of all of them."""
    hashes, text = words(data, offsets)
    found, first = windows(hashes, text, size)
    counts = np.bincount(text, minlength=len(offsets) - 1)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short) == 0:
        return found, text[first]
    ends = np.cumsum(counts)
    few = [
        mix(np.array([_hash_few(hashes[ends[i] - counts[i] : ends[i]])], np.uint64))[0] for i in short
    ]
    owner = np.concatenate([text[first], short])
    order = np.argsort(owner, kind="stable")
    return np.concatenate([found, np.array(few, np.uint64)])[order], owner[order]


def _hash_few(hashes: np.ndarray) -> int:
    out = 0
    for value in hashes.tolist():
        out = (out * int(_BASE) + value) & 0xFFFFFFFFFFFFFFFF
    return (out + len(hashes)) & 0xFFFFFFFFFFFFFFFF
