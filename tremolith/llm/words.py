"""Words and word shingles, shared by the operators that compare documents.

A word is a run of anything but space and TAB..CR after A-Z are lower-cased; a
shingle is five consecutive words, hashed to 64 bits.  A text with one to four
words has its whole sequence as its only shingle; an empty or null text none.

Words are hashed with xxh3 one by one, so texts crafted against a polynomial
hash (Thue-Morse words) collide no more than others do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SHINGLE = 5
_BASE = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64: close inputs end far apart."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Bytes of a text whose words are cut apart at once.
_PART = 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def text_words(text: str | None) -> np.ndarray:
    """The hash of every word of a text."""
    raw = text.encode("utf-8", "surrogatepass").lower() if text else b""
    found, at = [], 0
    while at < len(raw):
        end = len(raw)
        if end - at > _PART:
            gap = _GAP.search(raw, at + _PART)
            end = gap.start() if gap else end
        part = (raw if end - at == len(raw) else raw[at:end]).split()
        found.append(np.fromiter(map(xxhash.xxh3_64_intdigest, part), np.uint64, len(part)))
        at = end
    return found[0] if len(found) == 1 else np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingle_hashes(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """The hash of each run of k words, in text order; the whole text if shorter."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    h = words[: n - k + 1] + np.uint64(k)
    for j in range(1, k):
        h = h * np.uint64(_BASE) + words[j : n - k + 1 + j]
    return mix(h)


def row_slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A batch in parts, to bound what a worker holds at once."""
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    h = np.sort(shingle_hashes(text_words(text)))
    return h if len(h) < 2 else h[np.concatenate(([True], h[1:] != h[:-1]))]


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    return [shingle_set(t) for t in column.to_pylist()]


def list_column(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column out of one numpy array a row."""
    ends = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=ends[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(kind.to_pandas_dtype()) if flat.dtype.itemsize == 8 else flat, type=kind))


def bytes_column(arrays: list[np.ndarray]) -> pa.Array:
    """A binary column out of one array of 64-bit numbers a row."""
    ends = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([8 * len(a) for a in arrays], out=ends[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.Array.from_buffers(pa.binary(), len(arrays), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
