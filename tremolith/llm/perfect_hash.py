"""Sharded minimal perfect hash over 128-bit keys, with fingerprints and counts.

A shard's keys are hashed into a bit array of GAMMA times their number; keys alone
at their bit keep it, the others go on to the next, smaller level.  A key's place
is the number of set bits before its own, so n keys fill exactly n places: those
of a fingerprint array (the half of the key that the hash doesn't sort by) and of
a count array as narrow as the shard's largest count allows.  A key that is not
in the index gets some place or none; its fingerprint then differs.

Shards are built by Spark tasks, each of some SHARD_KEYS keys, and written as rows
of the shared folder; each executor fetches their files once and lays them out as
flat files that its workers map into memory.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from .words import mix

#: Bits a key on each level.
GAMMA = 2
#: Keys of a shard, about.
SHARD_KEYS = 1 << 16

SHARD_SCHEMA = "shard int, n bigint, sizes array<bigint>, bits binary, prints binary, counts binary"
_ROWS = ("shard", "n", "sizes", "bits", "prints", "counts")
_FILES = ("bits", "before", "prints", "counts")


def _at(lead: np.ndarray, prints: np.ndarray, level: int, size: np.ndarray | int) -> np.ndarray:
    """The bit of each key on a level of ``size`` bits."""
    step = np.uint64(0x9E3779B97F4A7C15 * (2 * level + 1) & 0xFFFFFFFFFFFFFFFF)
    return (mix(lead + prints * np.uint64(3) + step) % np.asarray(size, np.uint64)).astype(np.int64)


def build(lead: np.ndarray, prints: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Of distinct keys (two uint64 halves): the levels' sizes in bits, all levels'
    bits in 64-bit words, and each key's place."""
    sizes, words, place_bit = [], [], np.zeros(len(lead), np.int64)
    left, start, level = np.arange(len(lead)), 0, 0
    while len(left):
        size = -(-GAMMA * len(left) // 64) * 64
        at = _at(lead[left], prints[left], level, size)
        alone = np.bincount(at, minlength=size)[at] == 1
        bits = np.zeros(size, np.uint8)
        bits[at[alone]] = 1
        place_bit[left[alone]] = start + at[alone]
        words.append(np.packbits(bits, bitorder="little").view(np.uint64))
        sizes.append(size)
        left, start, level = left[~alone], start + size, level + 1
    bits = np.concatenate(words) if words else np.zeros(0, np.uint64)
    return sizes, bits, rank(bits, before(bits), place_bit)


def before(bits: np.ndarray) -> np.ndarray:
    """The set bits before each word."""
    out = np.zeros(len(bits), np.uint32)
    np.cumsum(np.bitwise_count(bits[:-1]), out=out[1:], dtype=np.uint32)
    return out


def rank(bits: np.ndarray, before_: np.ndarray, at: np.ndarray) -> np.ndarray:
    word = at >> 6
    below = bits[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
    return before_[word].astype(np.int64) + np.bitwise_count(below)


def shard_of(lead: np.ndarray, shards: int) -> np.ndarray:
    """By the key's highest 32 bits."""
    return ((lead >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Builds the shards of one partition: rows (shard, lead, print, count), a shard's
    rows in one partition."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    shard, lead, prints, counts = (t.column(k).to_numpy() for k in range(4))
    order = np.argsort(shard, kind="stable")
    cuts = [0, *(np.flatnonzero(np.diff(shard[order])) + 1).tolist(), len(order)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        some = order[a:b]
        x, y, c = lead[some].view(np.uint64), prints[some].view(np.uint64), counts[some]
        sizes, bits, place = build(x, y)
        own, seen = np.empty_like(y), np.empty(len(c), np.min_scalar_type(int(c.max())))
        own[place], seen[place] = y, c
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([int(shard[some[0]])], pa.int32()), pa.array([len(some)], pa.int64()), pa.array([sizes], pa.list_(pa.int64())),
                pa.array([bits.tobytes()], pa.binary()), pa.array([own.tobytes()], pa.binary()), pa.array([seen.tobytes()], pa.binary()),
            ],
            names=list(_ROWS),
        )


def lay_out(parts: list[str]) -> str:
    """Flat files of fetched files of shard rows, made once on a machine beside
    them: whoever comes second uses those of the first."""
    target = min(parts) + ".flat"
    if os.path.isdir(target):
        return target
    made = tempfile.mkdtemp(dir=os.path.dirname(target))
    files = {k: open(f"{made}/{k}", "wb") for k in _FILES}
    known = []  # shard, first word, first place, widths of counts, sizes
    words = places = at = 0
    try:
        for part in sorted(parts):
            for batch in pq.ParquetFile(part).iter_batches(batch_size=1):
                row = batch.to_pylist()[0]
                bits = np.frombuffer(row["bits"], np.uint64)
                files["bits"].write(row["bits"])
                files["before"].write(before(bits).tobytes())
                files["prints"].write(row["prints"])
                width = len(row["counts"]) // row["n"]
                files["counts"].write(row["counts"])
                known.append((row["shard"], words, places, at, width, row["sizes"]))
                words, places, at = words + len(bits), places + row["n"], at + len(row["counts"])
    finally:
        for f in files.values():
            f.close()
    shards, levels = 1 + max((k[0] for k in known), default=0), max((len(k[5]) for k in known), default=0)
    heads, sizes = np.zeros((shards, 4), np.int64), np.zeros((shards, levels), np.int64)
    for shard, *head, own in known:
        heads[shard] = head
        sizes[shard, : len(own)] = own
    np.save(f"{made}/heads.npy", heads)
    np.save(f"{made}/sizes.npy", sizes)
    try:
        os.rename(made, target)
    except OSError:  # another worker was first
        shutil.rmtree(made, ignore_errors=True)
    return target


class Index:
    """The laid-out index; keys are probed by the array."""

    def __init__(self, folder: str, shards: int):
        mapped = lambda k, t: np.memmap(f"{folder}/{k}", t, "r") if os.path.getsize(f"{folder}/{k}") else np.zeros(0, t)
        self.shards = shards
        self.bits, self.before, self.prints, self.counts = mapped("bits", np.uint64), mapped("before", np.uint32), mapped("prints", np.uint64), mapped("counts", np.uint8)
        heads, sizes = np.load(f"{folder}/heads.npy"), np.load(f"{folder}/sizes.npy")
        # Shards without a key are unknown to the files.
        self.heads, self.sizes = np.zeros((shards, 4), np.int64), np.zeros((shards, sizes.shape[1]), np.int64)
        self.heads[: len(heads)], self.sizes[: len(sizes)] = heads, sizes

    def find(self, lead: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """The count of each key, 0 of those that are not in the index."""
        shard = shard_of(lead, self.shards)
        out = np.zeros(len(lead), np.int64)
        left, start = np.arange(len(lead)), np.zeros(len(lead), np.int64)
        for level in range(self.sizes.shape[1]):
            left = left[self.sizes[shard[left], level] > 0]
            if not len(left):
                break
            own = shard[left]
            size = self.sizes[own, level]
            bit = start[left] + _at(lead[left], prints[left], level, size)
            word = self.heads[own, 0] + (bit >> 6)
            hit = (self.bits[word] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1
            found = left[hit]
            place = rank(self.bits, self.before, (word[hit] << 6) + (bit[hit] & 63))
            same = self.prints[self.heads[shard[found], 1] + place] == prints[found]
            self._count(out, found[same], place[same], shard)
            start[left] += size
            left = left[~hit]
        return out

    def _count(self, out: np.ndarray, rows: np.ndarray, place: np.ndarray, shard: np.ndarray) -> None:
        _, _, first, width = self.heads[shard[rows]].T
        for w in np.unique(width).tolist():
            some = width == w
            at = (first[some] + place[some] * w)[:, None] + np.arange(w)
            out[rows[some]] = np.ascontiguousarray(self.counts[at]).view(f"<u{w}").ravel()
