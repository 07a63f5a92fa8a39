"""Where samples lie in a file: what a reader of byte ranges needs.

A format is walked by its headers alone, seeking over the samples.  A
:class:`Block` is a run of frames of equal width, in which each channel's value has
its place; any part of it can be read by itself.  A :class:`Packed` block (a
compressed chunk) is read as a whole.  Either belongs to the byte range in which a
frame, or the chunk, begins.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np

from ..errors import SignalReadError

#: Frames that are read at once.
FRAMES = 1 << 16


@dataclass(frozen=True)
class Piece:
    """Consecutive samples of one channel."""

    channel: int
    name: str
    first: int
    values: np.ndarray


@dataclass(frozen=True)
class Block:
    offset: int
    stride: int
    count: int
    first: int  # the number of the first frame's samples
    kind: str  # a numpy type, or i3 for 24 bits
    channels: tuple[tuple[int, str, int], ...]  # number, name, place in the frame
    scale: float = 1.0
    shift: float = 0.0

    def within(self, low: int, high: int, start: int, stop: int | None) -> tuple[int, int]:
        """The frames that begin in bytes [low, high) and are wanted by number."""
        a = max(0, -(-(low - self.offset) // self.stride), start - self.first)
        b = min(self.count, -(-(high - self.offset) // self.stride), self.count if stop is None else stop - self.first)
        return a, b

    def read(self, f: BinaryIO, low: int, high: int, start: int = 0, stop: int | None = None, wanted: set[int] | None = None) -> Iterator[Piece]:
        a, b = self.within(low, high, start, stop)
        chosen = [c for c in self.channels if wanted is None or c[0] in wanted]
        if not chosen or a >= b:
            return
        width = 3 if self.kind == "i3" else np.dtype(self.kind).itemsize
        end = max(c[2] for c in chosen) + width
        f.seek(self.offset + a * self.stride)
        for k in range(a, b, FRAMES):
            n = min(FRAMES, b - k)
            raw = f.read(n * self.stride if k + n < b else (n - 1) * self.stride + end)
            if len(raw) < (n - 1) * self.stride + end:
                n = max(0, (len(raw) - end) // self.stride + 1)  # a file that was cut off
                if not n:
                    return
            frames = np.frombuffer(raw.ljust(n * self.stride, b"\0")[: n * self.stride], np.uint8).reshape(n, self.stride)
            for number, name, at in chosen:
                yield Piece(number, name, self.first + k, numbers(frames[:, at : at + width], self.kind) * self.scale + self.shift)


def numbers(raw: np.ndarray, kind: str) -> np.ndarray:
    """Rows of bytes as floats."""
    if kind == "i3":
        b = raw.astype(np.int32)
        return (((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000).astype(float)
    return np.ascontiguousarray(raw).view(kind).ravel().astype(float)


@dataclass(frozen=True)
class Layout:
    """A file's blocks, in order, with what holds for all of it."""

    blocks: list
    rate: float | None
    unit: str


def wav_layout(f: BinaryIO, size: int) -> Layout:
    """RIFF and RF64 (sizes beyond 4 GB in a ds64 chunk)."""
    head = f.read(12)
    if head[:4] not in (b"RIFF", b"RF64") or head[8:12] != b"WAVE":
        raise SignalReadError("no RIFF/WAVE header")
    at, form, data, wide = 12, None, None, None
    while at + 8 <= size and data is None:
        f.seek(at)
        name, length = struct.unpack("<4sI", f.read(8))
        if name == b"ds64":
            wide = struct.unpack("<QQ", f.read(16))[1]
        elif name == b"fmt ":
            form = f.read(min(length, 40))
        elif name == b"data":
            length = (wide or size) if length == 0xFFFFFFFF else length
            data = (at + 8, min(length, size - at - 8))
        at += 8 + length + length % 2
    if form is None:
        raise SignalReadError("no format chunk")
    kind, channels, rate, _, align, bits = struct.unpack("<HHIIHH", form[:16])
    if kind == 0xFFFE and len(form) >= 26:  # extensible: the kind stands in the subformat
        kind = struct.unpack("<H", form[24:26])[0]
    if data is None:
        return Layout([], float(rate), "Pa")
    width = bits // 8
    number, scale, shift = (f"<f{width}", 1.0, 0.0) if kind == 3 else ("u1", 1 / 128, -1.0) if bits == 8 else ("i3" if bits == 24 else f"<i{width}", 2.0 ** (1 - bits), 0.0)
    places = tuple((c, f"ch_{c}", c * width) for c in range(channels))
    return Layout([Block(data[0], align, data[1] // align, 0, number, places, scale, shift)], float(rate), "Pa")


# TDMS codes of plain numbers.
TDMS_TYPES = {1: "i1", 2: "i2", 3: "i4", 4: "i8", 5: "u1", 6: "u2", 7: "u4", 8: "u8", 9: "f4", 10: "f8"}


class _Meta:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, form: str):
        out = struct.unpack_from("<" + form, self.raw, self.at)
        self.at += struct.calcsize("<" + form)
        return out[0] if len(out) == 1 else out

    def text(self) -> str:
        n = self.take("I")
        self.at += n
        return self.raw[self.at - n : self.at].decode()


def tdms_layout(f: BinaryIO, size: int) -> Layout:
    """Plain numbers, contiguous or interleaved, in any number of segments and chunks;
    of several rates the last."""
    at, last, active, rate = 0, {}, [], None
    order: dict[str, int] = {}
    seen: dict[str, int] = {}
    blocks: list[Block] = []
    while at + 28 <= size:
        f.seek(at)
        tag, toc, _, length, meta = struct.unpack("<4sIIQQ", f.read(28))
        if tag != b"TDSm":
            break
        if length == 0xFFFFFFFFFFFFFFFF:  # a segment that was not closed
            length = size - at - 28
        if toc & 2:
            m = _Meta(f.read(meta))
            active = [] if toc & 4 else active
            for _ in range(m.take("I")):
                path, index = m.text(), m.take("I")
                if index not in (0xFFFFFFFF, 0):
                    kind, _, count = m.take("IIQ")
                    if kind == 0x20:
                        m.take("Q")
                    last[path] = (kind, count)
                if index != 0xFFFFFFFF and path not in active:
                    active.append(path)
                for _ in range(m.take("I")):
                    key, kind = m.text(), m.take("I")
                    if kind == 0x20:
                        m.text()
                        continue
                    width = {0x21: 1, 0x44: 16}.get(kind) or np.dtype(TDMS_TYPES.get(kind, "u8")).itemsize
                    value = m.raw[m.at : m.at + width]
                    m.at += width
                    if key == "wf_increment" and kind == 10 and struct.unpack("<d", value)[0]:
                        rate = 1 / struct.unpack("<d", value)[0]
        if toc & 8:
            held = [(p, "<" + TDMS_TYPES[last[p][0]], last[p][1]) for p in active if last.get(p, (0,))[0] in TDMS_TYPES]
            for p, *_ in held:
                order.setdefault(p, len(order))
            place, end = at + 28 + meta, min(at + 28 + length, size)
            chunk = sum(np.dtype(k).itemsize * n for _, k, n in held)
            while chunk and place + chunk <= end:
                if toc & 32:
                    stride, n = sum(np.dtype(k).itemsize for _, k, _ in held), held[0][2]
                    shift = 0
                    for p, k, _ in held:  # of one first sample if lengths never differed
                        blocks.append(Block(place, stride, n, seen.get(p, 0), k, ((order[p], _leaf(p), shift),)))
                        shift += np.dtype(k).itemsize
                        seen[p] = seen.get(p, 0) + n
                else:
                    start = place
                    for p, k, n in held:
                        blocks.append(Block(start, np.dtype(k).itemsize, n, seen.get(p, 0), k, ((order[p], _leaf(p), 0),)))
                        start += np.dtype(k).itemsize * n
                        seen[p] = seen.get(p, 0) + n
                place += chunk
        at += 28 + length
    if not blocks:
        raise SignalReadError("no channel data")
    return Layout(blocks, rate, "")


def _leaf(path: str) -> str:
    return path.rsplit("/", 1)[-1].strip("'")
