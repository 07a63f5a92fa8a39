"""Samples in HDF5 and MAT 7.3 files, found by their metadata alone.

The largest numeric dataset of one or two dimensions is the signal; the longer
side is time.  Superblocks 0 to 3, object headers 1 and 2, symbol tables and compact
links, compact, contiguous and chunked layouts (B-tree of version 1) with deflate,
shuffle and Fletcher-32 are known: what libraries and MATLAB write by default.
Dense groups, newer chunk indexes and other filters are refused.

Contiguous data is a :class:`~.blocks.Block`, of which any part can be read; each
chunk is read as a whole by the task in whose byte range it begins.  Chunks that
were never written are zeros.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np

from ..errors import SignalReadError, UnsupportedFormat
from .blocks import Block, Layout, Piece

SIGNATURE = b"\x89HDF\r\n\x1a\n"
RATE_NAMES = ("sample_rate", "fs", "sr")
_NOWHERE = 0xFFFFFFFFFFFFFFFF


@dataclass(frozen=True)
class Chunk:
    """A chunk at ``address`` (None: never written) of a dataset."""

    address: int | None
    size: int
    mask: int
    origin: tuple[int, int]
    shape: tuple[int, int]  # as stored
    held: tuple[int, int]  # within the dataset
    kind: str
    filters: tuple[tuple[int, tuple[int, ...]], ...]
    along: int  # the axis of time
    name: str

    def read(self, f: BinaryIO, low: int, high: int, start: int = 0, stop: int | None = None, wanted: set[int] | None = None) -> Iterator[Piece]:
        if not low <= (self.address or 0) < high:
            return
        first, n = self.origin[self.along], self.held[self.along]
        a, b = max(0, start - first), n if stop is None else min(n, stop - first)
        channel = self.origin[1 - self.along]
        chosen = [c for c in range(self.held[1 - self.along]) if wanted is None or channel + c in wanted]
        if a >= b or not chosen:
            return
        if self.address is None:
            x = np.zeros(self.held)
        else:
            f.seek(self.address)
            x = np.frombuffer(self._unpacked(f.read(self.size)), self.kind, self.shape[0] * self.shape[1]).reshape(self.shape)
        x = x if self.along else x.T
        for c in chosen:
            yield Piece(channel + c, f"{self.name}_ch{channel + c}", first + a, x[c, a:b].astype(float))

    def _unpacked(self, raw: bytes) -> bytes:
        for k in reversed(range(len(self.filters))):
            if self.mask >> k & 1:
                continue
            number, values = self.filters[k]
            if number == 1:
                raw = zlib.decompress(raw)
            elif number == 2:  # bytes of equal significance stand together
                width = values[0] if values else np.dtype(self.kind).itemsize
                body = np.frombuffer(raw, np.uint8, len(raw) // width * width).reshape(width, -1).T.tobytes()
                raw = body + raw[len(body) :]
            elif number == 3:  # a checksum behind
                raw = raw[:-4]
            else:
                raise UnsupportedFormat(f"HDF5 filter {number}")
        return raw


@dataclass
class Message:
    kind: int
    data: bytes
    at: int  # where it stands in the file
    shared: bool


class Hdf5:
    def __init__(self, f: BinaryIO, size: int):
        self.f = f
        at = 0
        while True:
            if at + 8 > size:
                raise SignalReadError("no HDF5 signature")
            if self._raw(at, 8) == SIGNATURE:
                break
            at = at * 2 or 512
        version = self._raw(at + 8, 1)[0]
        if version < 2:
            self.wide, self.long = self._raw(at + 13, 2)
            place = at + (24 if version == 0 else 28)
            base, root = self._number(place), self._number(place + 5 * self.wide)
        elif version < 4:
            self.wide, self.long = self._raw(at + 9, 2)
            base, root = self._number(at + 12), self._number(at + 12 + 3 * self.wide)
        else:
            raise UnsupportedFormat(f"HDF5 superblock {version}")
        self.base = base
        self.root = self.base + root

    def _raw(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        raw = self.f.read(n)
        if len(raw) < n:
            raise SignalReadError("the file ends within its metadata")
        return raw

    def _number(self, at: int) -> int:
        return int.from_bytes(self._raw(at, self.wide), "little")

    def _address(self, raw: bytes, at: int) -> int | None:
        value = int.from_bytes(raw[at : at + self.wide], "little")
        return None if value == _NOWHERE >> 8 * (8 - self.wide) else self.base + value

    def messages(self, header: int) -> list[Message]:
        head = self._raw(header, 6)
        newer = head[:4] == b"OHDR"
        if newer:
            flags = head[5]
            at = header + 6 + 16 * (flags >> 5 & 1) + 4 * (flags >> 4 & 1)
            width = 1 << (flags & 3)
            blocks = [(at + width, int.from_bytes(self._raw(at, width), "little"))]
        elif head[0] == 1:
            flags = 0
            blocks = [(header + 16, struct.unpack("<I", self._raw(header + 8, 4))[0])]
        else:
            raise SignalReadError("no object header")
        out = []
        while blocks:
            start, n = blocks.pop(0)
            raw, k = self._raw(start, n), 0
            lead = (6 if flags & 4 else 4) if newer else 8
            while k + lead <= n:
                if newer:
                    kind, size, own = raw[k], int.from_bytes(raw[k + 1 : k + 3], "little"), raw[k + 3]
                else:
                    kind, size, own = *struct.unpack_from("<HH", raw, k), raw[k + 4]
                data = raw[k + lead : k + lead + size]
                if kind == 0x10:
                    place, length = self._address(data, 0), int.from_bytes(data[self.wide : self.wide + self.long], "little")
                    blocks.append((place + 4, length - 8) if newer else (place, length))
                elif kind:
                    out.append(Message(kind, data, start + k + lead, bool(own & 2)))
                k += lead + size
        return out

    def links(self, messages: list[Message]) -> Iterator[tuple[str, int]]:
        """Names and object headers of a group's members."""
        for m in messages:
            if m.kind == 0x11:
                heap = self._address(m.data, self.wide)
                names = self._address(self._raw(heap + 8 + 2 * self.long, self.wide), 0)
                yield from self._symbols(self._address(m.data, 0), names)
            elif m.kind == 0x06:
                flags, k = m.data[1], 2
                kind = m.data[k] if flags & 8 else 0
                k += (flags >> 3 & 1) + 8 * (flags >> 2 & 1) + (flags >> 4 & 1)
                width = 1 << (flags & 3)
                n = int.from_bytes(m.data[k : k + width], "little")
                k += width
                if kind == 0:
                    yield m.data[k : k + n].decode(), self._address(m.data, k + n)
            elif m.kind == 0x02 and self._address(m.data, 2 + 8 * (m.data[1] & 1)) is not None:
                raise UnsupportedFormat("HDF5 group with dense links")

    def _symbols(self, node: int, names: int) -> Iterator[tuple[str, int]]:
        entry = 2 * self.wide + 24
        if self._raw(node, 4) == b"SNOD":
            for k in range(struct.unpack("<H", self._raw(node + 6, 2))[0]):
                raw = self._raw(node + 8 + k * entry, entry)
                yield self._text(names + int.from_bytes(raw[: self.wide], "little")), self._address(raw, self.wide)
            return
        for _, child in self._children(node, self.long):
            yield from self._symbols(child, names)

    def _text(self, at: int) -> str:
        out = b""
        while b"\0" not in out:
            self.f.seek(at + len(out))
            more = self.f.read(64)
            if not more:
                break
            out += more
        return out.split(b"\0")[0].decode()

    def _children(self, node: int, key: int) -> Iterator[tuple[bytes, int]]:
        """The keys and children of a B-tree node of version 1."""
        head = self._raw(node, 8)
        if head[:4] != b"TREE":
            raise SignalReadError("no B-tree node")
        n, step = struct.unpack_from("<H", head, 6)[0], key + self.wide
        raw = self._raw(node + 8 + 2 * self.wide, n * step)
        for k in range(n):
            yield raw[k * step : k * step + key], self._address(raw, k * step + key)

    def datasets(self) -> Iterator[tuple[str, list[Message]]]:
        """Every object that has a layout, in the order of names."""
        stack, seen = [("", self.root)], set()
        while stack:
            path, header = stack.pop()
            if header in seen:
                continue
            seen.add(header)
            found = self.messages(header)
            if any(m.kind == 0x08 for m in found):
                yield path, found
            below = sorted(self.links(found), reverse=True)
            stack += [(f"{path}/{name}" if path else name, at) for name, at in below if at is not None]

    def dimensions(self, raw: bytes) -> tuple[int, ...]:
        at = 8 if raw[0] == 1 else 4
        return tuple(int.from_bytes(raw[at + k * self.long : at + (k + 1) * self.long], "little") for k in range(raw[1]))

    def scalar(self, kind: str | None, space: bytes, data: bytes) -> float | None:
        if kind is None or int(np.prod(self.dimensions(space))) != 1 or len(data) < np.dtype(kind).itemsize:
            return None
        return float(np.frombuffer(data, kind, 1)[0])

    def attribute(self, m: Message) -> tuple[str, float | None]:
        """Name and value, if that is one number."""
        version, sizes = m.data[0], struct.unpack_from("<HHH", m.data, 2)
        at, parts = 9 if version == 3 else 8, []
        for n in sizes:
            parts.append(m.data[at : at + n])
            at += n + (-n % 8 if version == 1 else 0)
        return parts[0].rstrip(b"\0").decode(), self.scalar(number_kind(parts[1]), parts[2], m.data[at:])

    def chunks(self, node: int, rank: int) -> Iterator[tuple[int, int, tuple[int, ...], int]]:
        """Size, filter mask, origin and address of every chunk."""
        deep = self._raw(node, 6)[5]
        for key, child in self._children(node, 8 + 8 * (rank + 1)):
            if deep:
                yield from self.chunks(child, rank)
            else:
                size, mask = struct.unpack_from("<II", key)
                yield size, mask, struct.unpack_from(f"<{rank}Q", key, 8), child


def number_kind(raw: bytes) -> str | None:
    """The numpy type of a datatype message, None if that is no plain number."""
    kind, bits, size = raw[0] & 15, raw[1], struct.unpack_from("<I", raw, 4)[0]
    order = ">" if bits & 1 else "<"
    if kind == 0 and size in (1, 2, 4, 8):
        return f"{order}{'i' if bits & 8 else 'u'}{size}"
    if kind == 1 and size in (2, 4, 8) and not bits & 0x40:
        return f"{order}f{size}"
    return None


def _filters(raw: bytes) -> tuple[tuple[int, tuple[int, ...]], ...]:
    version, n = raw[0], raw[1]
    at, out = 8 if version == 1 else 2, []
    for _ in range(n):
        number = struct.unpack_from("<H", raw, at)[0]
        named = version == 1 or number >= 256
        length = struct.unpack_from("<H", raw, at + 2)[0] if named else 0
        at += 4 if named else 2
        count = struct.unpack_from("<H", raw, at + 2)[0]
        at += 4 + length + (-length % 8 if version == 1 else 0)
        out.append((number, struct.unpack_from(f"<{count}I", raw, at)))
        at += 4 * count + (4 * (count % 2) if version == 1 else 0)
    return tuple(out)


def hdf5_layout(f: BinaryIO, size: int) -> Layout:
    f.seek(0)
    if size >= 128 and f.read(128)[124:128] in (b"\0\x01IM", b"\x01\0MI"):
        raise UnsupportedFormat("MAT files of level 5 are read whole, by read_signals")
    h = Hdf5(f, size)
    best, rate, most = None, None, 0
    for name, messages in h.datasets():
        by = {m.kind: m for m in messages}
        if 0x01 not in by or 0x03 not in by or by[0x03].shared:
            continue
        shape, kind = h.dimensions(by[0x01].data), number_kind(by[0x03].data)
        if kind is None or len(shape) > 2:
            continue
        values = int(np.prod(shape))
        if values == 1 and name.rsplit("/", 1)[-1] in RATE_NAMES:
            rate = _first_number(h, by, kind) or rate
        if len(shape) and values > most:
            most, best = values, (name, messages, shape, kind)
    if best is None:
        raise SignalReadError("no numeric dataset")
    name, messages, shape, kind = best
    own = dict(h.attribute(m) for m in messages if m.kind == 0x0C)
    rate = next((own[k] for k in RATE_NAMES if own.get(k)), rate)
    return Layout(_blocks(h, name, {m.kind: m for m in messages}, shape, kind), rate, "m/s²")


def _first_number(h: Hdf5, by: dict[int, Message], kind: str) -> float | None:
    for block in _blocks(h, "", by, (1,), kind):
        for piece in block.read(h.f, 0, 1 << 63):
            return float(piece.values[0])
    return None


def _blocks(h: Hdf5, name: str, by: dict[int, Message], shape: tuple[int, ...], kind: str) -> list:
    rows, columns = (1, *shape) if len(shape) == 1 else shape
    along = 0 if rows > columns and len(shape) == 2 else 1
    layout, width = by[0x08].data, np.dtype(kind).itemsize
    version, form = layout[0], layout[1]
    if version not in (3, 4) or version == 4 and form > 1:
        raise UnsupportedFormat(f"HDF5 layout {version}.{form}")
    if form < 2:
        at = by[0x08].at + 4 if form == 0 else h._address(layout, 2)
        if at is None:
            return list(_missing(h, name, (rows, columns), (rows, columns), set(), kind, along))
        if along == 0:
            return [Block(at, columns * width, rows, 0, kind, tuple((c, f"{name}_ch{c}", c * width) for c in range(columns)))]
        return [Block(at + r * columns * width, width, columns, 0, kind, ((r, f"{name}_ch{r}", 0),)) for r in range(rows)]
    rank = layout[2] - 1
    tree = h._address(layout, 3)
    sides = struct.unpack_from(f"<{rank}I", layout, 3 + h.wide)
    sides = (1, *sides) if rank == 1 else sides
    filters = _filters(by[0x0B].data) if 0x0B in by else ()
    out, seen = [], set()
    for size, mask, origin, address in h.chunks(tree, rank) if tree is not None else ():
        origin = (0, *origin) if rank == 1 else origin
        held = tuple(min(s, n - o) for s, n, o in zip(sides, (rows, columns), origin, strict=True))
        if min(held) > 0:
            seen.add(origin)
            out.append(Chunk(address, size, mask, origin, sides, held, kind, filters, along, name))
    return out + list(_missing(h, name, (rows, columns), sides, seen, kind, along))


def _missing(h: Hdf5, name: str, shape: tuple[int, int], sides: tuple[int, int], seen: set, kind: str, along: int) -> Iterator[Chunk]:
    if len(seen) == -(-shape[0] // sides[0]) * -(-shape[1] // sides[1]):
        return
    for r in range(0, shape[0], sides[0]):
        for c in range(0, shape[1], sides[1]):
            if (r, c) not in seen:
                held = (min(sides[0], shape[0] - r), min(sides[1], shape[1] - c))
                yield Chunk(None, 0, 0, (r, c), sides, held, kind, (), along, name)
