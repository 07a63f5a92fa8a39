"""HDF5 files by hand: old (symbol tables, headers of version 1) and new (link
messages, headers of version 2), with contiguous, compact and chunked data."""

import struct
import zlib

import numpy as np

NONE = 0xFFFFFFFFFFFFFFFF


class File:
    def __init__(self, base=0):
        self.raw, self.base = bytearray(96), base

    def put(self, data):
        self.raw += b"\0" * (-len(self.raw) % 8)
        at = len(self.raw)
        self.raw += data
        return at

    def finish(self, root, new=False):
        sig = b"\x89HDF\r\n\x1a\n"
        if new:
            head = sig + bytes([2, 8, 8, 0]) + struct.pack("<QQQQI", self.base, NONE, len(self.raw), root, 0)
        else:
            head = sig + bytes([0, 0, 0, 0, 0, 8, 8, 0]) + struct.pack("<HHIQQQQQQII16x", 4, 16, 0, self.base, NONE, len(self.raw), NONE, 0, root, 0, 0)
        self.raw[: len(head)] = head
        return bytes(self.base) + bytes(self.raw)


def datatype(dtype):
    dtype = np.dtype(dtype)
    big = dtype.byteorder == ">"
    if dtype.kind == "f":
        return struct.pack("<BBBBI", 0x11, 0x20 | big, 8 * dtype.itemsize - 1, 0, dtype.itemsize) + bytes(12)
    return struct.pack("<BBBBI", 0x10, (8 if dtype.kind == "i" else 0) | big, 0, 0, dtype.itemsize) + bytes(4)


def space(shape):
    return struct.pack("<BBBxxxxx", 1, len(shape), 0) + b"".join(struct.pack("<Q", n) for n in shape)


def attribute(name, value):
    name, kind, where, data = name.encode() + b"\0", datatype("<f8"), space(()), struct.pack("<d", value)
    pad = lambda b: b + b"\0" * (-len(b) % 8)
    return 0x0C, struct.pack("<BBHHH", 1, 0, len(name), len(kind), len(where)) + pad(name) + pad(kind) + pad(where) + data


def header(f, messages, new=False, split=False):
    """An object header; with ``split`` its last messages stand in a continuation."""
    if new:
        pack = lambda ms: b"".join(struct.pack("<BHB", k, len(d), 0) + d for k, d in ms)
        if split:
            more = f.put(b"OCHK" + pack(messages[1:]) + bytes(4))
            messages = [messages[0], (0x10, struct.pack("<QQ", more, len(pack(messages[1:])) + 8))]
        body = pack(messages)
        return f.put(b"OHDR" + bytes([2, 2]) + struct.pack("<I", len(body)) + body + bytes(4))

    def pack(ms):
        return b"".join(struct.pack("<HHB3x", k, len(d) + -len(d) % 8, 0) + d + b"\0" * (-len(d) % 8) for k, d in ms)

    if split:
        rest = pack(messages[1:])
        messages = [messages[0], (0x10, struct.pack("<QQ", f.put(rest), len(rest)))]
    body = pack(messages)
    return f.put(struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body)


def group(f, members, new=False):
    if new:
        links = [(6, struct.pack("<BBB", 1, 0, len(n)) + n.encode() + struct.pack("<Q", at)) for n, at in members.items()]
        return header(f, [(2, struct.pack("<BBQQ", 0, 0, NONE, NONE)), *links], True)
    names, heap = {}, bytearray(8)
    for n in members:
        names[n] = len(heap)
        heap += n.encode() + b"\0" * (8 - len(n) % 8)
    heap_at = f.put(b"HEAP" + bytes(4) + struct.pack("<QQQ", len(heap), NONE, f.put(heap)))
    nodes = []
    ordered = sorted(members)
    for a in range(0, len(ordered), 2):  # two symbols a node
        some = ordered[a : a + 2]
        nodes.append(f.put(b"SNOD" + struct.pack("<BxH", 1, len(some)) + b"".join(struct.pack("<QQII16x", names[n], members[n], 0, 0) for n in some)))
    tree = f.put(b"TREE" + struct.pack("<BBHQQ", 0, 0, len(nodes), NONE, NONE) + b"".join(struct.pack("<QQ", 0, n) for n in nodes) + struct.pack("<Q", 0))
    return header(f, [(0x11, struct.pack("<QQ", tree, heap_at))])


def dataset(f, x, chunk=None, filters=(), attributes=(), compact=False, new=False, split=False, skip=(), deep=False):
    x = np.asarray(x)
    if chunk:
        entries = []
        for at in np.ndindex(*[-(-n // c) for n, c in zip(x.shape, chunk)]):
            origin = [a * c for a, c in zip(at, chunk)]
            if tuple(origin) in skip:
                continue
            whole = np.zeros(chunk, x.dtype)
            part = x[tuple(slice(o, o + c) for o, c in zip(origin, chunk))]
            whole[tuple(slice(0, n) for n in part.shape)] = part
            data = whole.tobytes()
            for name in filters:
                if name == "shuffle":
                    data = np.frombuffer(data, np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()
                elif name == "deflate":
                    data = zlib.compress(data)
                else:
                    data += b"sum!"
            entries.append((len(data), origin, f.put(data)))
        key = lambda size, origin: struct.pack("<II", size, 0) + b"".join(struct.pack("<Q", o) for o in [*origin, 0])

        def node(level, items):
            last = key(0, [n + 1 for n in x.shape])
            return f.put(b"TREE" + struct.pack("<BBHQQ", 1, level, len(items), NONE, NONE) + b"".join(key(s, o) + struct.pack("<Q", a) for s, o, a in items) + last)

        if deep:
            half = len(entries) // 2
            entries = [(s[0][0], s[0][1], node(0, s)) for s in (entries[:half], entries[half:])]
        tree = node(1 if deep else 0, entries)
        layout = struct.pack("<BBBQ", 3, 2, x.ndim + 1, tree) + b"".join(struct.pack("<I", c) for c in [*chunk, x.dtype.itemsize])
    elif compact:
        layout = struct.pack("<BBH", 3, 0, x.nbytes) + x.tobytes()
    else:
        layout = struct.pack("<BBQQ", 3, 1, f.put(x.tobytes()), x.nbytes)
    messages = [(1, space(x.shape)), (3, datatype(x.dtype)), (8, layout)]
    if filters:
        ids = {"deflate": (1, [6]), "shuffle": (2, [x.dtype.itemsize]), "sum": (3, [])}
        body = b"".join(struct.pack("<HHHH", ids[n][0], 0, 0, len(ids[n][1])) + b"".join(struct.pack("<I", v) for v in ids[n][1]) + bytes(4 * (len(ids[n][1]) % 2)) for n in filters)
        messages.append((0x0B, struct.pack("<BB6x", 1, len(filters)) + body))
    return header(f, messages + [attribute(k, v) for k, v in attributes], new, split)
