"""HDF5 files byte by byte, by the published description of the format's first version."""

import struct
import zlib

import numpy as np

UNDEFINED = (1 << 64) - 1


class Writer:
    def __init__(self, base=0):
        self.base = base
        self.out = bytearray(96)

    def put(self, data):
        at = len(self.out)
        self.out += data + b"\0" * (-len(data) % 8)
        return at

    def header(self, messages, split=False):
        """An object header; with split, its last messages are in a continuation."""
        pack = lambda ms: b"".join(struct.pack("<HHB3x", kind, len(body) + -len(body) % 8, 0) + body + b"\0" * (-len(body) % 8) for kind, body in ms)
        first, rest = (messages[:1], messages[1:]) if split else (messages, [])
        if rest:
            more = pack(rest)
            at = self.put(more)
            first = [*first, (0x10, struct.pack("<QQ", at, len(more)))]
        body = pack(first)
        return self.put(struct.pack("<BBHII4x", 1, 0, len(messages) + bool(rest), 1, len(body)) + body)

    def tree(self, kind, rank, entries, level=0):
        """entries: (key, child); the last key closes."""
        keys = b"".join(key + struct.pack("<Q", child) for key, child in entries)
        last = b"\0" * (8 if kind == 0 else 8 + 8 * (rank + 1))
        return self.put(b"TREE" + struct.pack("<BBHQQ", kind, level, len(entries), UNDEFINED, UNDEFINED) + keys + last)

    def group(self, members):
        names, offsets = b"\0" * 8, {}
        for name in members:
            offsets[name] = len(names)
            raw = name.encode() + b"\0"
            names += raw + b"\0" * (-len(raw) % 8)
        data = self.put(names)
        heap = self.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), UNDEFINED, data))
        leaves = []
        found = sorted(members)
        for k in range(0, len(found), 3):  # several nodes, under a tree of two levels
            own = b"".join(struct.pack("<QQI4x16x", offsets[n], members[n], 0) for n in found[k : k + 3])
            node = self.put(b"SNOD" + struct.pack("<BxH", 1, len(found[k : k + 3])) + own)
            leaves.append((struct.pack("<Q", 0), self.tree(0, 0, [(struct.pack("<Q", 0), node)])))
        return self.header([(0x11, struct.pack("<QQ", self.tree(0, 0, leaves, level=1), heap))])

    def dataset(self, x, chunk=None, filters=(), compact=False, space=1, split=False, skip=()):
        x = np.asarray(x)
        if space == 1:
            shape = struct.pack("<BBB5x", 1, x.ndim, 0) + struct.pack(f"<{x.ndim}Q", *x.shape)
        else:
            shape = struct.pack("<BBBB", 2, x.ndim, 0, 1) + struct.pack(f"<{x.ndim}Q", *x.shape)
        order = int(x.dtype.byteorder == ">")
        if x.dtype.kind == "f":
            kind = struct.pack("<BBBBI", 0x11, 0x20 | order, x.dtype.itemsize * 8 - 1, 0, x.dtype.itemsize) + b"\0" * 12
        elif x.dtype.kind in "iu":
            kind = struct.pack("<BBBBI", 0x10, order | 8 * (x.dtype.kind == "i"), 0, 0, x.dtype.itemsize) + b"\0" * 4
        else:
            kind = struct.pack("<BBBBI", 0x13, 1, 0, 0, x.dtype.itemsize)
        messages = [(0x01, shape), (0x05, b"\2\2\1\0"), (0x03, kind)]
        raw = x.tobytes()
        if compact:
            messages.append((0x08, struct.pack("<BBH", 3, 0, len(raw)) + raw))
        elif chunk is None:
            messages.append((0x08, struct.pack("<BBQQ", 3, 1, self.put(raw), len(raw))))
        else:
            entries = []
            for k, at in enumerate(np.ndindex(*(-(-n // c) for n, c in zip(x.shape, chunk, strict=True)))):
                begin = [a * c for a, c in zip(at, chunk, strict=True)]
                if k in skip:
                    continue
                part = np.zeros(chunk, dtype=x.dtype)
                own = x[tuple(slice(b, b + c) for b, c in zip(begin, chunk, strict=True))]
                part[tuple(slice(0, n) for n in own.shape)] = own
                data, mask = part.tobytes(), 0
                for j, f in enumerate(filters):
                    if f == 2:
                        data = np.frombuffer(data, np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()
                    elif f == 1 and k % 3 == 2:
                        mask |= 1 << j  # a chunk that would not get smaller
                    elif f == 1:
                        data = zlib.compress(data)
                    else:
                        data += b"sum!"
                key = struct.pack("<II", len(data), mask) + struct.pack(f"<{x.ndim + 1}Q", *begin, 0)
                entries.append((key, self.put(data)))
            nodes = [(entries[k][0], self.tree(1, x.ndim, entries[k : k + 4])) for k in range(0, len(entries), 4)]
            top = self.tree(1, x.ndim, nodes, level=1)
            messages.append((0x08, struct.pack("<BBBQ", 3, 2, x.ndim + 1, top) + struct.pack(f"<{x.ndim + 1}I", *chunk, x.dtype.itemsize)))
            if filters:
                each = b"".join(struct.pack("<HHHH", f, 8, 0, n) + b"filter\0\0" + b"\0" * (4 * n + 4 * (n % 2)) for f, n in ((f, {1: 1, 2: 1, 3: 0}[f]) for f in filters))
                messages.append((0x0B, struct.pack("<BB6x", 1, len(filters)) + each))
        return self.header(messages, split)

    def strings(self, values):
        """A dataset of strings of any length, which are in a heap of the file."""
        body = b"".join(struct.pack("<HH4xQ", k, 1, len(v)) + v + b"\0" * (-len(v) % 8) for k, v in enumerate(values, 1))
        heap = self.put(b"GCOL" + struct.pack("<B3xQ", 1, len(body) + 16) + body)
        raw = b"".join(struct.pack("<IQI", len(v), heap, k) for k, v in enumerate(values, 1))
        shape = struct.pack("<BBB5xQ", 1, 1, 0, len(values))
        kind = struct.pack("<BBBBI", 0x19, 1, 0, 0, 16) + b"\0" * 8
        return self.header([(0x01, shape), (0x03, kind), (0x08, struct.pack("<BBQQ", 3, 1, self.put(raw), len(raw)))])

    def close(self, members):
        root = self.group(members)
        start = b"\x89HDF\r\n\x1a\n" + bytes([0, 0, 0, 0, 0, 8, 8, 0]) + struct.pack("<HHI", 4, 16, 0) + struct.pack("<QQQQ", 0, UNDEFINED, len(self.out), UNDEFINED) + struct.pack("<QQI4x16x", 0, root, 0)
        self.out[: len(start)] = start
        return bytes(self.out)
