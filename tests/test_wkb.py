"""Bulk geometry decoding against a reader that takes one value after the other."""

from __future__ import annotations

import random
import struct

import pyarrow as pa

from gridlake.functions.wkb import KINDS, decode


def read_one(data: bytes):
    """(kind, points, lines, rings) of one value, or None where the bytes end too soon or mean nothing."""
    at, points, lines, rings = 0, [], [], []

    def number(order, code):
        nonlocal at
        out = struct.unpack_from(order + code, data, at)[0]
        at += struct.calcsize(code)
        return out

    def chain(order, dims, count):
        return [tuple(number(order, "d") for _ in range(dims))[:2] for _ in range(count)]

    def shape():
        nonlocal at
        order = "<" if number("<", "B") == 1 else ">"
        code = number(order, "I")
        flags = code >> 28
        if flags & 2:
            number(order, "I")
        code &= 0x0FFFFFFF
        dims = 2 + (flags >> 3 & 1) + (flags >> 2 & 1) + {0: 0, 1: 1, 2: 1, 3: 2}[code // 1000]
        kind = code % 1000
        KINDS[kind]
        if kind == 1:
            points.append(chain(order, dims, 1))
        elif kind == 2:
            lines.append(chain(order, dims, number(order, "I")))
        elif kind == 3:
            rings.extend(chain(order, dims, number(order, "I")) for _ in range(number(order, "I")))
        else:
            for _ in range(number(order, "I")):
                shape()
        return KINDS[kind]

    try:
        return shape(), points, lines, rings
    except (struct.error, KeyError):
        return None


def expected(data):
    none = (None,) * 4
    if data is None:
        return (None, True, False, False, 0, *none, None, None)
    found = read_one(data)
    if found is None:
        return ("Unknown", False, False, True, 0, *none, None, None)
    kind, points, lines, rings = found
    every = [v for c in points + lines + rings for v in c if v == v and v[0] == v[0] and v[1] == v[1]]
    if not every:
        return (kind, False, True, False, 0, *none, None, None)
    broken = any(len(c) < 2 or len(set(c)) == 1 for c in lines) or any(len(c) < 4 or c[0] != c[-1] for c in rings)
    xs, ys = zip(*every, strict=True)
    ends = [(*c[0], *c[-1]) for c in points + lines if c]
    edges = [(*a, *b) for c in lines + rings for a, b in zip(c, c[1:], strict=False)]
    return (kind, False, False, broken, len(every), min(xs), min(ys), max(xs), max(ys), ends, edges)


def rows(values):
    out = []
    for r in decode(pa.array(values, pa.binary())).to_pylist():
        r = list(r.values())
        out.append((*r[:9], *[None if x is None else [tuple(e.values()) for e in x] for x in r[9:]]))
    return out


class Writer:
    def __init__(self, rng):
        self.rng = rng

    def geometry(self, kind, depth=0):
        rng = self.rng
        order = rng.choice("<>")
        extra = rng.choice([(0, 0, 2), (0, 0, 2), (0x80000000, 0, 3), (0xC0000000, 0, 4), (0, 1000, 3), (0, 2000, 3), (0, 3000, 4)])
        srid = rng.random() < 0.2
        head = struct.pack(order + "BI", order == "<", kind + extra[1] | extra[0] | (0x20000000 if srid else 0))
        head += struct.pack(order + "I", 4674) if srid else b""
        count = lambda n: struct.pack(order + "I", n)
        vertex = lambda: struct.pack(order + "d" * extra[2], *[rng.randint(0, 3) for _ in range(extra[2])])
        if kind == 1:
            return head + (struct.pack(order + "d" * extra[2], *[float("nan")] * extra[2]) if rng.random() < 0.2 else vertex())
        if kind == 2:
            n = rng.randint(0, 4)
            return head + count(n) + b"".join(vertex() for _ in range(n))
        if kind == 3:
            n = rng.randint(0, 3)
            out = head + count(n)
            for _ in range(n):
                ring = [vertex() for _ in range(rng.randint(0, 4))]
                ring += ring[:1]
                out += count(len(ring)) + b"".join(ring)
            return out
        inner = {4: 1, 5: 2, 6: 3}.get(kind)
        members = [self.geometry(inner or rng.randint(1, 3 if depth > 1 else 7), depth + 1) for _ in range(rng.randint(0, 3))]
        return head + count(len(members)) + b"".join(members)


def test_random_geometries():
    rng = random.Random(17)
    writer = Writer(rng)
    values = [writer.geometry(rng.randint(1, 7)) for _ in range(2500)]
    values += [v[: rng.randint(0, len(v))] for v in values[:400]] + [None, b"", b"\x01", struct.pack("<BI", 1, 9), struct.pack("<BII", 1, 7, 2**32 - 1)]
    rng.shuffle(values)
    # as text: empty points hold numbers that differ from themselves
    assert list(map(repr, rows(values))) == [repr(expected(v)) for v in values]


def test_slices_and_nothing():
    writer = Writer(random.Random(2))
    values = [writer.geometry(k) for k in (1, 2, 3, 5)] + [None]
    part = decode(pa.array(values, pa.binary()).slice(1, 3))
    assert [r["kind"] for r in part.to_pylist()] == ["LineString", "Polygon", "MultiLineString"]
    assert len(decode(pa.array([], pa.binary()))) == 0 and rows([None, None]) == [expected(None)] * 2


def test_many_parts_in_one_value():
    part = struct.pack("<BII4d", 1, 2, 2, 0, 0, 1, 1)
    data = struct.pack("<BII", 1, 5, 3000) + part * 3000
    shape = decode(pa.array([data, None], pa.binary())).to_pylist()[0]
    assert shape["n_points"] == 6000 and len(shape["parts"]) == 3000 and not shape["is_broken"]
