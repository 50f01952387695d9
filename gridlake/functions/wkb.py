"""Bulk decoding of WKB columns straight from Arrow buffers.

All values of a batch are read in step: every value has a cursor into the batch's byte buffer, and each step
reads one header or one chain of vertices of every value that is not finished. Vertices are gathered as doubles in one
piece at the end. No object is made per geometry; the number of steps is that of the parts of the batch's most divided value.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Geometry type codes and their names.
KINDS = {
    1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString",
    6: "MultiPolygon", 7: "GeometryCollection",
}
POINT, LINE, RING = 0, 1, 2
SIDE = ("x1", "y1", "x2", "y2")
_NAMES = np.array(["Unknown", *KINDS.values()], dtype=object)


class _Buffer:
    """Reads of many unaligned numbers at once."""

    def __init__(self, values: pa.BinaryArray):
        offsets = np.frombuffer(values.buffers()[1], np.int64 if pa.types.is_large_binary(values.type) else np.int32)
        window = offsets[values.offset : values.offset + len(values) + 1].astype(np.int64)
        data = values.buffers()[2]
        self.bytes = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        self.start, self.end = window[:-1], window[1:]

    def read(self, at: np.ndarray, kind: str, big: np.ndarray) -> np.ndarray:
        """One number at each place, big-endian where ``big``."""
        size = np.dtype(kind).itemsize
        raw = np.ascontiguousarray(self.bytes[at[:, None] + np.arange(size)])
        out = raw.view(f"<{kind}").ravel()
        if big.any():
            out[big] = raw.view(f">{kind}").ravel()[big]
        return out


def _chains(buffer: _Buffer, filled: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Type code per value, whether it is unreadable, and the chains of vertices of all values."""
    n = len(filled)
    at, end = buffer.start.copy(), buffer.end
    members = np.where(filled, 1, 0).astype(np.int64)  # geometries still to read
    rings = np.zeros(n, np.int64)  # rings of the current polygon still to read
    dims, big = np.full(n, 2, np.int64), np.zeros(n, bool)
    top, bad = np.full(n, -1, np.int64), np.zeros(n, bool)
    found: list[tuple[np.ndarray, ...]] = []

    def keep(rows: np.ndarray, need: np.ndarray | int) -> np.ndarray:
        """Rows with enough bytes left; the others are unreadable."""
        fits = at[rows] + need <= end[rows]
        bad[rows[~fits]] = True
        return rows[fits]

    def chain(rows: np.ndarray, kind: int, counted: bool) -> None:
        if counted:
            rows = keep(rows, 4)
            size = buffer.read(at[rows], "u4", big[rows]).astype(np.int64)
            at[rows] += 4
        else:
            size = np.ones(len(rows), np.int64)
        fits = at[rows] + size * dims[rows] * 8 <= end[rows]
        bad[rows[~fits]] = True
        rows, size = rows[fits], size[fits]
        found.append((rows, np.full(len(rows), kind), at[rows].copy(), size, dims[rows].copy(), big[rows].copy()))
        at[rows] += size * dims[rows] * 8

    while True:
        active = np.flatnonzero(((members > 0) | (rings > 0)) & ~bad)
        if not len(active):
            break
        inside = rings[active] > 0
        outline, fresh = active[inside], keep(active[~inside], 5)
        if len(outline):
            chain(outline, RING, True)
            rings[outline] -= 1
        if not len(fresh):
            continue
        big[fresh] = buffer.bytes[at[fresh]] != 1
        code = buffer.read(at[fresh] + 1, "u4", big[fresh]).astype(np.int64)
        at[fresh] += 5
        members[fresh] -= 1
        # both ways of marking more dimensions: flags, and thousands of the code
        at[fresh[(code & 0x20000000) != 0]] += 4
        plain = code & 0x0FFFFFFF
        dims[fresh] = 2 + ((code & 0x80000000) != 0) + ((code & 0x40000000) != 0) + np.array([0, 1, 1, 2])[np.minimum(plain // 1000, 3)]
        code = plain % 1000
        wrong = (plain // 1000 > 3) | (code < 1) | (code > 7)
        bad[fresh[wrong]] = True
        first = top[fresh] < 0
        top[fresh[first]] = code[first]
        chain(fresh[~wrong & (code == 1)], POINT, False)
        chain(fresh[~wrong & (code == 2)], LINE, True)
        for left, several in ((rings, fresh[~wrong & (code == 3)]), (members, fresh[~wrong & (code > 3)])):
            several = keep(several, 4)
            left[several] += buffer.read(at[several], "u4", big[several]).astype(np.int64)
            at[several] += 4
    names = ("row", "kind", "at", "size", "dims", "big")
    parts = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 5 + [np.empty(0, bool)]
    out = dict(zip(names, parts, strict=True))
    order = np.lexsort((np.arange(len(out["row"])), out["kind"], out["row"]))
    whole = order[~bad[out["row"][order]]]
    return top, bad, {c: v[whole] for c, v in out.items()}


def _vertices(buffer: _Buffer, chains: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """x and y of all vertices, chain after chain."""
    size = chains["size"]
    which = np.repeat(np.arange(len(size)), size)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    place = chains["at"][which] + inside * chains["dims"][which] * 8
    big = chains["big"][which]
    return buffer.read(place, "f8", big), buffer.read(place + 8, "f8", big)


def _lists(rows: np.ndarray, n: int, empty: np.ndarray, sides: list[np.ndarray]) -> pa.ListArray:
    """Lists of sides per value from sides in row order; null where ``empty``."""
    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(rows, minlength=n), out=offsets[1:])
    values = pa.StructArray.from_arrays([pa.array(s) for s in sides], names=list(SIDE))
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(empty))


def decode(values: pa.Array) -> pa.StructArray:
    """kind, is_null, is_empty, is_broken, n_points, extent, part ends and edges of every value."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    n, filled = len(values), values.is_valid().to_numpy(zero_copy_only=False)
    buffer = _Buffer(values)
    top, bad, chains = _chains(buffer, filled)
    x, y = _vertices(buffer, chains)
    row, kind, size = chains["row"], chains["kind"], chains["size"]
    stop = np.cumsum(size)
    begin = stop - size

    owner = np.repeat(row, size)
    seen = ~(np.isnan(x) | np.isnan(y))
    points = np.bincount(owner[seen], minlength=n)
    extents = []
    for axis, pick, start in ((x, np.minimum, np.inf), (y, np.minimum, np.inf), (x, np.maximum, -np.inf), (y, np.maximum, -np.inf)):
        edge = np.full(n, start)
        pick.at(edge, owner[seen], axis[seen])
        extents.append(edge)
    blank = points == 0
    # a line needs two different vertices, a ring four that come back to the first
    some = np.flatnonzero(size > 0)
    moved = np.zeros(len(size), bool)
    head_x, head_y = np.zeros(len(size)), np.zeros(len(size))
    tail_x, tail_y = np.zeros(len(size)), np.zeros(len(size))
    head_x[some], head_y[some], tail_x[some], tail_y[some] = x[begin[some]], y[begin[some]], x[stop[some] - 1], y[stop[some] - 1]
    which = np.repeat(np.arange(len(size)), size)
    moved[which[(x != head_x[which]) | (y != head_y[which])]] = True
    faulty = ((kind == LINE) & ((size < 2) | ~moved)) | ((kind == RING) & ((size < 4) | (head_x != tail_x) | (head_y != tail_y)))
    broken = np.zeros(n, bool)
    broken[row[faulty]] = True

    shown = filled & ~bad & ~blank
    ends = (kind != RING) & (size > 0) & shown[row]
    parts = _lists(row[ends], n, ~shown, [head_x[ends], head_y[ends], tail_x[ends], tail_y[ends]])
    follows = np.flatnonzero((np.arange(len(x)) + 1 < stop[which]) & (kind[which] != POINT) & shown[owner]) if len(x) else np.empty(0, np.int64)
    edges = _lists(owner[follows], n, ~shown, [x[follows], y[follows], x[follows + 1], y[follows + 1]])
    name = _NAMES[np.where(bad | (top < 0), 0, top)]
    columns = {
        "kind": pa.array(name, pa.string(), mask=~filled), "is_null": pa.array(~filled), "is_empty": pa.array(filled & ~bad & blank),
        "is_broken": pa.array(filled & (bad | (broken & ~blank))), "n_points": pa.array(np.where(shown, points, 0).astype(np.int32)),
        **{c: pa.array(v, mask=~shown) for c, v in zip(("minx", "miny", "maxx", "maxy"), extents, strict=True)},
        "parts": parts, "edges": edges,
    }
    return pa.StructArray.from_arrays(list(columns.values()), names=list(columns))


# --- writing ---------------------------------------------------------------------------------------


def _records(n: int, head: bytes, numbers: list[np.ndarray], missing: np.ndarray) -> pa.Array:
    """``head`` and the given little-endian doubles per value."""
    width = len(head) + 8 * len(numbers)
    raw = np.empty((n, width), np.uint8)
    raw[:, : len(head)] = np.frombuffer(head, np.uint8)
    flat = np.ascontiguousarray(np.stack([np.asarray(v, "<f8") for v in numbers], axis=1)) if n else np.empty((0, len(numbers)), "<f8")
    raw[:, len(head) :] = flat.view(np.uint8).reshape(n, -1)
    offsets = np.arange(n + 1, dtype=np.int32) * width
    whole = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])
    return pc.if_else(pa.array(missing), pa.scalar(None, pa.binary()), whole)


def _numbers(columns: tuple[pa.Array, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    values = [c.to_numpy(zero_copy_only=False).astype(float) for c in columns]
    return values, np.isnan(np.sum(values, axis=0)) if len(columns[0]) else np.empty(0, bool)


def encode_points(x: pa.Array, y: pa.Array) -> pa.Array:
    """Points; null where a coordinate is."""
    values, missing = _numbers((x, y))
    return _records(len(x), struct.pack("<BI", 1, 1), values, missing)


def encode_lines(x1: pa.Array, y1: pa.Array, x2: pa.Array, y2: pa.Array) -> pa.Array:
    """Multi-lines of one straight part; null where a coordinate is."""
    values, missing = _numbers((x1, y1, x2, y2))
    return _records(len(x1), struct.pack("<BIIBII", 1, 5, 1, 1, 2, 2), values, missing)


def encode_boxes(west: pa.Array, south: pa.Array, east: pa.Array, north: pa.Array) -> pa.Array:
    """Multi-polygons of one rectangle; null where a side is."""
    (w, s, e, n), missing = _numbers((west, south, east, north))
    return _records(len(west), struct.pack("<BIIBIII", 1, 6, 1, 1, 3, 1, 5), [w, s, e, s, e, n, w, n, w, s], missing)
