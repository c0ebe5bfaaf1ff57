"""Well-known binary for the shapes of a shapefile record."""

from __future__ import annotations

import struct

import numpy as np


def _head(code: int, third, measured: bool) -> bytes:
    plus = 0 if third is None else (2000 if measured else 1000)
    return struct.pack("<BI", 1, code + plus)


def _coordinates(xy: np.ndarray, third: np.ndarray | None) -> bytes:
    table = xy if third is None else np.column_stack([xy, third])
    return np.ascontiguousarray(table, "<f8").tobytes()


def _run(xy: np.ndarray, third: np.ndarray | None) -> bytes:
    return struct.pack("<I", len(xy)) + _coordinates(xy, third)


def _slices(parts: np.ndarray, points: int) -> list[slice]:
    edges = [*parts.tolist(), points]
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]


def _pick(third: np.ndarray | None, part: slice) -> np.ndarray | None:
    return None if third is None else third[part]


def point_wkb(x: float, y: float, extra: tuple, measured: bool) -> bytes:
    return _head(1, extra or None, measured) + struct.pack(f"<{2 + len(extra)}d", x, y, *extra)


def multipoint_wkb(xy, parts, third, measured, with_wkb):
    if not with_wkb:
        return "MULTIPOINT", None
    members = b"".join(
        _head(1, third, measured) + _coordinates(xy[i : i + 1], _pick(third, slice(i, i + 1)))
        for i in range(len(xy))
    )
    return "MULTIPOINT", _head(4, third, measured) + struct.pack("<I", len(xy)) + members


def polyline_wkb(xy, parts, third, measured, with_wkb):
    pieces = _slices(parts, len(xy))
    name = "LINESTRING" if len(pieces) == 1 else "MULTILINESTRING"
    if not with_wkb:
        return name, None
    lines = [_head(2, third, measured) + _run(xy[p], _pick(third, p)) for p in pieces]
    if len(lines) == 1:
        return name, lines[0]
    return name, _head(5, third, measured) + struct.pack("<I", len(lines)) + b"".join(lines)


def _signed_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return 0.5 * float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))


def _contains(ring: np.ndarray, point: np.ndarray) -> bool:
    """Even-odd test of a point against a ring."""
    ax, ay = ring[:-1, 0], ring[:-1, 1]
    bx, by = ring[1:, 0], ring[1:, 1]
    crosses = (ay > point[1]) != (by > point[1])
    at = ax[crosses] + (point[1] - ay[crosses]) * (bx[crosses] - ax[crosses]) / (by[crosses] - ay[crosses])
    return bool(np.count_nonzero(at > point[0]) % 2)


def _group_rings(xy: np.ndarray, rings: list[slice]) -> list[list[slice]]:
    """Rings as polygons: clockwise rings are shells, the others go to the smallest shell
    around them. Without any clockwise ring every ring is a shell."""
    areas = [_signed_area(xy[r]) for r in rings]
    shells = [i for i, a in enumerate(areas) if a < 0] or list(range(len(rings)))
    members = {i: [rings[i]] for i in shells}
    for i, ring in enumerate(rings):
        if i in members:
            continue
        around = [s for s in shells if _contains(xy[rings[s]], xy[ring][0])]
        if around:
            members[min(around, key=lambda s: abs(areas[s]))].append(ring)
        else:
            members[i] = [ring]
    return [members[i] for i in sorted(members)]


def polygon_wkb(xy, parts, third, measured, with_wkb):
    rings = _slices(parts, len(xy))
    polygons = [rings] if len(rings) <= 1 else _group_rings(xy, rings)
    name = "POLYGON" if len(polygons) == 1 else "MULTIPOLYGON"
    if not with_wkb:
        return name, None
    bodies = [
        _head(3, third, measured)
        + struct.pack("<I", len(group))
        + b"".join(_run(xy[r], _pick(third, r)) for r in group)
        for group in polygons
    ]
    if len(bodies) == 1:
        return name, bodies[0]
    return name, _head(6, third, measured) + struct.pack("<I", len(bodies)) + b"".join(bodies)
