"""Polygon outlines from an ESRI .shp file (public format), as lists of rings by shape."""

from __future__ import annotations

import struct

#: File code, and shape types with rings (polygon, with Z, with M).
FILE_CODE, POLYGONS = 9994, (5, 15, 25)


Ring = list[tuple[float, float]]


def read_shapes(path: str) -> list[list[Ring]]:
    """The rings of each polygon; shapes of other types are skipped."""
    with open(path, "rb") as f:
        raw = f.read()
    if len(raw) < 100 or struct.unpack(">i", raw[:4])[0] != FILE_CODE:
        raise ValueError("not a shapefile")
    shapes, at = [], 100
    while at + 12 <= len(raw):
        _, words = struct.unpack(">ii", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        if len(body) < 44 or struct.unpack("<i", body[:4])[0] not in POLYGONS:
            continue
        parts, points = struct.unpack("<ii", body[36:44])
        starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
        xy = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
        shapes.append([[(xy[2 * i], xy[2 * i + 1]) for i in range(a, b)] for a, b in zip(starts, starts[1:])])
    return shapes
