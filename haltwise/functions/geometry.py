"""Planar geometry of points and straight-segment lines as Column expressions.

A line is an array of (x, y) structs in metres. Everything stays in the JVM but binary lines, which are read in Arrow batches.
"""

from __future__ import annotations

import math
from binascii import unhexlify

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LINE = "array<struct<x:double,y:double>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def make_line(*points: Column) -> Column:
    return F.array(*points)


def hypot(a: Column, b: Column) -> Column:
    return F.hypot(b["x"] - a["x"], b["y"] - a["y"])


def line_segments(line: Column) -> Column:
    """(a, b) of each segment; empty for fewer than two points."""
    return F.transform(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))), lambda p, i: F.struct(p.alias("a"), F.get(line, i + 1).alias("b")))


def length(line: Column) -> Column:
    return F.aggregate(line_segments(line), F.lit(0.0), lambda s, g: s + hypot(g["a"], g["b"]))


def start_point(line: Column) -> Column:
    return F.get(line, 0)


def end_point(line: Column) -> Column:
    return F.get(line, F.size(line) - 1)


def reverse(line: Column) -> Column:
    return F.reverse(line)


def parse_linestring(wkt: Column) -> Column:
    """LINESTRING (x y, x y, ...) as a line."""
    body = F.regexp_extract(wkt, r"\(\s*(.*?)\s*\)", 1)
    return F.transform(F.split(body, r"\s*,\s*"), lambda p: point(F.get(F.split(p, r"\s+"), 0), F.get(F.split(p, r"\s+"), 1)))


def parse_point(wkt: Column) -> Column:
    return point(F.regexp_extract(wkt, r"\(\s*(\S+)\s+(\S+)\s*\)", 1), F.regexp_extract(wkt, r"\(\s*(\S+)\s+(\S+)\s*\)", 2))


def to_wkt(line: Column) -> Column:
    return F.concat(F.lit("LINESTRING("), F.array_join(F.transform(line, lambda p: F.concat_ws(" ", p["x"], p["y"])), ","), F.lit(")"))


def _line_bytes(h: str | None) -> bytes | None:
    """The coordinates of a hexadecimal binary line, 16 bytes a point."""
    # A line is of type 2; a reference system, marked by 0x20, takes four more bytes.
    start = {"0102000000": 10, "0102000020": 18}.get(h[:10]) if h else None
    if start is None:
        return None
    try:
        n = int.from_bytes(unhexlify(h[start : start + 8]), "little")
        raw = unhexlify(h[start + 8 : start + 8 + 32 * n])
    except ValueError:
        return None
    return raw if n > 0 and len(raw) == 16 * n and len(h) < start + 24 + 32 * n else None


def _lines(hexed: pa.Array) -> pa.Array:
    """A batch of lines: their bytes are put one after the other and read as doubles in one step."""
    found = [_line_bytes(h) for h in hexed.to_pylist()]
    ends = np.cumsum([0, *(len(raw) // 16 if raw else 0 for raw in found)], dtype="int32")
    numbers = np.frombuffer(b"".join(raw for raw in found if raw), "<f8").reshape(-1, 2)
    points = pa.StructArray.from_arrays([pa.array(numbers[:, 0]), pa.array(numbers[:, 1])], ["x", "y"])
    return pa.ListArray.from_arrays(pa.array(ends), points, mask=pa.array([raw is None for raw in found], pa.bool_()))


def parse_line_wkb(hexed: Column) -> Column:
    """A line from hexadecimal (extended) well-known binary with the last byte first, as database dumps have it; null for anything else."""
    return F.arrow_udf(_lines, LINE)(hexed)


def nearest(line: Column, p: Column) -> Column:
    """(distance, along, side, beyond) of the line's point nearest to p.

    along: metres from the start; side: +1 on the left of the line's direction,
    -1 on its right; beyond: p lies past the line's first or last end.
    """
    last = F.size(line) - 2
    zero = F.struct(F.lit(float("inf")).alias("distance"), F.lit(0.0).alias("along"), F.lit(0.0).alias("side"), F.lit(False).alias("beyond"), F.lit(0.0).alias("at"), F.lit(0).alias("i"))

    def step(acc: Column, g: Column) -> Column:
        a, b = g["a"], g["b"]
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        size2 = dx * dx + dy * dy
        t = F.coalesce(F.try_divide((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy, size2), F.lit(0.0))
        c = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
        size = F.sqrt(size2)
        d = F.hypot(p["x"] - (a["x"] + c * dx), p["y"] - (a["y"] + c * dy))
        closer = d < acc["distance"]
        side = F.signum(dx * (p["y"] - a["y"]) - dy * (p["x"] - a["x"]))
        beyond = ((acc["i"] == 0) & (t < 0)) | ((acc["i"] == last) & (t > 1))
        return F.struct(
            F.when(closer, d).otherwise(acc["distance"]).alias("distance"),
            F.when(closer, acc["at"] + c * size).otherwise(acc["along"]).alias("along"),
            F.when(closer, side).otherwise(acc["side"]).alias("side"),
            F.when(closer, beyond).otherwise(acc["beyond"]).alias("beyond"),
            (acc["at"] + size).alias("at"),
            (acc["i"] + 1).alias("i"),
        )

    return F.aggregate(line_segments(line), zero, step, lambda acc: F.struct(acc["distance"].alias("distance"), acc["along"].alias("along"), acc["side"].alias("side"), acc["beyond"].alias("beyond")))


def box(line: Column) -> Column:
    """The extent of a line: x0, x1, y0, y1."""
    xs, ys = F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))


def near_box(b: Column, x: Column, y: Column, metres: Column | float) -> Column:
    """Whether a place lies in an extent widened by a distance; all that is nearer than it to the line does."""
    m = metres if isinstance(metres, Column) else F.lit(float(metres))
    return (x >= b["x0"] - m) & (x <= b["x1"] + m) & (y >= b["y0"] - m) & (y <= b["y1"] + m)


def distance(line: Column, p: Column) -> Column:
    return nearest(line, p)["distance"]


def locate(line: Column, p: Column) -> Column:
    """Share of the line's length at the point nearest to p."""
    return F.coalesce(F.try_divide(nearest(line, p)["along"], length(line)), F.lit(0.0))


def interpolate(line: Column, share: Column) -> Column:
    """The point at a share of the line's length."""
    target = share * length(line)
    zero = F.struct(start_point(line)["x"].alias("x"), start_point(line)["y"].alias("y"), F.lit(0.0).alias("at"), F.lit(False).alias("done"))

    def step(acc: Column, g: Column) -> Column:
        a, b = g["a"], g["b"]
        size = hypot(a, b)
        c = F.least(F.greatest(F.coalesce(F.try_divide(target - acc["at"], size), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
        return F.struct(
            F.when(acc["done"], acc["x"]).otherwise(a["x"] + c * (b["x"] - a["x"])).alias("x"),
            F.when(acc["done"], acc["y"]).otherwise(a["y"] + c * (b["y"] - a["y"])).alias("y"),
            (acc["at"] + size).alias("at"),
            (acc["done"] | (acc["at"] + size >= target)).alias("done"),
        )

    return F.aggregate(line_segments(line), zero, step, lambda acc: point(acc["x"], acc["y"]))


def bound(value: Column, use) -> Column:
    """use(value), the value worked out once however often it is used: inside an array's function nothing is shared."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def marks(line: Column) -> Column:
    """The line's points with the metres before them: x, y, at."""
    return F.aggregate(
        line_segments(line),
        F.array(F.struct(start_point(line)["x"].alias("x"), start_point(line)["y"].alias("y"), F.lit(0.0).alias("at"))),
        lambda acc, g: F.array_append(acc, F.struct(g["b"]["x"].alias("x"), g["b"]["y"].alias("y"), (F.element_at(acc, -1)["at"] + hypot(g["a"], g["b"])).alias("at"))),
    )


def at_metres(points: Column, metres: Column) -> Column:
    """The point at so many metres along a line given by its marks; the line's ends for less or more than it has."""
    after = F.size(F.filter(points, lambda m: m["at"] < metres))
    pair = F.struct(F.get(points, F.greatest(after - 1, F.lit(0))).alias("a"), F.get(points, F.least(after, F.size(points) - 1)).alias("b"))

    def between(p: Column) -> Column:
        a, b = p["a"], p["b"]
        share = F.coalesce(F.try_divide(metres - a["at"], b["at"] - a["at"]), F.lit(0.0))
        return point(a["x"] + share * (b["x"] - a["x"]), a["y"] + share * (b["y"] - a["y"]))

    return bound(pair, lambda p: F.when(p["a"]["at"] >= metres, point(p["a"]["x"], p["a"]["y"])).when(p["b"]["at"] <= metres, point(p["b"]["x"], p["b"]["y"])).otherwise(between(p)))


def inner_points(points: Column, low: Column, high: Column) -> Column:
    """The points of marks strictly between two distances."""
    return F.transform(F.filter(points, lambda m: (m["at"] > low) & (m["at"] < high)), lambda m: point(m["x"], m["y"]))


def substring_of_marks(points: Column, low: Column, high: Column) -> Column:
    """The part of a line, given by its marks, between two shares of its length."""
    span = lambda m: bound(F.element_at(m, -1)["at"], lambda total: F.struct((low * total).alias("lo"), (high * total).alias("hi")))
    part = lambda m, s: F.concat(F.array(at_metres(m, s["lo"])), inner_points(m, s["lo"], s["hi"]), F.array(at_metres(m, s["hi"])))
    return bound(span(points), lambda s: part(points, s))


def substring(line: Column, low: Column, high: Column) -> Column:
    """The part of the line between two shares of its length."""
    return bound(marks(line), lambda m: substring_of_marks(m, low, high))


def azimuth(a: Column, b: Column) -> Column:
    """Bearing from a to b in radians, clockwise from north; null for equal points."""
    angle = F.atan2(b["x"] - a["x"], b["y"] - a["y"])
    return F.when((a["x"] == b["x"]) & (a["y"] == b["y"]), F.lit(None)).otherwise(F.pmod(angle, F.lit(2 * math.pi)))


def within_flat_buffer(line: Column, p: Column, metres: Column | float) -> Column:
    """Within a distance of the line and not past its ends."""
    n = nearest(line, p)
    return (n["distance"] < metres) & ~n["beyond"]


def translate_scale(line: Column, fixed: Column, moved: Column, to: Column) -> Column:
    """Stretches a line: `fixed` stays, `moved` goes to `to`; axes without extent are shifted by nothing."""
    kx = F.coalesce(F.try_divide(to["x"] - fixed["x"], moved["x"] - fixed["x"]), F.lit(1.0))
    ky = F.coalesce(F.try_divide(to["y"] - fixed["y"], moved["y"] - fixed["y"]), F.lit(1.0))
    return F.transform(line, lambda p: point(fixed["x"] + (p["x"] - fixed["x"]) * kx, fixed["y"] + (p["y"] - fixed["y"]) * ky))


def snap_to_grid(line: Column, size: float) -> Column:
    """Points rounded to multiples of size; a point equal to the one before is left out."""
    to = lambda v: F.round(v / size) * size if size >= 1 else F.round(v / size) / (1 / size)
    snapped = F.transform(line, lambda p: point(to(p["x"]), to(p["y"])))
    return F.filter(snapped, lambda p, i: F.coalesce(p != F.get(snapped, i - 1), F.lit(True)))


def segment_cells(a: Column, b: Column, size: float, margin: float) -> Column:
    """The grid cells (cx, cy) that a segment passes within a margin: column by column, the rows between its heights there."""
    low, high = F.least(a["x"], b["x"]) - margin, F.greatest(a["x"], b["x"]) + margin
    rise = F.try_divide(b["y"] - a["y"], b["x"] - a["x"])

    def rows(cx: Column) -> Column:
        at = lambda x: a["y"] + rise * (F.least(F.greatest(x, low), high) - a["x"])
        one, two = at(cx * size - margin), at((cx + 1) * size + margin)
        # Never beyond the segment's own heights, which a vertical one has none but.
        bottom = F.greatest(F.coalesce(F.least(one, two), F.least(a["y"], b["y"])), F.least(a["y"], b["y"]))
        top = F.least(F.coalesce(F.greatest(one, two), F.greatest(a["y"], b["y"])), F.greatest(a["y"], b["y"]))
        cys = F.sequence(F.floor((bottom - margin) / size), F.floor((top + margin) / size))
        return F.transform(cys, lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))

    return F.flatten(F.transform(F.sequence(F.floor(low / size), F.floor(high / size)), rows))


def stretched(line: Column, fixed: Column, moved: Column, to: Column) -> Column:
    """The line with its end `moved` drawn to a place (null: as it is), vertices following in proportion.

    Each axis is scaled by itself. On an axis on which both ends are equal vertices follow by their share of the other axis.
    """
    share = lambda p, c: F.try_divide(p[c] - fixed[c], moved[c] - fixed[c])

    def follow(p: Column, c: str, other: str) -> Column:
        part = F.coalesce(share(p, c), share(p, other), F.when(p == moved, 1.0).otherwise(0.0))
        return F.when(p == moved, to[c]).otherwise(p[c] + part * (to[c] - moved[c]))

    return F.when(to.isNull() | (to == moved), line).otherwise(F.transform(line, lambda p: point(follow(p, "x", "y"), follow(p, "y", "x"))))


# GRS80 and the projected grid's zone.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257222101
CENTRAL_MERIDIAN, SCALE, FALSE_EASTING = 27.0, 0.9996, 500000.0


def _series(lon: Column | np.ndarray, lat: Column | np.ndarray, m=F) -> tuple:
    """The steps of the projection: (conformal tangent and longitude difference), (angles from those), (x and y from the angles); m is F for Columns and np for arrays."""
    n = FLATTENING / (2 - FLATTENING)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = math.sqrt(FLATTENING * (2 - FLATTENING))

    def grid(xi, eta) -> tuple:
        east, north = eta, xi
        for j, a in enumerate(alpha, 1):
            east = east + a * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
            north = north + a * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
        return FALSE_EASTING + SCALE * radius * east, SCALE * radius * north

    phi, lam = m.radians(lat), m.radians(lon - CENTRAL_MERIDIAN)
    first = (m.sinh(m.atanh(m.sin(phi)) - e * m.atanh(e * m.sin(phi))), lam)
    return first, lambda t, lam: (m.atan2(t, m.cos(lam)), m.atanh(m.sin(lam) / m.sqrt(1 + t * t))), grid


def project(lon: Column, lat: Column) -> Column:
    """Longitude and latitude in degrees to the metric grid (transverse Mercator, third-order Krueger series)."""
    first, angles, grid = _series(lon, lat)
    return point(*grid(*angles(*first)))


def project_line(line: Column) -> Column:
    """A line in degrees on the metric grid, step by step, since inside an array nothing shares equal parts of an expression."""
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    one = F.transform(line, lambda p: pair(*_series(p["x"], p["y"])[0]))
    _, angles, grid = _series(F.lit(0.0), F.lit(0.0))
    return F.transform(F.transform(one, lambda v: pair(*angles(v["a"], v["b"]))), lambda v: point(*grid(v["a"], v["b"])))


def _grid_lines(hexed: pa.Array) -> pa.Array:
    """A batch of binary lines in degrees on the metric grid."""
    lines = _lines(hexed)
    lon, lat = (lines.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    with np.errstate(all="ignore"):
        first, angles, grid = _series(lon, lat, np)
        x, y = grid(*angles(*first))
    return pa.ListArray.from_arrays(lines.offsets, pa.StructArray.from_arrays([pa.array(x), pa.array(y)], ["x", "y"]), mask=lines.is_null())


def project_line_wkb(hexed: Column) -> Column:
    """project_line of parse_line_wkb: lines are read and put on the grid in the same batches."""
    return F.arrow_udf(_grid_lines, LINE)(hexed)
