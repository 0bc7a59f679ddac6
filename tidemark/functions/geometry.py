"""Quadrilaterals of four corners, as columns ``x0, y0 .. x3, y3`` in the unit square."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _corner(i: int) -> tuple[Column, Column]:
    return F.col(f"x{i % 4}"), F.col(f"y{i % 4}")


def cross(i: int) -> Column:
    """Cross product of the edges that meet at corner i + 1."""
    (ax, ay), (bx, by), (cx, cy) = _corner(i), _corner(i + 1), _corner(i + 2)
    return (bx - ax) * (cy - by) - (by - ay) * (cx - bx)


def area() -> Column:
    parts = [_corner(i)[0] * _corner(i + 1)[1] - _corner(i + 1)[0] * _corner(i)[1] for i in range(4)]
    return F.abs(sum(parts[1:], parts[0])) / 2


def is_valid(min_area: float = 0.005) -> Column:
    """All corners in the unit square, strictly convex, clockwise from the top left, large enough."""
    inside = F.lit(True)
    for i in range(4):
        x, y = _corner(i)
        inside = inside & x.between(0, 1) & y.between(0, 1)
    convex = (cross(0) > 0) & (cross(1) > 0) & (cross(2) > 0) & (cross(3) > 0)
    return inside & convex & (area() >= min_area)


def edge(i: int) -> Column:
    (ax, ay), (bx, by) = _corner(i), _corner(i + 1)
    return F.sqrt(F.pow(bx - ax, 2) + F.pow(by - ay, 2))


def skew() -> Column:
    """Mean absolute cosine of neighbouring edges: 0 for a rectangle."""
    parts = []
    for i in range(4):
        (ax, ay), (bx, by), (cx, cy) = _corner(i), _corner(i + 1), _corner(i + 2)
        dot = (bx - ax) * (cx - bx) + (by - ay) * (cy - by)
        parts.append(F.abs(dot) / (edge(i) * edge(i + 1) + F.lit(1e-8)))
    return sum(parts[1:], parts[0]) / 4


def imbalance() -> Column:
    """Mean relative difference of opposite edges."""
    parts = [F.abs(edge(i) - edge(i + 2)) / (F.greatest(edge(i), edge(i + 2)) + F.lit(1e-8)) for i in (0, 1)]
    return (parts[0] + parts[1]) / 2


def natural_size(width: int, height: int) -> tuple[Column, Column]:
    """Width and height in pixels of the page a quad shows: its longer opposite edges."""

    def length(i: int) -> Column:
        (ax, ay), (bx, by) = _corner(i), _corner(i + 1)
        return F.sqrt(F.pow((bx - ax) * (width - 1), 2) + F.pow((by - ay) * (height - 1), 2))

    return F.bround(F.greatest(length(0), length(2))) + 1, F.bround(F.greatest(length(1), length(3))) + 1


def rotated(turn: int) -> dict[str, Column]:
    """The corners after rotating the frame clockwise by a multiple of 90 degrees, top left first again."""
    move = {0: lambda x, y: (x, y), 90: lambda x, y: (1 - y, x), 180: lambda x, y: (1 - x, 1 - y), 270: lambda x, y: (y, 1 - x)}[turn]
    out = {}
    for i in range(4):
        x, y = move(*_corner(i - turn // 90))
        out[f"x{i}"], out[f"y{i}"] = x, y
    return out


def projected(x: Column, y: Column, m: list[Column]) -> tuple[Column, Column]:
    """A point under a projective map of nine numbers, row by row."""
    z = m[6] * x + m[7] * y + m[8]
    return (m[0] * x + m[1] * y + m[2]) / z, (m[3] * x + m[4] * y + m[5]) / z


def projected_quad(m: list[Column], beyond: float = 0.05) -> dict[str, Column]:
    """All corners under a projective map, cut to the unit square; null where a corner lies more than ``beyond`` outside of it."""
    moved = [projected(*_corner(i), m) for i in range(4)]
    near = F.lit(True)
    for v in (v for point in moved for v in point):
        near = near & v.between(-beyond, 1 + beyond)
    cut = lambda v: F.when(near, F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)))
    return {f"{axis}{i}": cut(v) for i, point in enumerate(moved) for axis, v in zip("xy", point, strict=True)}


def _between(a: Column, b: Column, share: Column) -> Column:
    """The point at a share of the way from ``a`` to ``b``; beyond both for shares below 0 or above 1."""
    return a + (b - a) * share


def moved_edges(left: Column, right: Column, top: Column, bottom: Column) -> dict[str, Column]:
    """The corners after each edge moved outward by a share of the quad's own extent, cut to the unit square.

    A corner is looked up along the upper and the lower edge, then on the line
    between these two points.
    """
    out = {}
    for axis in "xy":
        upper = (F.col(f"{axis}0"), F.col(f"{axis}1"))
        lower = (F.col(f"{axis}3"), F.col(f"{axis}2"))
        for i, (across, down) in enumerate([(-left, -top), (1 + right, -top), (1 + right, 1 + bottom), (-left, 1 + bottom)]):
            value = _between(_between(*upper, across), _between(*lower, across), down)
            out[f"{axis}{i}"] = F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))
    return {f"{axis}{i}": out[f"{axis}{i}"] for i in range(4) for axis in "xy"}


def ring(*points: tuple[Column, Column]) -> Column:
    """A polygon: the list of its corners, structs of ``x`` and ``y``."""
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points])


def quad_ring(prefix: str = "") -> Column:
    """The quad of the columns ``x0, y0 .. x3, y3`` as a polygon."""
    return ring(*[(F.col(f"{prefix}x{i}"), F.col(f"{prefix}y{i}")) for i in range(4)])


def _with_next(polygon: Column) -> Column:
    """Pairs ``a, b`` of each corner and the one after it, round to the first."""
    turned = F.concat(F.slice(polygon, F.lit(2), F.greatest(F.size(polygon) - 1, F.lit(0))), F.slice(polygon, 1, 1))
    return F.arrays_zip(polygon.alias("a"), turned.alias("b"))


def signed_area(polygon: Column) -> Column:
    """Area of a polygon; negative where its corners run the other way round. 0 for less than three corners."""
    twice = F.transform(_with_next(polygon), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    return F.aggregate(twice, F.lit(0.0), lambda s, v: s + v) / 2


def overlap(a: Column, b: Column) -> Column:
    """The part that two convex polygons share, as a polygon; no corners where they don't meet.

    ``a`` is cut by one edge of ``b`` after the other: corners on the inner side
    stay, and where its outline crosses the edge's line a corner is put in.
    Touching polygons share a polygon without area. Corners may run either way.
    """
    turned = F.when(signed_area(b) < 0, F.reverse(b)).otherwise(b)

    def cut(polygon: Column, edge: Column) -> Column:
        p, q = edge["a"], edge["b"]

        def side(v: Column) -> Column:
            return (q["x"] - p["x"]) * (v["y"] - p["y"]) - (q["y"] - p["y"]) * (v["x"] - p["x"])

        def part(e: Column) -> Column:
            """What the outline has from one corner up to, not with, the next."""
            u, v = e["a"], e["b"]
            su, sv = side(u), side(v)
            share = F.try_divide(su, su - sv)
            crossing = F.array(F.struct(_between(u["x"], v["x"], share).alias("x"), _between(u["y"], v["y"], share).alias("y")))
            none = F.slice(crossing, 1, 0)
            crosses = ((su >= 0) & (sv < 0) & (su > 0)) | ((su < 0) & (sv > 0))
            return F.concat(F.when(su >= 0, F.array(F.struct(u["x"].alias("x"), u["y"].alias("y")))).otherwise(none), F.when(crosses, crossing).otherwise(none))

        return F.flatten(F.transform(_with_next(polygon), part))

    return F.aggregate(_with_next(turned), a, cut)


def overlap_share(a: Column, b: Column, common: Column) -> Column:
    """Area of ``common``, the overlap of two polygons, as a share of the area that either covers; 0 where one has no area."""
    return shared_part(F.abs(signed_area(a)), F.abs(signed_area(b)), F.abs(signed_area(common)))


def shared_part(area_a: Column, area_b: Column, both: Column) -> Column:
    """The area that two polygons share as a part of what either covers, 0 to 1."""
    whole = area_a + area_b - both
    return F.when((area_a <= 0) | (area_b <= 0) | (whole <= 0), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), both / whole)))
