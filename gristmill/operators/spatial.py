"""Points in polygons and grids, as joins on cells and column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges(vertices: DataFrame, ring: str) -> DataFrame:
    """One row for each ring of ``vertices`` (ring, seq, x, y): its box and its sides, the last one back to the first vertex."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))
    rings = vertices.groupBy(ring).agg(ordered.alias("_v"), *[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("low", F.min), ("high", F.max))])
    shifted = F.concat(F.slice("_v", 2, F.size("_v")), F.slice("_v", 1, 1))
    return rings.withColumn("sides", F.arrays_zip(F.col("_v").alias("a"), shifted.alias("b"))).drop("_v")


def crossings(x: Column, y: Column, sides: Column) -> Column:
    """How many sides a ray to the right of the point crosses."""

    def crossed(s: Column) -> Column:
        a, b = s["a"], s["b"]
        spans = (a["y"] > y) != (b["y"] > y)
        return spans & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])

    return F.size(F.filter(sides, lambda s: F.when((s["a"]["y"] > y) != (s["b"]["y"] > y), crossed(s)).otherwise(False)))


def inside(points: DataFrame, vertices: DataFrame, ring: str, cell: float) -> DataFrame:
    """The pairs of ``points`` (x, y and others) and rings that hold them.

    A ring stands in every cell of its box, a point in one, so only the
    rings of a point's cell are tried.
    """
    rings = edges(vertices, ring)

    def span(c: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(f"low_{c}") / cell), F.floor(F.col(f"high_{c}") / cell)))

    placed = rings.withColumn("_cx", span("x")).withColumn("_cy", span("y"))
    celled = points.withColumn("_cx", F.floor(F.col("x") / cell)).withColumn("_cy", F.floor(F.col("y") / cell))
    found = celled.join(placed, ["_cx", "_cy"]).where(crossings(F.col("x"), F.col("y"), F.col("sides")) % 2 == 1)
    return found.select(*points.columns, ring)


def albers(lon: Column, lat: Column, low: float = 29.5, high: float = 45.5, lon0: float = -96.0, lat0: float = 37.5) -> tuple[Column, Column]:
    """Equal-area conic coordinates on the unit sphere with standard parallels ``low`` and ``high``."""
    n = (F.sin(F.radians(F.lit(low))) + F.sin(F.radians(F.lit(high)))) / 2
    c = F.pow(F.cos(F.radians(F.lit(low))), 2) + 2 * n * F.sin(F.radians(F.lit(low)))
    theta = n * F.radians(lon - lon0)
    rho, rho0 = (F.sqrt(c - 2 * n * F.sin(F.radians(a))) / n for a in (lat, F.lit(lat0)))
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def bilinear(z00: Column, z10: Column, z01: Column, z11: Column, fx: Column, fy: Column) -> Column:
    """The height between four neighbours at fractions fx and fy."""
    return z00 * (1 - fx) * (1 - fy) + z10 * fx * (1 - fy) + z01 * (1 - fx) * fy + z11 * fx * fy


def side_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """How far a point is from the side between two corners; of a side without length, from its corner."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / length))).otherwise(0.0)
    return F.sqrt(F.pow(x - ax - t * dx, 2) + F.pow(y - ay - t * dy, 2))


def near_outlines(points: DataFrame, vertices: DataFrame, ring: str, tolerance: float, cell: float, by: list[str], point_id: str) -> DataFrame:
    """(point_id, by, ring, distance): the ring that holds each of ``points`` (x, y, by), at distance 0, else the nearest whose outline is within ``tolerance``; the smallest ring on a tie.

    A side stands in the cells that its box, wider by the tolerance, touches,
    and a point in one; so a point meets the sides near it and the rings over
    it, and no others.  Points without either are left out.
    """
    reach = lambda c: F.explode(F.sequence(F.floor((F.least(F.col(f"a{c}"), F.col(f"b{c}")) - tolerance) / cell), F.floor((F.greatest(F.col(f"a{c}"), F.col(f"b{c}")) + tolerance) / cell)))
    named = vertices.withColumn("_ring", F.struct(*by, F.col(ring).alias("ring")))
    sides = edges(named, "_ring").select("_ring", F.explode("sides").alias("s")).select("_ring", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))
    placed = sides.withColumn("_cx", reach("x")).withColumn("_cy", reach("y")).select("_cx", "_cy", "ax", "ay", "bx", "by", *[F.col(f"_ring.{c}").alias(c) for c in by], F.col("_ring.ring").alias("ring"))
    celled = points.withColumn("_cx", F.floor(F.col("x") / cell)).withColumn("_cy", F.floor(F.col("y") / cell))
    far = F.round(side_distance(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")), 9)
    beside = celled.join(placed, [*by, "_cx", "_cy"]).select(point_id, *by, "ring", far.alias("distance")).where(F.col("distance") <= tolerance)
    held = inside(points.withColumn("_by", F.struct(*by)), named, "_ring", cell).where(F.col("_by") == F.struct(*[F.col(f"_ring.{c}") for c in by]))
    zero = held.select(point_id, *by, F.col("_ring.ring").alias("ring"), F.lit(0.0).alias("distance"))
    best = zero.union(beside).groupBy(point_id, *by).agg(F.min(F.struct("distance", "ring")).alias("b"))
    return best.select(point_id, *by, "b.ring", "b.distance")
