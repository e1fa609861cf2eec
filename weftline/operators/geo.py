"""Points near points and points in areas.

``near_pairs`` finds all pairs of points within a distance by an equi-join on a grid whose cells are as wide as the
distance at their latitude; everything stays in built-in expressions. ``points_in_areas`` cuts polygons into triangles by ear
clipping, puts the triangles into a bounding-volume hierarchy and tests every point against the few triangles whose
boxes hold it. All predicates on areas are exact: coordinates are scaled to integers. A point on a shared
diagonal or edge meets several triangles and is reported once per area.

Defined results: a null coordinate or 0/0 is no position; positions out of range (|lat| > 90, |lon| > 180, not finite)
are none either; rows of one key count once (their distinct positions are all used); areas without a ring of three
distinct points are empty; rings may be open or closed and turn either way; repeated area rows count once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.runtime import spread

EARTH_RADIUS_M = 6_371_008.8
#: Degrees are scaled by this to integers; finer coordinates are rounded half to even.
SCALE = 10**7
#: Triangles of a leaf of the hierarchy.
LEAF_TRIANGLES = 8
#: Up to this many triangles (56 bytes each) every task gets the whole hierarchy; beyond it triangles are shuffled by tile.
TREE_TRIANGLES = 200_000
#: Points or triangles of a tile that one task takes at a time beyond that.
TILE_ROWS = 100_000
#: Degrees of a tile of the shuffled way.
TILE_DEG = 0.25


def has_position(lat: Column, lon: Column) -> Column:
    """True for a usable position; never null."""
    la, lo = lat.cast("double"), lon.cast("double")
    return F.coalesce((F.abs(la) <= 90) & (F.abs(lo) <= 180) & ~((la == 0) & (lo == 0)), F.lit(False))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_RADIUS_M) -> Column:
    """Great-circle distance in metres of positions in degrees."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), F.lit(2.0)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2.0 * radius) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def positions(df: DataFrame, key: str, lat: Column, lon: Column) -> DataFrame:
    """``key``, ``lat``, ``lon`` (double) of the rows that have a position, each once."""
    return df.select(F.col(key).alias("key"), lat.cast("double").alias("lat"), lon.cast("double").alias("lon")).filter(F.col("key").isNotNull() & has_position(F.col("lat"), F.col("lon"))).distinct()


def near_pairs(points: DataFrame, metres: float, radius: float = EARTH_RADIUS_M) -> DataFrame:
    """``key_a`` < ``key_b`` of every two different keys with positions (``key``, ``lat``, ``lon``) at most ``metres`` apart.

    Rows of the grid are ``step`` degrees high; in each the circle of latitude is cut into a whole number of cells no
    narrower than the distance there or in the next row. Every point stands in its cell and looks into its own cell, the
    next one eastwards and three of the row above, so each pair meets in exactly one of the looks.
    """
    step = math.degrees(metres / radius) * (1 + 1e-9)
    half = math.sin(min(metres / radius / 2, math.pi / 2))

    def cells_in(row: Column) -> Column:
        # the widest difference of longitude at the row's latitude nearest to a pole, one row of slack to either side
        far = F.least(F.greatest(F.abs(row - 1), F.abs(row + 2)) * F.lit(step), F.lit(90.0))
        ratio = F.lit(half * (1 + 1e-9)) / F.cos(F.radians(far))
        width = F.when(ratio < 1, F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * 2).otherwise(F.lit(360.0))
        return F.greatest(F.floor(F.lit(360.0) / width), F.lit(1)).cast("long")

    def cell(lon: Column, n: Column) -> Column:
        return F.pmod(F.floor((lon + 180.0) / 360.0 * n), n)

    base = points.withColumn("row", F.floor(F.col("lat") / F.lit(step)).cast("long"))
    here = base.withColumn("n", cells_in(F.col("row"))).withColumn("cell", cell(F.col("lon"), F.col("n")))
    up_row = F.col("row") + 1
    up_n = cells_in(up_row)
    up = cell(F.col("lon"), up_n)
    looks = F.array_union(
        F.array(F.struct(F.col("row").alias("row"), F.col("cell").alias("cell")), F.struct(F.col("row").alias("row"), F.pmod(F.col("cell") + 1, F.col("n")).alias("cell"))),
        F.array(*[F.struct(up_row.alias("row"), F.pmod(up + k, up_n).alias("cell")) for k in (-1, 0, 1)]),
    )
    left = here.select(F.col("key").alias("k1"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.col("row").alias("row0"), F.col("cell").alias("cell0"), F.explode(F.array_distinct(looks)).alias("at")).select("*", "at.row", "at.cell").drop("at")
    right = here.select("row", "cell", F.col("key").alias("k2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    met = left.join(right, ["row", "cell"]).filter("k1 <> k2 and not (row = row0 and cell = cell0 and k1 > k2)")
    met = met.filter(haversine_m(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"), radius) <= metres)
    return met.select(F.least("k1", "k2").alias("key_a"), F.greatest("k1", "k2").alias("key_b")).distinct()


# --- triangles -----------------------------------------------------------------------------------------------------


def _turn(a, b, c) -> int:
    """Twice the signed area of a triangle of integer points, exact."""
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _clean_ring(ring) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for p in [] if ring is None else ring:
        if p is None or len(p) < 2 or not (math.isfinite(p[0]) and math.isfinite(p[1])):
            continue
        q = (round(float(p[0]) * SCALE), round(float(p[1]) * SCALE))
        if not out or out[-1] != q:
            out.append(q)
    while len(out) > 1 and out[0] == out[-1]:
        out.pop()
    return out if len(out) >= 3 else []


def _area2(ring) -> int:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))


def _crosses(a, b, c, d) -> bool:
    """True if the open segments ab and cd cross properly."""
    return _turn(a, b, c) * _turn(a, b, d) < 0 and _turn(c, d, a) * _turn(c, d, b) < 0


def _on_segment(p, a, b) -> bool:
    return _turn(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def _in_cone(ring, k, p) -> bool:
    """True if p lies in the interior angle of vertex k of a counter-clockwise ring."""
    a, v, b = ring[k - 1], ring[k], ring[(k + 1) % len(ring)]
    if _turn(a, v, b) >= 0:
        return _turn(a, v, p) > 0 and _turn(v, b, p) > 0
    return not (_turn(a, v, p) <= 0 and _turn(v, b, p) <= 0)


def _bridge(outer, hole):
    """Join a clockwise hole to a counter-clockwise ring by the shortest free diagonal."""
    edges = list(zip(outer, outer[1:] + outer[:1], strict=True)) + list(zip(hole, hole[1:] + hole[:1], strict=True))
    pairs = sorted(((v[0] - h[0]) ** 2 + (v[1] - h[1]) ** 2, i, j) for i, v in enumerate(outer) for j, h in enumerate(hole))
    for _, i, j in pairs:
        v, h = outer[i], hole[j]
        if v != h:
            if not _in_cone(outer, i, h):
                continue
            if any(_crosses(v, h, a, b) or any(q not in (v, h) and _on_segment(q, v, h) for q in (a, b)) for a, b in edges):
                continue
        return outer[: i + 1] + hole[j:] + hole[: j + 1] + outer[i:]
    return outer


def _holds(a, b, c, p) -> bool:
    return _turn(a, b, p) >= 0 and _turn(b, c, p) >= 0 and _turn(c, a, p) >= 0


def ear_clip(polygon) -> list[tuple]:
    """Triangles (three integer points each, counter-clockwise) that cover a polygon with holes exactly."""
    rings = [_clean_ring(ring) for ring in ([] if polygon is None else polygon)]
    if not rings or not rings[0]:
        return []
    first = rings[0]
    outer = first if _area2(first) > 0 else first[::-1]
    holes = [r if _area2(r) < 0 else r[::-1] for r in rings[1:] if r and _area2(r)]
    for hole in sorted(holes, key=max, reverse=True):
        outer = _bridge(outer, hole)
    ring, out = list(outer), []
    while len(ring) > 3:
        best = None
        for k in range(len(ring)):
            a, b, c = ring[k - 1], ring[k], ring[(k + 1) % len(ring)]
            t = _turn(a, b, c)
            if t == 0:
                best = (k, None)  # a flat corner has no area of its own
                break
            if t > 0 and not any(q not in (a, b, c) and _holds(a, b, c, q) for q in ring):
                best = (k, (a, b, c))
                break
        if best is None:  # only rings that cross themselves get here: clip any convex corner
            k = next((k for k in range(len(ring)) if _turn(ring[k - 1], ring[k], ring[(k + 1) % len(ring)]) > 0), 0)
            best = (k, (ring[k - 1], ring[k], ring[(k + 1) % len(ring)]))
        if best[1] and _turn(*best[1]) > 0:
            out.append(best[1])
        ring.pop(best[0])
    if len(ring) == 3 and _turn(*ring) > 0:
        out.append(tuple(ring))
    return out


_TRIANGLE_SCHEMA = "area string, x1 long, y1 long, x2 long, y2 long, x3 long, y3 long"


def area_triangles(areas: DataFrame, key: str = "area_key", coordinates: str = "coordinates") -> DataFrame:
    """Triangles of every area in scaled integers, cut where the areas lie; repeated area rows count once."""
    once = areas.select(F.col(key).cast("string").alias("area"), F.col(coordinates).alias("polygons")).filter("area is not null and polygons is not null").distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["area", "x1", "y1", "x2", "y2", "x3", "y3"]
        for pdf in frames:
            rows = [(area, *a, *b, *c) for area, polygons in zip(pdf["area"], pdf["polygons"], strict=True) for polygon in polygons if polygon is not None for a, b, c in ear_clip(polygon)]
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return once.mapInPandas(run, _TRIANGLE_SCHEMA)


class TriangleTree:
    """A bounding-volume hierarchy over triangles, split at the median of the longer axis."""

    def __init__(self, corners: np.ndarray) -> None:
        """``corners``: n rows of x1, y1, x2, y2, x3, y3 (int64, counter-clockwise)."""
        self.corners = corners
        x, y = corners[:, 0::2], corners[:, 1::2]
        boxes = np.stack([x.min(1), y.min(1), x.max(1), y.max(1)], 1) if len(corners) else np.zeros((0, 4), np.int64)
        self.nodes: list[tuple] = []
        self._build(np.arange(len(corners)), boxes, (boxes[:, 0] + boxes[:, 2], boxes[:, 1] + boxes[:, 3]))

    def _build(self, members: np.ndarray, boxes: np.ndarray, middle: tuple) -> int:
        at = len(self.nodes)
        if not len(members):
            self.nodes.append((None, None, members))
            return at
        box = (boxes[members, 0].min(), boxes[members, 1].min(), boxes[members, 2].max(), boxes[members, 3].max())
        self.nodes.append((box, None, members))
        if len(members) > LEAF_TRIANGLES:
            axis = int(box[3] - box[1] > box[2] - box[0])
            order = members[np.argsort(middle[axis][members], kind="stable")]
            half = len(order) // 2
            left = self._build(order[:half], boxes, middle)
            right = self._build(order[half:], boxes, middle)
            self.nodes[at] = (box, (left, right), None)
        return at

    def hits(self, px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of point and of triangle for every point in a closed triangle."""
        points, triangles = [], []
        stack = [(0, np.arange(len(px)))]
        while stack:
            node, who = stack.pop()
            box, kids, members = self.nodes[node]
            if box is None or not len(who):
                continue
            who = who[(px[who] >= box[0]) & (px[who] <= box[2]) & (py[who] >= box[1]) & (py[who] <= box[3])]
            if not len(who):
                continue
            if kids:
                stack += [(kids[0], who), (kids[1], who)]
                continue
            for t in members:
                ok = inside_triangle(self.corners[t], px[who], py[who])
                points.append(who[ok])
                triangles.append(np.full(int(ok.sum()), t))
        empty = np.zeros(0, np.int64)
        return (np.concatenate(points), np.concatenate(triangles)) if points else (empty, empty)


def inside_triangle(c: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """Exact: products of scaled degrees may pass 64 bits, so far ones are decided in Python integers."""
    ok = np.ones(len(px), bool)
    for (ax, ay), (bx, by) in (((c[0], c[1]), (c[2], c[3])), ((c[2], c[3]), (c[4], c[5])), ((c[4], c[5]), (c[0], c[1]))):
        dx, dy = int(bx) - int(ax), int(by) - int(ay)
        side = float(dx) * (py - ay) - float(dy) * (px - ax)
        sure = np.abs(side) > 1e5 + 1e-14 * (abs(dx) * np.abs(py - ay).astype(float) + abs(dy) * np.abs(px - ax).astype(float)) * 8
        good = side > 0
        for k in np.flatnonzero(~sure & ok):
            good[k] = dx * (int(py[k]) - int(ay)) - dy * (int(px[k]) - int(ax)) >= 0
        ok &= good
    return ok


_CORNERS = ["x1", "y1", "x2", "y2", "x3", "y3"]


def _scaled(col: str) -> Column:
    return F.bround(F.col(col) * F.lit(float(SCALE)), 0).cast("long")


def points_in_areas(points: DataFrame, areas: DataFrame, key: str = "area_key", coordinates: str = "coordinates") -> DataFrame:
    """``key`` and ``area`` of every point (``key``, ``lat``, ``lon``) inside an area or on its edge, each pair once.

    The triangles are counted first: a small hierarchy goes to every task, a large set of triangles is shuffled by
    tiles of the map instead, with one hierarchy per tile and batch of points.
    """
    spark = points.sparkSession
    triangles = area_triangles(areas, key, coordinates)
    scaled = points.select("key", _scaled("lon").alias("px"), _scaled("lat").alias("py"))
    few = triangles.limit(TREE_TRIANGLES + 1).toPandas()
    if len(few) <= TREE_TRIANGLES:
        sent = spark.sparkContext.broadcast((few["area"].tolist(), few[_CORNERS].to_numpy(np.int64).reshape(-1, 6)))

        def look_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, corners = sent.value
            tree = TriangleTree(corners)
            for pdf in frames:
                who, which = tree.hits(pdf["px"].to_numpy(np.int64), pdf["py"].to_numpy(np.int64))
                if len(who):
                    yield pd.DataFrame({"key": pdf["key"].to_numpy()[who], "area": [names[t] for t in which]}).drop_duplicates()

        return scaled.mapInPandas(look_up, "key string, area string").distinct()
    return _by_tile(scaled, triangles)


def _by_tile(scaled: DataFrame, triangles: DataFrame) -> DataFrame:
    """The shuffled way: triangles are copied to the tiles their boxes touch, and each tile's points go through its hierarchy.

    Points and triangles of a full tile are dealt into parts of about ``TILE_ROWS``, of which every part of one side meets
    every part of the other, so that no task holds more.
    """
    tile = int(TILE_DEG * SCALE)
    low = lambda *c: F.floor(F.least(*c) / tile)
    high = lambda *c: F.floor(F.greatest(*c) / tile)
    laid = triangles.withColumn("tx", F.explode(F.sequence(low("x1", "x2", "x3"), high("x1", "x2", "x3")))).withColumn("ty", F.explode(F.sequence(low("y1", "y2", "y3"), high("y1", "y2", "y3"))))
    placed = scaled.withColumn("tx", F.floor(F.col("px") / tile)).withColumn("ty", F.floor(F.col("py") / tile))
    parts = lambda df, name: df.groupBy("tx", "ty").agg(F.ceil(F.count(F.lit(1)) / TILE_ROWS).cast("long").alias(name))
    full = parts(placed, "points").join(parts(laid, "shapes"), ["tx", "ty"])
    dealt = lambda df, own, other, *by: df.join(full, ["tx", "ty"]).withColumn(own[0], F.pmod(F.xxhash64(*by), F.col(own))).withColumn(other[0], F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
    at = ["tx", "ty", "p", "s"]
    points = dealt(placed, "points", "shapes", "key", "px", "py").select(*at, "key", "px", "py")
    shapes = dealt(laid, "shapes", "points", "area", *_CORNERS).select(*at, "area", *_CORNERS)

    def look_up(where: pd.DataFrame, shape: pd.DataFrame) -> pd.DataFrame:
        who, which = TriangleTree(shape[_CORNERS].to_numpy(np.int64).reshape(-1, 6)).hits(where["px"].to_numpy(np.int64), where["py"].to_numpy(np.int64))
        return pd.DataFrame({"key": where["key"].to_numpy()[who], "area": shape["area"].to_numpy()[which]}, dtype=object).drop_duplicates()

    return points.groupBy(*at).cogroup(shapes.groupBy(*at)).applyInPandas(look_up, "key string, area string").distinct()


def crosses_itself(ring) -> bool:
    """True if two edges of a ring cross properly; edges are compared along a sweep over x, exact in scaled integers."""
    points = _clean_ring(ring)
    edges = sorted(((min(a, b), max(a, b)) for a, b in zip(points, points[1:] + points[:1], strict=True)), key=lambda e: e[0][0])
    live: list[tuple] = []
    for a, b in edges:
        live = [e for e in live if e[1][0] >= a[0]]
        if any(_crosses(a, b, c, d) for c, d in live if min(a[1], b[1]) <= max(c[1], d[1]) and min(c[1], d[1]) <= max(a[1], b[1])):
            return True
        live.append((a, b))
    return False


def invalid_areas(areas: DataFrame, key: str = "area_key", coordinates: str = "coordinates") -> DataFrame:
    """``area`` and ``issue`` of areas that can't be used: without ring, with an open or crossing one."""
    once = areas.select(F.col(key).cast("string").alias("area"), F.col(coordinates).alias("polygons"))

    def issue(polygons) -> str | None:
        rings = [r for p in ([] if polygons is None else polygons) if p is not None for r in p if r is not None]
        if not rings or any(not _clean_ring(r) for r in rings):
            return "RING_DEGENERATE" if rings else "EMPTY"
        if any(list(r[0]) != list(r[-1]) for r in rings):
            return "RING_OPEN"
        return "RING_CROSSES_ITSELF" if any(crosses_itself(r) for r in rings) else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(a, i) for a, p in zip(pdf["area"], pdf["polygons"], strict=True) if (i := issue(p))]
            if rows:
                yield pd.DataFrame(rows, columns=["area", "issue"])

    return once.mapInPandas(run, "area string, issue string")


def area_edges(areas: DataFrame, key: str = "area_key", coordinates: str = "coordinates") -> DataFrame:
    """``area`` and the ends (x1, y1, x2, y2 in degrees) of every edge of every ring, rings closed if they aren't."""
    ring = areas.select(F.col(key).cast("string").alias("area"), F.posexplode(F.flatten(coordinates)).alias("ring", "r")).filter(F.size("r") > 2)
    closed = ring.withColumn("r", F.when(F.get("r", F.lit(0)) == F.element_at("r", -1), F.col("r")).otherwise(F.concat("r", F.slice("r", 1, 1))))
    pairs = F.zip_with(F.slice("r", F.lit(1), F.size("r") - 1), F.slice("r", F.lit(2), F.size("r") - 1), lambda a, b: F.struct(F.get(a, F.lit(0)).alias("x1"), F.get(a, F.lit(1)).alias("y1"), F.get(b, F.lit(0)).alias("x2"), F.get(b, F.lit(1)).alias("y2")))
    return closed.select("area", F.inline(pairs)).distinct()


def point_coverage(points: DataFrame, areas: DataFrame, key: str = "area_key", coordinates: str = "coordinates") -> DataFrame:
    """``key``, ``area`` and ``coverage`` (inside, boundary, outside) of points that each name the ``area`` to be held against.

    On an edge is on the boundary; else the number of edges a ray to the east crosses decides. One join and one aggregation
    of built-in expressions; use ``points_in_areas`` where the area isn't known.
    """
    edges = area_edges(areas, key, coordinates)
    e = points.select("key", "area", "lat", "lon").join(edges, "area")
    side = (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) - (F.col("y2") - F.col("y1")) * (F.col("lon") - F.col("x1"))
    within = F.col("lon").between(F.least("x1", "x2"), F.greatest("x1", "x2")) & F.col("lat").between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    crossed = ((F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))) & ((side > 0) == (F.col("y2") > F.col("y1")))
    by = e.groupBy("key", "area").agg(F.bool_or((side == 0) & within).alias("edge"), F.count_if(crossed).alias("crossed"))
    return by.select("key", "area", F.when(F.col("edge"), "boundary").when(F.col("crossed") % 2 == 1, "inside").otherwise("outside").alias("coverage"))


def p5_found(spark, sf_dir: str) -> DataFrame:
    """``key_a``, ``key_b``: candidates at most 100 m apart, and candidates with the areas they lie in."""
    rows = spark.read.parquet(f"{sf_dir}/candidates.parquet")
    points = positions(rows, "candidate_id", F.col("geography.latitude"), F.col("geography.longitude"))
    areas = spark.read.parquet(f"{sf_dir}/market_areas.parquet")
    inside = points_in_areas(spread(points), areas).select(F.col("key").alias("key_a"), F.col("area").alias("key_b"))
    return near_pairs(points, 100.0).unionByName(inside)
