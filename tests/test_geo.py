import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.operators import geo


def haversine(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * geo.EARTH_RADIUS_M * math.asin(math.sqrt(h))


def test_near_pairs_everywhere(spark):
    rnd = random.Random(3)
    pts = [(f"k{k:03d}", rnd.choice([89.9995, 0, 60, -75]) + rnd.uniform(-0.002, 0.0005), rnd.choice([-180, 179.998, 10]) + rnd.uniform(0, 0.002)) for k in range(300)]
    pts += [("same1", 50.0, 7.0), ("same2", 50.0, 7.0), ("same1", 50.0, 7.0)]
    got = {(r.key_a, r.key_b) for r in geo.near_pairs(spark.createDataFrame(pts, "key string, lat double, lon double"), 100.0).collect()}
    want = {(min(a[0], b[0]), max(a[0], b[0])) for k, a in enumerate(pts) for b in pts[k + 1 :] if a[0] != b[0] and haversine(a[1:], b[1:]) <= 100}
    assert got == want


def test_positions_defined_cases(spark):
    rows = [("a", "1.5", "2.5"), ("a", "1.5", "2.5"), ("b", None, "1"), ("c", "0", "0"), ("d", "0", "1"), ("e", "91", "0"), (None, "1", "1")]
    df = spark.createDataFrame(rows, "id string, la string, lo string").select("id", F.col("la").cast("decimal(9,6)").alias("la"), F.col("lo").cast("decimal(9,6)").alias("lo"))
    assert sorted(r.key for r in geo.positions(df, "id", F.col("la"), F.col("lo")).collect()) == ["a", "d"]


SQUARE = [[[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0], [0.0, 0.0]], [[4.0, 4.0], [6.0, 4.0], [6.0, 6.0], [4.0, 6.0], [4.0, 4.0]]]


def test_inside_edge_hole(spark, monkeypatch):
    areas = spark.createDataFrame([("sq", [SQUARE]), ("sq", [SQUARE]), ("none", None), ("flat", [[[[0.0, 0.0], [1.0, 1.0]]]])], "area_key string, coordinates array<array<array<array<double>>>>")
    cases = {"in": (2.0, 2.0, "inside"), "edge": (5.0, 0.0, "boundary"), "corner": (0.0, 0.0, "boundary"), "out": (5.0, -1.0, "outside"), "hole": (5.0, 5.0, "outside"), "rim": (5.0, 4.0, "boundary")}
    pts = spark.createDataFrame([(k, "sq", a, o) for k, (a, o, _) in cases.items()], "key string, area string, lat double, lon double")
    assert {r.key: r.coverage for r in geo.point_coverage(pts, areas).collect()} == {k: v[2] for k, v in cases.items()}
    want = {k for k, v in cases.items() if v[2] != "outside"}
    assert {r.key for r in geo.points_in_areas(pts.select("key", "lat", "lon"), areas).collect()} == want
    scaled = pts.select("key", geo._scaled("lon").alias("px"), geo._scaled("lat").alias("py"))
    for rows in (geo.TILE_ROWS, 1):
        monkeypatch.setattr(geo, "TILE_ROWS", rows)
        assert sorted(r.key for r in geo._by_tile(scaled, geo.area_triangles(areas)).collect()) == sorted(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 359), st.floats(1, 9)), min_size=3, max_size=25, unique_by=lambda p: p[0]), st.booleans())
def test_triangles_cover_star_shapes(spokes, hole):
    ring = [[r * math.cos(math.radians(a)), r * math.sin(math.radians(a))] for a, r in sorted(spokes)]
    if max((b[0] - a[0]) % 360 for a, b in zip(sorted(spokes), sorted(spokes)[1:] + sorted(spokes)[:1], strict=True)) >= 170:
        return  # the centre must lie well inside
    rings = [ring] + ([[[0.05, 0.0], [0.0, 0.05], [-0.05, 0.0], [0.0, -0.05]]] if hole else [])
    clean = [geo._clean_ring(r) for r in rings]
    area = abs(geo._area2(clean[0])) - sum(abs(geo._area2(r)) for r in clean[1:])
    if hole and math.hypot(*min(ring, key=lambda p: math.hypot(*p))) < 1:
        return
    assert sum(geo._turn(*t) for t in geo.ear_clip(rings)) == area


def test_tree_matches_brute_force():
    rnd = np.random.default_rng(5)
    base = rnd.integers(-1000, 1000, (200, 2))
    corners = np.concatenate([base, base + [30, 3], base + [5, 40]], 1).astype(np.int64)
    px, py = rnd.integers(-1000, 1000, 500), rnd.integers(-1000, 1000, 500)
    who, which = geo.TriangleTree(corners).hits(px, py)
    want = {(int(p), t) for t in range(200) for p in np.flatnonzero(geo.inside_triangle(corners[t], px, py))}
    assert set(zip(who.tolist(), which.tolist(), strict=True)) == want
