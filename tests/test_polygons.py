"""Relations of polygons against the unit squares that they are made of, and by hand."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.operators import spatial


def polyomino(rng):
    """A set of unit squares without holes that share sides only, and the ring around it."""
    while True:
        cells = {(rng.randrange(4), rng.randrange(4))}
        for _ in range(rng.randrange(0, 9)):
            x, y = rng.choice(sorted(cells))
            dx, dy = rng.choice([(0, 1), (1, 0), (0, -1), (-1, 0)])
            cells.add((x + dx, y + dy))
        nxt: dict = {}
        for x, y in cells:
            for a, b, out in (((x, y), (x + 1, y), (x, y - 1)), ((x + 1, y), (x + 1, y + 1), (x + 1, y)), ((x + 1, y + 1), (x, y + 1), (x, y + 1)), ((x, y + 1), (x, y), (x - 1, y))):
                if out not in cells:
                    nxt.setdefault(a, []).append(b)
        if any(len(v) > 1 for v in nxt.values()):
            continue  # squares that meet at a corner only
        start = min(nxt)
        ring = [start]
        while len(ring) == 1 or ring[-1] != start:
            ring.append(nxt[ring[-1]][0])
        if len(ring) - 1 == len(nxt):
            return cells, ring


def plain(a, b):
    if a == b:
        return "equal"
    if a >= b:
        return "contains"
    if a <= b:
        return "within"
    if a & b:
        return "intersects"
    return "touches" if any((x + i, y + j) in b for x, y in a for i in (-1, 0, 1) for j in (-1, 0, 1)) else "disjoint"


def straight(ring):
    """The ring without corners on straight lines, begun anywhere, in either direction."""
    out = [p for a, p, b in zip([ring[-2], *ring[:-2]], ring[:-1], ring[1:], strict=True) if (p[0] - a[0]) * (b[1] - p[1]) != (p[1] - a[1]) * (b[0] - p[0])]
    return out


def test_squares_of_all_shapes(spark):
    rng = random.Random(12)
    shapes = []
    for i in range(150):
        cells, ring = polyomino(rng)
        pts = straight(ring) if i % 2 else ring[:-1]
        k = rng.randrange(len(pts))
        pts = (pts[k:] + pts[:k])[:: rng.choice([1, -1])]
        shapes.append((i, cells, [*pts, pts[0]]))
    df = spark.createDataFrame([(i, [(float(x), float(y)) for x, y in ring]) for i, _, ring in shapes] + [(900, None), (901, [(0.0, 0.0)])], "id int, ring array<struct<lon:double,lat:double>>").repartition(4)
    got = {(r["a_id"], r["b_id"]): r["relation"] for r in spatial.relate_polygons(df, df, "id", "id", cell=2.0).collect()}
    n = 0
    for i, a, _ in shapes:
        for j, b, _ in shapes:
            lo = lambda s, k: min(c[k] for c in s)
            hi = lambda s, k: max(c[k] for c in s) + 1
            if all(lo(a, k) <= hi(b, k) and lo(b, k) <= hi(a, k) for k in (0, 1)):
                assert got[i, j] == plain(a, b), (a, b)
                n += 1
            else:
                assert (i, j) not in got
    assert len(got) == n and {"equal", "contains", "within", "intersects", "touches", "disjoint"} == set(got.values())


@pytest.mark.parametrize(("a", "b", "want"), [
    ([(0, 0), (4, 0), (0, 4)], [(1, 1), (2, 1), (1, 2)], "contains"), ([(0, 0), (4, 0), (0, 4)], [(2, 2), (4, 4), (2, 4)], "touches"),
    ([(0, 0), (4, 0), (4, 4), (0, 4)], [(2, -1), (5, 2), (2, 5), (-1, 2)], "intersects"), ([(0, 0), (4, 0), (4, 4), (0, 4)], [(2, 0), (4, 2), (2, 4), (0, 2)], "contains"),
    ([(0, 0), (2, 0), (2, 2), (0, 2)], [(0, 0), (2, 2), (0, 4)], "intersects"), ([(0, 0), (2, 0), (1, 1)], [(0, 2), (1, 1), (2, 2)], "touches"),
    ([(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)], [(1, 4), (2, 2), (3, 4)], "disjoint"), ([(0, 0), (4, 0), (4, 4), (0, 4)], [(0, 0), (4, 4), (4, 0)], "contains"),
])
def test_by_hand(a, b, want):
    ring = lambda p: np.array([*p, p[0]], float)
    other = {"contains": "within"}.get(want, want)
    for flip in (1, -1):
        assert spatial.relation(ring(a[::flip]), ring(b)) == want and spatial.relation(ring(b), ring(a[::flip])) == other


def test_points_agree_with_polygons(spark):
    square = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0))])
    assert spark.range(1).select(spatial.inside(F.lit(1.0), F.lit(1.0), square).alias("i"), spatial.inside(F.lit(3.0), F.lit(1.0), square).alias("o")).first() == (True, False)


def test_geojson_in_and_out(spark):
    texts = [
        ('{"type": "Point", "coordinates": [1.5, -2]}', (1.5, -2.0)), ('{"type":"Point","coordinates":[1,2,30]}', (1.0, 2.0)),
        ('{"type":"Feature","properties":null,"geometry":{"coordinates":[3,4],"type":"Point"}}', (3.0, 4.0)),
        ('{"type":"Point","coordinates":[1]}', (None, None)), ('{"type":"Point","coordinates":[]}', (None, None)),
        ('{"type":"LineString","coordinates":[[1,2],[3,4]]}', (None, None)), ("no json", (None, None)), ("", (None, None)), (None, (None, None)),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, t string")
    got = {r["i"]: tuple(r["p"]) for r in df.select("i", spatial.parse_geojson_point(F.col("t")).alias("p")).collect()}
    assert [got[i] for i in range(len(texts))] == [want for _, want in texts]
    ring, hole = [(0.0, 0.0), (9.5, 0.0), (0.0, 9.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (1.0, 2.0), (1.0, 1.0)]
    rings = spark.createDataFrame([(1, [ring, hole]), (2, None), (3, [])], "i int, r array<array<struct<lon:double,lat:double>>>")
    out = {r["i"]: r for r in rings.select("i", spatial.geojson_polygon(F.col("r")).alias("t")).select("i", "t", spatial.parse_geojson_polygon(F.col("t")).alias("r")).collect()}
    assert json.loads(out[1]["t"]) == {"type": "Polygon", "coordinates": [[list(p) for p in x] for x in (ring, hole)]}
    assert [[tuple(p) for p in x] for x in out[1]["r"]] == [ring, hole]
    assert out[2]["t"] is None and out[2]["r"] is None and out[3]["r"] == []
    assert df.select(spatial.parse_geojson_polygon(F.col("t")).alias("r")).where("r is not null").count() == 0
    assert df.select(spatial.geojson_point(F.lit(None).cast("double"), F.lit(1.0)).alias("p")).where("p is not null").count() == 0
