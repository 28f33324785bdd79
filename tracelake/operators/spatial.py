"""Spatial operations on longitude and latitude columns, with grid cells as join keys."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.operators.relational import join_in_blocks
from tracelake.session import cut, share_code

EARTH_M = 6_371_008.8
DEGREE_M = math.pi * EARTH_M / 180
# WGS84 semi-axes in metres
WGS84_A, WGS84_B = 6_378_137.0, 6_356_752.314245


def wkt_point(lon: Column, lat: Column) -> Column:
    return F.concat(F.lit("POINT ("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))


def parse_wkt_point(wkt: Column) -> Column:
    """A struct of lon and lat; null if the text is no point."""
    n = r"(-?[0-9.]+(?:E-?[0-9]+)?)"
    get = lambda i: F.regexp_extract(wkt, rf"^POINT \({n} {n}\)$", i).try_cast("double")
    return F.struct(get(1).alias("lon"), get(2).alias("lat"))


def geojson_point(lon: Column, lat: Column) -> Column:
    """A GeoJSON point; null if a coordinate is null."""
    return F.when(lon.isNotNull() & lat.isNotNull(), F.to_json(F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))))


def geojson_polygon(rings: Column) -> Column:
    """A GeoJSON polygon of rings (arrays of lon, lat structs), the outer one first; a null array gives null."""
    flat = F.transform(rings, lambda ring: F.transform(ring, lambda p: F.array(p["lon"], p["lat"])))
    return F.when(rings.isNotNull(), F.to_json(F.struct(F.lit("Polygon").alias("type"), flat.alias("coordinates"))))


def _geometry(text: Column, kind: str, coordinates: str) -> Column:
    """The coordinates of a GeoJSON geometry of a kind, bare or within a feature; null for any other text."""
    bare = F.when(F.get_json_object(text, "$.type") == "Feature", F.get_json_object(text, "$.geometry")).otherwise(text)
    read = F.from_json(bare, f"type string, coordinates {coordinates}")
    return F.when(read["type"] == kind, read["coordinates"])


def parse_geojson_point(text: Column) -> Column:
    """A struct of lon and lat; nulls if the text is no point. A height is left out."""
    at = _geometry(text, "Point", "array<double>")
    good = F.size(at) >= 2
    return F.struct(F.when(good, F.get(at, F.lit(0))).alias("lon"), F.when(good, F.get(at, F.lit(1))).alias("lat"))


def parse_geojson_polygon(text: Column) -> Column:
    """The rings of a polygon, arrays of lon, lat structs, the outer one first; null if the text is no polygon."""
    rings = _geometry(text, "Polygon", "array<array<array<double>>>")
    return F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat"))))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two points on a sphere of the earth's mean radius."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def ellipsoid_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between near points on the WGS84 ellipsoid: arc lengths by the radii of curvature at the mean latitude.

    Good to about a millimetre a kilometre up to some tens of kilometres.
    """
    mid = F.radians((lat1 + lat2) / 2)
    e2 = 1 - (WGS84_B / WGS84_A) ** 2
    den = 1 - e2 * F.pow(F.sin(mid), 2)
    north = F.radians(lat2 - lat1) * WGS84_A * (1 - e2) / F.pow(den, 1.5)
    east = F.radians(lon2 - lon1) * F.cos(mid) * WGS84_A / F.sqrt(den)
    return F.sqrt(north * north + east * east)


def distance_matrix(df: DataFrame, group: str, key: str, lon: str, lat: str) -> DataFrame:
    """(group, a, b, metres) of all pairs a < b within a group. Rows grow with the squares of the groups; pairs are dealt out evenly."""
    left = df.select(group, F.col(key).alias("a"), F.col(lon).alias("_x"), F.col(lat).alias("_y"))
    right = df.select(group, F.col(key).alias("b"), F.col(lon).alias("_x2"), F.col(lat).alias("_y2"))
    return join_in_blocks(left, right, [group]).where("a < b").select(group, "a", "b", haversine(F.col("_x"), F.col("_y"), F.col("_x2"), F.col("_y2")).alias("metres"))


def in_box(df: DataFrame, lon: str, lat: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows within (west, south, east, north); plain comparisons, which reach the Parquet scan."""
    west, south, east, north = box
    return df.where(F.col(lon).between(west, east) & F.col(lat).between(south, north))


def near(df: DataFrame, lon: str, lat: str, at: tuple[float, float], metres: float, k: int, key: str) -> DataFrame:
    """The k rows nearest to a point within so many metres: the box first, then the exact distance."""
    x, y = at
    dy = metres / DEGREE_M
    dx = dy / max(0.01, math.cos(math.radians(min(89.0, abs(y) + dy))))
    t = in_box(df, lon, lat, (x - dx, y - dy, x + dx, y + dy)).withColumn("metres", haversine(F.lit(x), F.lit(y), F.col(lon), F.col(lat)))
    return t.where(F.col("metres") <= metres).orderBy("metres", key).limit(k)


def inside(lon: Column, lat: Column, ring: Column) -> Column:
    """Whether a point lies in a closed ring (array of lon, lat structs), by counting crossed edges."""
    n = F.size(ring)

    def crossed(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, i + 1)
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        return F.when(spans, (lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) + a["lon"]).cast("int")).otherwise(0)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 2), crossed), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) % 2 == 1


def points_in_polygons(points: DataFrame, zones: DataFrame, lon: str, lat: str, cell: float = 5.0) -> DataFrame:
    """points with every zone (zone, ring) that holds them: an equi-join on grid cells of the zone's box, then the test."""
    xs, ys = F.transform("ring", lambda p: p["lon"]), F.transform("ring", lambda p: p["lat"])
    at = lambda c: F.floor(c / cell)
    z = zones.withColumn("_cx", F.explode(F.sequence(at(F.array_min(xs)), at(F.array_max(xs))))).withColumn("_cy", F.explode(F.sequence(at(F.array_min(ys)), at(F.array_max(ys)))))
    p = points.withColumns({"_cx": at(F.col(lon)), "_cy": at(F.col(lat))})
    return p.join(z, ["_cx", "_cy"]).where(inside(F.col(lon), F.col(lat), F.col("ring"))).drop("_cx", "_cy", "ring")


#: Rows in a cell beyond which knn looks near at hand first.
DENSE = 64


def _cell(lon: str, lat: str, metres: float) -> tuple[Column, Column]:
    """Column and line of the cell of a place, on a grid of cells one radius wide; about the poles, where a radius may span all columns, lines have the one column -1."""
    size = metres / DEGREE_M
    columns = max(1, math.floor(360 / size))  # whole columns, so that the first and the last are neighbours
    column = F.pmod(F.floor((F.col(lon) + 180) * columns / 360), F.lit(columns)).cast("long")
    return F.when(F.abs(F.col(lat)) >= 89 - 2 * size, F.lit(-1).cast("long")).otherwise(column), F.floor(F.col(lat) / size).cast("long")


def _nearest(places: DataFrame, right: DataFrame, other: str, metres: float, k: int) -> DataFrame:
    """(_x, _y, other, metres, rank): the k nearest rows of right (other, _x2, _y2) within a radius of each place.

    Each place asks its own cell and those around it. Columns of longitude shrink towards the poles, so places ask as
    many columns as the radius spans at their latitude.
    """
    size = metres / DEGREE_M
    columns = max(1, math.floor(360 / size))
    reach = F.ceil(1 / F.cos(F.radians(F.least(F.lit(89.0), F.abs(F.col("_y")) + size)))).cast("long")
    reach = F.least(reach, F.lit(columns).cast("long"))
    cx, cy = F.floor((F.col("_x") + 180) * columns / 360).cast("long"), F.floor(F.col("_y") / size).cast("long")
    around = F.transform(F.sequence(cx - reach, cx + reach), lambda x: F.pmod(x, F.lit(columns)).cast("long"))
    around = F.array_distinct(F.when(F.abs(F.col("_y")) >= 89 - 3 * size, F.array_append(around, F.lit(-1).cast("long"))).otherwise(around))
    left = places.withColumn("_gx", F.explode(around)).withColumn("_gy", F.explode(F.sequence(cy - 1, cy + 1)))
    gx, gy = _cell("_x2", "_y2", metres)
    d = join_in_blocks(left, right.withColumns({"_gx": gx, "_gy": gy}), ["_gx", "_gy"])
    d = d.withColumn("metres", haversine(F.col("_x"), F.col("_y"), F.col("_x2"), F.col("_y2"))).where(F.col("metres") <= metres)
    rank = F.row_number().over(W.partitionBy("_x", "_y").orderBy("metres", other))
    return d.withColumn("rank", rank).where(F.col("rank") <= k).select("_x", "_y", other, "metres", "rank")


def knn(a: DataFrame, b: DataFrame, key: str, other: str, lon: str, lat: str, metres: float, k: int) -> DataFrame:
    """(key, other, metres, rank): the k nearest rows of b within a radius of each row of a; equal distances by other.

    Rows of a at one place are asked for once, and of rows of b at one place only the first k can be among the nearest.
    Where b is dense, a part of the radius is looked at first: who has k rows there has the nearest ones, the others ask
    four times as far until the radius is reached.
    """
    left = a.select(F.col(key), F.col(lon).alias("_x"), F.col(lat).alias("_y"))
    first = F.row_number().over(W.partitionBy("_x2", "_y2").orderBy(other))
    right = b.select(F.col(other), F.col(lon).alias("_x2"), F.col(lat).alias("_y2")).where(F.col("_x2").isNotNull() & F.col("_y2").isNotNull())
    right = cut(right.withColumn("_r", first).where(F.col("_r") <= k).drop("_r"))
    most = right.groupBy(*_cell("_x2", "_y2", metres)).count().agg(F.max("count")).first()[0] or 0
    halved = math.ceil(math.log(max(1, most / DENSE), 4))
    places, found = left.select("_x", "_y").where(F.col("_x").isNotNull() & F.col("_y").isNotNull()).distinct(), None
    while halved > 0:
        near = _nearest(places, right, other, metres / 2**halved, k)
        full = cut(near.withColumn("_n", F.max("rank").over(W.partitionBy("_x", "_y"))).where(F.col("_n") >= k).drop("_n"))
        found = full if found is None else found.unionByName(full)
        places = cut(places.join(full.select("_x", "_y").distinct(), ["_x", "_y"], "left_anti"))
        halved -= 2
    near = _nearest(places, right, other, metres, k)
    found = near if found is None else found.unionByName(near)
    return left.join(found, ["_x", "_y"]).select(key, other, "metres", "rank")


def density(df: DataFrame, lon: str, lat: str, degrees: float) -> DataFrame:
    """(cx, cy, n, lon, lat): counts by square cell with the cell's centre."""
    cell = lambda c: F.floor(F.col(c) / degrees).cast("long")
    g = df.groupBy(cell(lon).alias("cx"), cell(lat).alias("cy")).agg(F.count("*").alias("n"))
    return g.withColumns({"lon": (F.col("cx") + 0.5) * degrees, "lat": (F.col("cy") + 0.5) * degrees})


def with_neighbours(cells: DataFrame) -> DataFrame:
    """cells with the count of the ring around them."""
    ring = [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1) if (x, y) != (0, 0)]
    spread = cells.select(F.explode(F.array(*[F.struct((F.col("cx") + x).alias("cx"), (F.col("cy") + y).alias("cy")) for x, y in ring])).alias("c"), "n").groupBy("c.cx", "c.cy").agg(F.sum("n").alias("around"))
    return cells.join(spread, ["cx", "cy"], "left").withColumn("around", F.coalesce("around", F.lit(0)))


def hex_cell(x: Column, y: Column, size: float) -> Column:
    """Axial coordinates (q, r) of the hexagon that holds a point of the plane: hexagons of the given side stand on a corner, the one of (0, 0) around the origin.

    The three cube coordinates are rounded, halves up, and the one that was moved most is set by the other two.
    """
    q, r = (F.sqrt(F.lit(3.0)) / 3 * x - y / 3.0) / size, F.lit(2.0) / 3 * y / size
    s = -q - r
    rq, rr, rs = (F.floor(c + 0.5) for c in (q, r, s))
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    most_q, most_r = (dq > dr) & (dq > ds), dr > ds
    return F.struct(F.when(most_q, -rr - rs).otherwise(rq).cast("long").alias("q"), F.when(~most_q & most_r, -rq - rs).otherwise(rr).cast("long").alias("r"))


def hex_centre(q: Column, r: Column, size: float) -> Column:
    """The centre (x, y) of a hexagon."""
    return F.struct((size * F.sqrt(F.lit(3.0)) * (q + r / 2)).alias("x"), (F.lit(1.5) * size * r).alias("y"))


def hex_boundary(q: Column, r: Column, size: float) -> Column:
    """The closed ring (array of lon, lat) of a hexagon: six corners from the upper right on, and the first again."""
    c = hex_centre(q, r, size)
    corner = lambda i: F.struct((c["x"] + size * math.cos(math.radians(60 * (i % 6) + 30))).alias("lon"), (c["y"] + size * math.sin(math.radians(60 * (i % 6) + 30))).alias("lat"))
    return F.array(*[corner(i) for i in range(7)])


def hex_disk(k: int) -> list[tuple[int, int]]:
    """Steps (q, r) to all hexagons at most k away, the middle one among them."""
    return [(q, r) for q in range(-k, k + 1) for r in range(max(-k, -q - k), min(k, -q + k) + 1)]


def hex_density(df: DataFrame, lon: str, lat: str, size: float) -> DataFrame:
    """(q, r, n, lon, lat, ring): counts by hexagon, with its centre and boundary; rows without a place are not counted."""
    g = df.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).groupBy(hex_cell(F.col(lon), F.col(lat), size).alias("_h")).agg(F.count("*").alias("n"))
    c = hex_centre(F.col("_h.q"), F.col("_h.r"), size)
    return g.select("_h.q", "_h.r", "n", c["x"].alias("lon"), c["y"].alias("lat"), hex_boundary(F.col("_h.q"), F.col("_h.r"), size).alias("ring"))


def with_hex_rings(cells: DataFrame, k: int) -> DataFrame:
    """cells with around: the count of all other hexagons at most k away."""
    steps = [F.struct((F.col("q") + q).alias("q"), (F.col("r") + r).alias("r")) for q, r in hex_disk(k) if (q, r) != (0, 0)]
    spread = cells.select(F.explode(F.array(*steps)).alias("c"), "n").groupBy("c.q", "c.r").agg(F.sum("n").alias("around"))
    return cells.join(spread, ["q", "r"], "left").withColumn("around", F.coalesce("around", F.lit(0)))


def measures(df: DataFrame, key: str, ring: str) -> DataFrame:
    """(key, area, length, cx, cy): planar area, perimeter and mean corner of closed rings."""
    edge = F.transform(F.sequence(F.lit(0), F.size(ring) - 2), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, i + 1).alias("b")))
    total = lambda f: F.aggregate(F.transform(edge, f), F.lit(0.0), lambda s, x: s + x)
    cross = lambda e: e["a"]["lon"] * e["b"]["lat"] - e["b"]["lon"] * e["a"]["lat"]
    size = lambda e: F.sqrt(F.pow(e["a"]["lon"] - e["b"]["lon"], 2) + F.pow(e["a"]["lat"] - e["b"]["lat"], 2))
    n = F.size(ring) - 1
    return df.select(key, (F.abs(total(cross)) / 2).alias("area"), total(size).alias("length"), (total(lambda e: e["a"]["lon"]) / n).alias("cx"), (total(lambda e: e["a"]["lat"]) / n).alias("cy"))


def relate_boxes(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """(a, b, relation) of boxes (xmin, ymin, xmax, ymax) that share a key: equal, contains, within, intersects, disjoint."""
    side = lambda df, p: df.select(on, *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != on])
    j = join_in_blocks(side(a, "a"), side(b, "b"), [on])
    c = {f"{p}{k}": F.col(f"{p}_{k}") for p in "ab" for k in ("xmin", "ymin", "xmax", "ymax")}
    holds = lambda p, q: (c[p + "xmin"] <= c[q + "xmin"]) & (c[p + "ymin"] <= c[q + "ymin"]) & (c[p + "xmax"] >= c[q + "xmax"]) & (c[p + "ymax"] >= c[q + "ymax"])
    apart = (c["axmin"] > c["bxmax"]) | (c["bxmin"] > c["axmax"]) | (c["aymin"] > c["bymax"]) | (c["bymin"] > c["aymax"])
    rel = F.when(holds("a", "b") & holds("b", "a"), "equal").when(holds("a", "b"), "contains").when(holds("b", "a"), "within").when(apart, "disjoint").otherwise("intersects")
    return j.withColumn("relation", rel)


def _orient(ax, ay, bx, by, cx, cy):
    """Twice the signed area of triangles a, b, c."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _sides(ring: np.ndarray, other: np.ndarray) -> tuple[bool, bool, bool]:
    """Whether parts of a closed ring lie inside another, and outside of it, and whether the two rings meet.

    Each edge is cut where it meets the other ring; the middle of every piece is on the ring, inside or outside.
    """
    o1, o2 = other[:-1], other[1:]
    inside = outside = meets = False
    for (ax, ay), (bx, by) in zip(ring[:-1], ring[1:], strict=True):
        d1, d2 = _orient(ax, ay, bx, by, o1[:, 0], o1[:, 1]), _orient(ax, ay, bx, by, o2[:, 0], o2[:, 1])
        e1, e2 = _orient(o1[:, 0], o1[:, 1], o2[:, 0], o2[:, 1], ax, ay), _orient(o1[:, 0], o1[:, 1], o2[:, 0], o2[:, 1], bx, by)
        span = (bx - ax) ** 2 + (by - ay) ** 2
        if not span:
            continue
        at = [np.array([0.0, 1.0])]
        crossed = (d1 * d2 <= 0) & (e1 * e2 <= 0) & (e1 != e2)
        at.append(e1[crossed] / (e1[crossed] - e2[crossed]))
        # corners of the other ring that lie on this edge, those of edges along it too
        along = ((o1[:, 0] - ax) * (bx - ax) + (o1[:, 1] - ay) * (by - ay)) / span
        touched = (d1 == 0) & (along >= 0) & (along <= 1)
        at.append(along[touched])
        own = (_on(ax, ay, o1, o2)).any()
        meets = meets or bool(crossed.any() or touched.any() or own)
        cuts = np.unique(np.clip(np.concatenate(at), 0, 1))
        for t in ((cuts[:-1] + cuts[1:]) / 2)[np.diff(cuts) > 1e-12]:
            x, y = ax + t * (bx - ax), ay + t * (by - ay)
            flat = (d1 == 0) & (d2 == 0)  # edges of the other ring along this one
            if flat.any():
                p = ((o1[flat, 0] - ax) * (bx - ax) + (o1[flat, 1] - ay) * (by - ay)) / span
                q = ((o2[flat, 0] - ax) * (bx - ax) + (o2[flat, 1] - ay) * (by - ay)) / span
                if ((np.minimum(p, q) <= t) & (t <= np.maximum(p, q))).any():
                    continue
            spans = (o1[:, 1] > y) != (o2[:, 1] > y)
            s1, s2 = o1[spans], o2[spans]
            left = x < (s2[:, 0] - s1[:, 0]) * (y - s1[:, 1]) / (s2[:, 1] - s1[:, 1]) + s1[:, 0]
            if left.sum() % 2:
                inside = True
            else:
                outside = True
    return inside, outside, meets


def _on(x: float, y: float, o1: np.ndarray, o2: np.ndarray) -> np.ndarray:
    """Which edges a point lies on."""
    box = (np.minimum(o1, o2) <= (x, y)).all(1) & (np.maximum(o1, o2) >= (x, y)).all(1)
    return box & (_orient(o1[:, 0], o1[:, 1], o2[:, 0], o2[:, 1], x, y) == 0)


def relation(a: np.ndarray, b: np.ndarray) -> str:
    """How the areas of two simple polygons (closed rings of x, y) lie: equal, contains, within, intersects, touches or disjoint."""
    a_in, a_out, met = _sides(a, b)
    b_in, b_out, _ = _sides(b, a)
    if not (a_in or a_out or b_in or b_out):
        return "equal"
    if a_in and a_out or b_in and b_out or a_in and b_in:
        return "intersects"
    if a_in or not a_out:
        return "within"
    if b_in or not b_out:
        return "contains"
    return "touches" if met else "disjoint"


def relate_polygons(a: DataFrame, b: DataFrame, id_a: str, id_b: str, ring: str = "ring", cell: float = 1.0) -> DataFrame:
    """(id_a, id_b, relation) of the polygons whose boxes meet: equal, contains, within, intersects, touches, disjoint.

    Rings are arrays of (lon, lat), closed and without crossings; contains and within allow shared borders, touches means
    that borders meet and areas don't. Pairs whose boxes do not meet are disjoint and not listed, so that no pair is made
    of polygons far apart: both sides are dealt over the grid cells of their boxes, and a pair is looked at in the one
    cell where both have begun. Equal rings are looked at once, and what is found holds for all pairs of their rows.
    Null rings and those of fewer than three edges are left out. Choose the cell near the size of a common polygon.
    """
    at = lambda c: F.floor(c / cell)

    def shaped(df: DataFrame, key: str, side: str) -> tuple[DataFrame, DataFrame]:
        """Rows (id, shape), and distinct shapes."""
        xs, ys = F.transform(ring, lambda p: p["lon"].cast("double")), F.transform(ring, lambda p: p["lat"].cast("double"))
        t = df.where(F.size(ring) >= 4).select(F.col(key).alias(f"{side}_id"), xs.alias(f"{side}_xs"), ys.alias(f"{side}_ys"))
        of = [f"{side}_xs", f"{side}_ys"]
        shapes = cut(t.select(*of).distinct().withColumn(f"{side}_shape", F.monotonically_increasing_id()))
        return t.join(shapes, of).select(f"{side}_id", f"{side}_shape"), shapes

    def dealt(t: DataFrame, side: str) -> DataFrame:
        t = t.select("*", *[f(F.col(f"{side}_{c}s")).alias(f"{side}_{c}{n}") for c in "xy" for n, f in (("lo", F.array_min), ("hi", F.array_max))])
        return t.withColumn("_cx", F.explode(F.sequence(at(F.col(f"{side}_xlo")), at(F.col(f"{side}_xhi"))))).withColumn("_cy", F.explode(F.sequence(at(F.col(f"{side}_ylo")), at(F.col(f"{side}_yhi")))))

    (rows_a, shapes_a), (rows_b, shapes_b) = shaped(a, id_a, "a"), shaped(b, id_b, "b")
    j = join_in_blocks(dealt(shapes_a, "a"), dealt(shapes_b, "b"), ["_cx", "_cy"], 256, 1 << 14)
    first = (F.col("_cx") == at(F.greatest("a_xlo", "b_xlo"))) & (F.col("_cy") == at(F.greatest("a_ylo", "b_ylo")))
    boxes = (F.col("a_xlo") <= F.col("b_xhi")) & (F.col("b_xlo") <= F.col("a_xhi")) & (F.col("a_ylo") <= F.col("b_yhi")) & (F.col("b_ylo") <= F.col("a_yhi"))
    met = j.where(first & boxes).select("a_shape", "b_shape", "a_xs", "a_ys", "b_xs", "b_ys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(i) for i in range(2, 6)]
            told = [relation(np.stack([x1.values.to_numpy(), y1.values.to_numpy()], 1), np.stack([x2.values.to_numpy(), y2.values.to_numpy()], 1)) for x1, y1, x2, y2 in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(told, pa.string())], names=["a_shape", "b_shape", "relation"])

    share_code(a.sparkSession)
    found = cut(met.mapInArrow(run, "a_shape long, b_shape long, relation string"))
    return join_in_blocks(rows_a.join(found, "a_shape").drop("a_shape"), rows_b, ["b_shape"]).select("a_id", "b_id", "relation")
