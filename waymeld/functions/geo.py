"""Geometry as Column expressions: no UDF, so all of it stays in generated code.

Points are (lng, lat) or (x, y) doubles, a line is array<struct<x,y>>, a ring is a
closed line and a polygon is an array of rings, outer first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
EARTH_MEAN_M = 6_371_008.8
MERCATOR_M = 6_378_137.0
METRES_PER_LAT_DEGREE = 111_195.08


def _c(v) -> Column:
    return v if isinstance(v, Column) else (F.col(v) if isinstance(v, str) else F.lit(v))


def let(value: Column, body) -> Column:
    """Bind a sub-expression once, so that deep formulas do not grow with reuse."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clamp(v, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), _c(v)))


# --- distances -----------------------------------------------------------

def haversine_m(lat1, lng1, lat2, lng2, earth_m: float = EARTH_M) -> Column:
    lat1, lng1, lat2, lng2 = map(_c, (lat1, lng1, lat2, lng2))
    h = (F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2))
    return F.asin(F.sqrt(F.least(F.lit(1.0), h))) * (2 * earth_m)


def segment_fraction(px, py, ax, ay, bx, by, clamped: bool = True) -> Column:
    """Position of the foot of the perpendicular from p on a-b; 0 on an empty segment."""
    px, py, ax, ay, bx, by = map(_c, (px, py, ax, ay, bx, by))
    norm = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    t = F.when(norm == 0, 0.0).otherwise(F.try_divide((px - ax) * (bx - ax) + (py - ay) * (by - ay), norm))
    return clamp(t, 0.0, 1.0) if clamped else t


def point_segment(px, py, ax, ay, bx, by) -> Column:
    """Planar distance from p to segment a-b."""
    px, py, ax, ay, bx, by = map(_c, (px, py, ax, ay, bx, by))
    t = segment_fraction(px, py, ax, ay, bx, by)
    return F.hypot(px - (ax + t * (bx - ax)), py - (ay + t * (by - ay)))


def point_segment_m(lng, lat, a_lng, a_lat, b_lng, b_lat, per_degree: float = 111_195.0) -> Column:
    """Metres from a position to a segment, on the plane tangent at the position."""
    lng, lat, a_lng, a_lat, b_lng, b_lat = map(_c, (lng, lat, a_lng, a_lat, b_lng, b_lat))
    k = F.cos(F.radians(lat))
    return point_segment(F.lit(0.0), F.lit(0.0), (a_lng - lng) * k, a_lat - lat,
                         (b_lng - lng) * k, b_lat - lat) * per_degree


def interpolate(a, b, t) -> Column:
    a, b, t = map(_c, (a, b, t))
    return a + (b - a) * t


# --- projections ---------------------------------------------------------

def mercator_x(lng) -> Column:
    return F.radians(_c(lng)) * MERCATOR_M


def mercator_y(lat) -> Column:
    return F.log(F.tan(F.lit(0.7853981633974483) + F.radians(_c(lat)) / 2)) * MERCATOR_M


def mercator_lng(x) -> Column:
    return F.degrees(_c(x) / MERCATOR_M)


def mercator_lat(y) -> Column:
    return F.degrees(F.atan(F.sinh(_c(y) / MERCATOR_M)))


def local_x(lng, west, mid_lat) -> Column:
    return (_c(lng) - _c(west)) * METRES_PER_LAT_DEGREE * F.cos(F.radians(_c(mid_lat)))


def local_y(lat, south) -> Column:
    return (_c(lat) - _c(south)) * METRES_PER_LAT_DEGREE


def local_lng(x, west, mid_lat) -> Column:
    return _c(west) + _c(x) / (F.cos(F.radians(_c(mid_lat))) * METRES_PER_LAT_DEGREE)


def local_lat(y, south) -> Column:
    return _c(south) + _c(y) / METRES_PER_LAT_DEGREE


def _tm_forward(lat: Column, lng: Column, a: float, b: float, scale: float, lng0: float) -> Column:
    """Transverse Mercator by Krueger's series in the third flattening n."""
    n = (a - b) / (a + b)
    e = ((a * a - b * b) / (a * a)) ** 0.5
    big = a / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64)
    alpha = (n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16, 13 * n ** 2 / 48 - 3 * n ** 3 / 5, 61 * n ** 3 / 240)
    def series(p: Column) -> Column:
        east, north = p["eta"], p["xi"]
        for j, k in enumerate(alpha, 1):
            east = east + F.cos(p["xi"] * (2 * j)) * F.sinh(p["eta"] * (2 * j)) * k
            north = north + F.sin(p["xi"] * (2 * j)) * F.cosh(p["eta"] * (2 * j)) * k
        return F.struct((east * (scale * big)).alias("x"), (north * (scale * big)).alias("y"))

    def conformal(p: Column) -> Column:
        t = F.sinh(F.atanh(p["s"]) - F.atanh(p["s"] * e) * e)
        return F.struct(F.atan2(t, F.cos(p["lam"])).alias("xi"),
                        F.asinh(F.sin(p["lam"]) / F.hypot(t, F.cos(p["lam"]))).alias("eta"))

    start = F.struct(F.sin(F.radians(lat)).alias("s"), F.radians(lng - lng0).alias("lam"))
    return let(let(let(start, conformal), series), lambda p: p)


def utm30(lat, lng) -> Column:
    """struct(x, y): easting and northing in UTM zone 30N (WGS84)."""
    plane = _tm_forward(_c(lat), _c(lng), 6_378_137.0, 6_356_752.314245, 0.9996, -3.0)
    return let(plane, lambda p: F.struct((p["x"] + 500_000.0).alias("x"), p["y"].alias("y")))


def _ecef(p: Column, a: float, b: float) -> Column:
    e2 = 1 - (b * b) / (a * a)
    s = F.sin(F.radians(p["lat"]))
    nu = F.lit(a) / F.sqrt(F.lit(1.0) - s * s * e2)
    return F.struct((nu * F.cos(F.radians(p["lat"])) * F.cos(F.radians(p["lng"]))).alias("x"),
                    (nu * F.cos(F.radians(p["lat"])) * F.sin(F.radians(p["lng"]))).alias("y"),
                    (nu * (1 - e2) * s).alias("z"))


def british_grid_to_wgs84(easting, northing) -> Column:
    """struct(lat, lng) of a British National Grid position, good to a few metres.

    Inverse transverse Mercator on the Airy ellipsoid by Krueger's series, then
    the published seven-parameter shift to WGS84 and Bowring's closed form.
    """
    # Airy 1830 axes, grid scale, true and false origin.
    a, b, scale = 6_377_563.396, 6_356_256.909, 0.9996012717
    lat0, lng0, e0, n0 = 49.0, -2.0, 400_000.0, -100_000.0
    # OSGB36 to WGS84 translation (m), rotation (arc seconds), scale (ppm).
    tx, ty, tz, ppm = 446.448, -125.157, 542.060, -20.4894
    rx, ry, rz = (r / 3600 * 3.141592653589793 / 180 for r in (0.1502, 0.2470, 0.8421))
    n = (a - b) / (a + b)
    big = a / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64)
    beta = (n / 2 - 2 * n ** 2 / 3 + 37 * n ** 3 / 96, n ** 2 / 48 + n ** 3 / 15, 17 * n ** 3 / 480)
    delta = (2 * n - 2 * n ** 2 / 3 - 2 * n ** 3, 7 * n ** 2 / 3 - 8 * n ** 3 / 5, 56 * n ** 3 / 15)
    origin = _meridian(lat0, a, b) * scale
    k = 1 + ppm / 1e6
    wa, wb = 6_378_137.0, 6_356_752.314245
    e2 = 1 - (wb * wb) / (wa * wa)

    def sphere(p: Column) -> Column:
        xi, eta = p["xi"], p["eta"]
        for j, c in enumerate(beta, 1):
            xi = xi - F.sin(p["xi"] * (2 * j)) * F.cosh(p["eta"] * (2 * j)) * c
            eta = eta - F.cos(p["xi"] * (2 * j)) * F.sinh(p["eta"] * (2 * j)) * c
        return F.struct(xi.alias("xi"), eta.alias("eta"))

    def conformal(p: Column) -> Column:
        return F.struct(F.asin(F.sin(p["xi"]) / F.cosh(p["eta"])).alias("chi"),
                        F.atan2(F.sinh(p["eta"]), F.cos(p["xi"])).alias("lam"))

    def airy(p: Column) -> Column:
        phi = p["chi"]
        for j, c in enumerate(delta, 1):
            phi = phi + F.sin(p["chi"] * (2 * j)) * c
        return F.struct(F.degrees(phi).alias("lat"), (F.degrees(p["lam"]) + lng0).alias("lng"))

    def shift(p: Column) -> Column:
        x, y, z = p["x"], p["y"], p["z"]
        return F.struct((x * k - y * rz + z * ry + tx).alias("x"), (x * rz + y * k - z * rx + ty).alias("y"),
                        (y * rx - x * ry + z * k + tz).alias("z"))

    def polar(p: Column) -> Column:
        r = F.hypot(p["x"], p["y"])
        return F.struct(r.alias("r"), p["z"].alias("z"), F.atan2(p["z"] * wa, r * wb).alias("t"),
                        F.atan2(p["y"], p["x"]).alias("lam"))

    def geodetic(p: Column) -> Column:
        lat = F.atan2(p["z"] + F.pow(F.sin(p["t"]), 3) * (e2 * wa * wa / wb),
                      p["r"] - F.pow(F.cos(p["t"]), 3) * (e2 * wa))
        return F.struct(F.degrees(lat).alias("lat"), F.degrees(p["lam"]).alias("lng"))

    out = F.struct(((_c(northing) - n0 + origin) / (scale * big)).alias("xi"),
                   ((_c(easting) - e0) / (scale * big)).alias("eta"))
    for stage in (sphere, conformal, airy, lambda p: _ecef(p, a, b), shift, polar, geodetic):
        out = let(out, stage)
    return out


def _meridian(lat_deg: float, a: float, b: float) -> float:
    """Meridian arc from the equator (plain number, used for the grid origin)."""
    from math import radians, sin
    n, phi = (a - b) / (a + b), radians(lat_deg)
    return a / (1 + n) * ((1 + n ** 2 / 4 + n ** 4 / 64) * phi - (3 * n / 2 - 3 * n ** 3 / 16) * sin(2 * phi)
                          + 15 * n ** 2 / 16 * sin(4 * phi) - 35 * n ** 3 / 48 * sin(6 * phi))


# --- vectors and overlap -------------------------------------------------

def angle_deg(ux, uy, vx, vy, directed: bool = True) -> Column:
    ux, uy, vx, vy = map(_c, (ux, uy, vx, vy))
    cos = F.try_divide(ux * vx + uy * vy, F.hypot(ux, uy) * F.hypot(vx, vy))
    return F.degrees(F.acos(clamp(cos if directed else F.abs(cos), -1.0, 1.0)))


def observed_overlap(edge: list[Column], step: list[Column], radii: list[Column], max_angle: float = 20.0) -> Column:
    """Overlap of a step with an edge, once per radius: array<struct(start, end, entry, exit)>.

    start/end are fractions of the step, entry/exit fractions of the edge. The
    step counts where its foot lies on the edge and its side offset is within
    the radius; turned more than `max_angle` from the edge it does not count
    and the entry is null. Terms are bound once, so the expression stays small.
    """
    d = F.try_divide

    def vectors(p: Column) -> Column:
        f = lambda n: p[n]
        return F.struct(
            (f("ebx") - f("eax")).alias("ux"), (f("eby") - f("eay")).alias("uy"),
            (f("bx") - f("ax")).alias("vx"), (f("by") - f("ay")).alias("vy"),
            (f("ax") - f("eax")).alias("px"), (f("ay") - f("eay")).alias("py"),
            (f("bx") - f("eax")).alias("qx"), (f("by") - f("eay")).alias("qy"), f("radii").alias("radii"))

    def fractions(v: Column) -> Column:
        nn = v["ux"] * v["ux"] + v["uy"] * v["uy"]
        n = F.sqrt(nn)
        lean = F.abs(v["ux"] * v["vx"] + v["uy"] * v["vy"])
        return F.struct(
            d(v["px"] * v["ux"] + v["py"] * v["uy"], nn).alias("p0"), d(v["qx"] * v["ux"] + v["qy"] * v["uy"], nn).alias("p1"),
            d(v["ux"] * v["py"] - v["uy"] * v["px"], n).alias("q0"), d(v["ux"] * v["qy"] - v["uy"] * v["qx"], n).alias("q1"),
            ((nn > 0) & (lean > 0) & (lean >= n * F.hypot(v["vx"], v["vy"]) * F.cos(F.radians(F.lit(max_angle))))).alias("turned"),
            v["radii"].alias("radii"))

    def clip(c: Column) -> Column:
        along = [d(-c["p0"], c["p1"] - c["p0"]), d(1 - c["p0"], c["p1"] - c["p0"])]

        def one(r: Column) -> Column:
            side = [d(-r - c["q0"], c["q1"] - c["q0"]), d(r - c["q0"], c["q1"] - c["q0"])]
            ends = F.struct(F.greatest(F.lit(0.0), F.least(*along), F.least(*side)).alias("start"),
                            F.least(F.lit(1.0), F.greatest(*along), F.greatest(*side)).alias("end"))
            fits = c["turned"] & ((c["q0"] != c["q1"]) | (F.abs(c["q0"]) <= r))
            at = lambda t: clamp(c["p0"] + t * (c["p1"] - c["p0"]), 0.0, 1.0)
            return let(ends, lambda w: F.when(fits & (w["end"] > w["start"]), F.struct(
                w["start"].alias("start"), w["end"].alias("end"),
                at(w["start"]).alias("entry"), at(w["end"]).alias("exit"))))

        return F.transform(c["radii"], one)

    names = ["eax", "eay", "ebx", "eby", "ax", "ay", "bx", "by"]
    start = F.struct(*[c.alias(n) for n, c in zip(names, [*edge, *step])], F.array(*radii).alias("radii"))
    return let(let(let(start, vectors), fractions), clip)


# --- lines ---------------------------------------------------------------

def steps(line) -> Column:
    """array<struct<i,ax,ay,bx,by>>: the consecutive segments of a line."""
    line = _c(line)
    n = F.size(line)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(
        (i - 1).alias("i"),
        F.element_at(line, i)["x"].alias("ax"), F.element_at(line, i)["y"].alias("ay"),
        F.element_at(line, i + 1)["x"].alias("bx"), F.element_at(line, i + 1)["y"].alias("by")))
    ).otherwise(F.array().cast("array<struct<i:int,ax:double,ay:double,bx:double,by:double>>"))


def line_length_m(line, earth_m: float = EARTH_MEAN_M) -> Column:
    """Ground length of a (lng, lat) line."""
    return F.aggregate(steps(line), F.lit(0.0),
                       lambda s, e: s + haversine_m(e["ay"], e["ax"], e["by"], e["bx"], earth_m))


def line_length(line) -> Column:
    """Planar length."""
    return F.aggregate(steps(line), F.lit(0.0), lambda s, e: s + F.hypot(e["bx"] - e["ax"], e["by"] - e["ay"]))


def samples_for(length, spacing: float) -> Column:
    """How many parts a segment is cut into so that none exceeds `spacing`."""
    return F.greatest(F.lit(1), F.ceil(_c(length) / F.lit(spacing))).cast("long")


def bbox(line) -> Column:
    line = _c(line)
    xs, ys = F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("west"), F.array_min(ys).alias("south"),
                    F.array_max(xs).alias("east"), F.array_max(ys).alias("north"))


def boxes_overlap(a: Column, b: Column) -> Column:
    return ((a["west"] <= b["east"]) & (b["west"] <= a["east"])
            & (a["south"] <= b["north"]) & (b["south"] <= a["north"]))


def stride(line, every: int) -> Column:
    """Every k-th vertex, endpoints kept."""
    line = _c(line)
    return F.filter(line, lambda p, i: (i % every == 0) | (i == F.size(line) - 1))


def stride_to(line, most: int) -> Column:
    """At most about `most` vertices by an even stride, endpoints kept."""
    line = _c(line)
    every = F.greatest(F.lit(1), F.ceil(F.size(line) / F.lit(most)))
    return F.filter(line, lambda p, i: (i % every == 0) | (i == F.size(line) - 1))


# --- keys ----------------------------------------------------------------

def point_key(lng, lat, places: int = 5) -> Column:
    k = 10 ** places
    return F.concat_ws(",", F.round(_c(lng) * k).cast("long").cast("string"),
                       F.round(_c(lat) * k).cast("long").cast("string"))


def segment_key(a_lng, a_lat, b_lng, b_lat, places: int = 5) -> Column:
    """Undirected: both directions of travel give the same key."""
    one, two = point_key(a_lng, a_lat, places), point_key(b_lng, b_lat, places)
    return F.concat_ws("|", F.least(one, two), F.greatest(one, two))


def cell_key(x, y, cell: float) -> Column:
    return F.concat_ws(",", F.floor(_c(x) / F.lit(cell)).cast("string"), F.floor(_c(y) / F.lit(cell)).cast("string"))


def line_hash(line, places: int = 7, directed: bool = False) -> Column:
    """SHA-256 of the vertices at fixed precision; direction-free unless `directed`."""
    k = 10 ** places
    text = F.transform(_c(line), lambda p: F.concat_ws(",", F.round(p["x"] * k).cast("long").cast("string"),
                                                       F.round(p["y"] * k).cast("long").cast("string")))
    forward = F.concat_ws(";", text)
    return F.sha2(forward if directed else F.least(forward, F.concat_ws(";", F.reverse(text))), 256)


# --- polygons ------------------------------------------------------------

def in_ring(x, y, ring) -> Column:
    """Even-odd rule for one closed ring."""
    x, y = _c(x), _c(y)
    return F.aggregate(steps(ring), F.lit(False), lambda inside, e: F.when(
        ((e["ay"] > y) != (e["by"] > y))
        & (x < F.try_divide((e["bx"] - e["ax"]) * (y - e["ay"]), e["by"] - e["ay"]) + e["ax"]), ~inside).otherwise(inside))


def in_polygon(x, y, rings) -> Column:
    """Even-odd over all rings, so holes drop out."""
    return F.aggregate(_c(rings), F.lit(False), lambda inside, ring: inside != in_ring(x, y, ring))


def in_multipolygon(x, y, polygons) -> Column:
    """Inside any part; overlapping parts need no dissolve."""
    return F.exists(_c(polygons), lambda rings: in_polygon(x, y, rings))


def rings_clearance_m(lng, lat, rings) -> Column:
    """Metres from a position to the nearest boundary segment."""
    return F.array_min(F.flatten(F.transform(_c(rings), lambda ring: F.transform(
        steps(ring), lambda e: point_segment_m(lng, lat, e["ax"], e["ay"], e["bx"], e["by"])))))


def supports_inside(lng, lat, accuracy_m, rings) -> Column:
    """Inside, and at least the accuracy radius away from the boundary."""
    return in_polygon(lng, lat, rings) & (rings_clearance_m(lng, lat, rings) >= _c(accuracy_m))


def supports_outside(lng, lat, margin_m, rings) -> Column:
    return ~in_polygon(lng, lat, rings) & (rings_clearance_m(lng, lat, rings) >= _c(margin_m))


def ring_area(ring) -> Column:
    return F.abs(F.aggregate(steps(ring), F.lit(0.0),
                             lambda s, e: s + e["ax"] * e["by"] - e["bx"] * e["ay"])) / 2


def polygon_area(rings) -> Column:
    rings = _c(rings)
    holes = F.aggregate(F.slice(rings, 2, F.greatest(F.lit(1), F.size(rings))), F.lit(0.0),
                        lambda s, r: s + ring_area(r))
    return ring_area(F.element_at(rings, 1)) - holes


def ring_valid(ring) -> Column:
    ring = _c(ring)
    n = F.size(ring)
    first, last = F.element_at(ring, 1), F.element_at(ring, -1)
    return F.coalesce((n >= 4) & (first["x"] == last["x"]) & (first["y"] == last["y"])
                      & F.forall(ring, lambda p: p["x"].between(-180, 180) & p["y"].between(-90, 90)
                                 & ~F.isnan(p["x"]) & ~F.isnan(p["y"])), F.lit(False))


def cut_fractions(ax, ay, bx, by, rings) -> Column:
    """Sorted fractions where a segment meets the rings, with 0 and 1."""
    ax, ay, bx, by = map(_c, (ax, ay, bx, by))
    dx, dy = bx - ax, by - ay

    def meet(e):
        ex, ey = e["bx"] - e["ax"], e["by"] - e["ay"]
        det = dx * ey - dy * ex
        t = F.try_divide((e["ax"] - ax) * ey - (e["ay"] - ay) * ex, det)
        u = F.try_divide((e["ax"] - ax) * dy - (e["ay"] - ay) * dx, det)
        return F.when((det != 0) & (t > 0) & (t < 1) & (u >= 0) & (u <= 1), t)

    hits = F.flatten(F.transform(_c(rings), lambda ring: F.transform(steps(ring), meet)))
    return F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)),
                                                  F.filter(hits, lambda t: t.isNotNull()))))


def inside_pieces(ax, ay, bx, by, rings) -> Column:
    """array<struct<t0,t1>>: parts of a segment of positive length inside a polygon."""
    cuts = cut_fractions(ax, ay, bx, by, rings)
    ax, ay, bx, by = map(_c, (ax, ay, bx, by))
    pairs = F.transform(F.sequence(F.lit(1), F.size(cuts) - 1), lambda i: F.struct(
        F.element_at(cuts, i).alias("t0"), F.element_at(cuts, i + 1).alias("t1")))
    return F.filter(pairs, lambda p: (p["t1"] > p["t0"]) & in_polygon(
        ax + (bx - ax) * (p["t0"] + p["t1"]) / 2, ay + (by - ay) * (p["t0"] + p["t1"]) / 2, rings))


def inside_share(ax, ay, bx, by, rings) -> Column:
    return F.aggregate(inside_pieces(ax, ay, bx, by, rings), F.lit(0.0), lambda s, p: s + p["t1"] - p["t0"])


def box_ring(west, south, east, north) -> Column:
    w, s, e, n = map(_c, (west, south, east, north))
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(corner(w, s), corner(e, s), corner(e, n), corner(w, n), corner(w, s))


# --- ellipsoid -----------------------------------------------------------

def metres_per_degree(lat) -> tuple[Column, Column]:
    """Ground metres of one degree of latitude and of longitude on WGS84."""
    a, e2 = 6_378_137.0, 0.0066943799901413165
    s = F.sin(F.radians(_c(lat)))
    w = F.lit(1.0) - s * s * e2
    deg = 3.141592653589793 / 180
    return F.lit(a * (1 - e2) * deg) / F.pow(w, 1.5), F.lit(a * deg) * F.cos(F.radians(_c(lat))) / F.sqrt(w)


def geodesic_to_segment_m(lng, lat, a_lng, a_lat, b_lng, b_lat) -> Column:
    """Ellipsoidal metres to the nearest point of a short segment (up to about 10 km).

    The plane is tangent at the position and scaled with WGS84 metres per degree;
    tests/test_spatial.py measures the error (millimetres within 100 m).
    """
    lng, lat, a_lng, a_lat, b_lng, b_lat = map(_c, (lng, lat, a_lng, a_lat, b_lng, b_lat))
    ky, kx = metres_per_degree(lat)
    return point_segment(F.lit(0.0), F.lit(0.0), (a_lng - lng) * kx, (a_lat - lat) * ky,
                         (b_lng - lng) * kx, (b_lat - lat) * ky)


def search_box(lat, lng, radius_m: float) -> Column:
    """Box that holds every position within `radius_m` (great circle), poles excluded."""
    lat, lng = _c(lat), _c(lng)
    d = radius_m / EARTH_M
    dlat = F.degrees(F.lit(d))
    dlng = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(d)) / F.cos(F.radians(lat)))))
    return F.struct((lng - dlng).alias("west"), (lat - dlat).alias("south"),
                    (lng + dlng).alias("east"), (lat + dlat).alias("north"))


def valid_point(lat, lng) -> Column:
    lat, lng = _c(lat), _c(lng)
    return F.coalesce(~F.isnan(lat) & ~F.isnan(lng) & lat.between(-90, 90) & lng.between(-180, 180), F.lit(False))
