"""Distances, nearest neighbours and point-in-polygon on plain columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyledger.operators.ranking import top_k_per_group
from skyledger.operators.skew import with_scalars
from skyledger.session import settle as written, shuffle_width

EARTH_MILES = 3958.7613
STEP = 2  # levels of the tree between two looks
FINEST = 20  # cell side: 2 / 2**level of the unit cube, about 12 m on the ground
LEAF = 64  # right points in a cell that is not divided again
LOOSE = 1e-9  # margin of chord bounds, far beyond rounding
PLACES = 5000  # left places that one task takes down the tree


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in miles."""
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2
    b = F.sin(F.radians(lon2 - lon1) / 2) ** 2
    h = a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b
    return 2 * EARTH_MILES * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def _sphere(lat: str, lon: str) -> list[Column]:
    """The place on the unit sphere, where no date line or pole stands out."""
    a, b = F.radians(lat), F.radians(lon)
    return [(F.cos(a) * F.cos(b)).alias("_x"), (F.cos(a) * F.sin(b)).alias("_y"), F.sin(a).alias("_z")]


AXES = ("x", "y", "z")
CELL = ("_ix", "_iy", "_iz")


def _index(level: int) -> list[Column]:
    """The cell of a place at a level."""
    side = float(2**level)
    return [F.least(F.floor((F.col(f"_{c}") + 1) / 2 * side), F.lit(2**level - 1)).cast("int").alias(f"_i{c}") for c in AXES]


def _above(levels: Column | str) -> list[Column]:
    """The indices of the cell so many levels up."""
    n = F.col(levels) if isinstance(levels, str) else levels
    return [F.call_function("shiftright", F.col(c), n).alias(c) for c in CELL]


def occupancy_tree(cells: DataFrame) -> DataFrame:
    """(level, cell, n, leaf): the tree over the occupied finest cells, built upward from their counts ``_n``.

    A cell of more than ``LEAF`` points is divided, ``STEP`` levels at a time; the others,
    and crowded ones on the finest level, are leaves. Cells inside a leaf are left out.
    """
    ups = F.explode(F.sequence(F.lit(0), F.lit(FINEST), F.lit(STEP)))
    counts = cells.select("*", ups.alias("_up")).select(
        (F.lit(FINEST) - F.col("_up")).alias("_level"), *_above("_up"), "_n"
    ).groupBy("_level", *CELL).agg(F.sum("_n").alias("_n"))
    crowded = counts.where(F.col("_n") > LEAF).select((F.col("_level") + STEP).alias("_level"), *[F.col(c).alias(f"_p{c}") for c in CELL])
    parent = [F.call_function("shiftright", F.col(c), F.lit(STEP)).alias(f"_p{c}") for c in CELL]
    kept = counts.select("*", *parent).join(crowded, ["_level", *[f"_p{c}" for c in CELL]], "left_semi")
    kept = kept.unionByName(counts.where("_level = 0").select("*", *parent))
    return kept.withColumn("_leaf", (F.col("_n") <= LEAF) | (F.col("_level") == FINEST))


def _chord_bounds() -> dict[str, Column]:
    """Squares of the least and greatest distance of a place from the box of a cell."""
    side = F.lit(2.0) / F.pow(F.lit(2.0), F.col("_level"))
    near, far = F.lit(0.0), F.lit(0.0)
    for c in AXES:
        low = F.col(f"_i{c}") * side - 1.0
        high = low + side
        at = F.col(f"_{c}")
        near = near + F.pow(F.greatest(low - at, at - high, F.lit(0.0)), 2)
        far = far + F.pow(F.greatest(F.abs(at - low), F.abs(at - high)), 2)
    return {"_near": near, "_far": far}


def k_nearest(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, k: int,
    lat: str = "lat", lon: str = "lon",
) -> DataFrame:
    """The ``k`` nearest right points of every left point, exactly.

    Returns ``(left_id, right_id, dist_mi, rank)``; equal distances go to the lower right id;
    a null coordinate is near nothing. Ids have different names.

    The right points are counted in an occupancy tree over the unit sphere, and each is
    stored under one leaf, which holds at most ``LEAF`` of them (on the finest level: those
    of one cell). Every distinct left place goes down the tree: the
    cells in sight, by greatest distance, hold ``k`` points from some distance on, and
    cells wholly beyond that are dropped before the others are divided. Only the points
    of the leaves left at the end are measured, and of each leaf (in pages of about ``LEAF``
    points) only its ``k`` nearest go on. A task has about ``PLACES`` places, however many there are.
    """
    # At one place only the k lowest ids can be among the k nearest.
    spots = top_k_per_group(
        right.select(right_id, lat, lon).dropna(), [lat, lon], [F.col(right_id)], k, "_r"
    ).drop("_r").select(right_id, lat, lon, *_sphere(lat, lon)).select(
        right_id, F.col(lat).alias("_lat"), F.col(lon).alias("_lon"), *_index(FINEST))
    cells = spots.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_n"))
    tree = written(occupancy_tree(cells))
    depth = tree.agg(F.max("_level")).first()[0]
    places = written(left.select(lat, lon).dropna().distinct())
    tasks = max(shuffle_width(left.sparkSession), places.count() // PLACES + 1)
    places = places.withColumn("_spot", F.xxhash64(lat, lon)).repartition(tasks, "_spot").select("_spot", lat, lon, *_sphere(lat, lon))
    if depth is None:
        return left.select(left_id).join(right.select(right_id), F.lit(False)).select(
            left_id, right_id, F.lit(0.0).alias("dist_mi"), F.lit(1).alias("rank"))

    by_place = Window.partitionBy("_spot", lat, lon).orderBy("_far").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("_spot", lat, lon)
    here = ["_spot", lat, lon, *[f"_{c}" for c in AXES]]
    node = F.struct("_level", *CELL, "_n", "_leaf").alias("_next")
    seen = with_scalars(places, tree.where("_level = 0").select("_level", *CELL, "_n", "_leaf"))
    for level in range(STEP, depth + 1, STEP):
        above = [F.lit(level - STEP).alias("_level"), *[F.col(f"_p{c}").alias(c) for c in CELL]]
        below = tree.where(F.col("_level") == level).select(*above, node)
        below = below.unionByName(tree.where(F.col("_leaf") & (F.col("_level") < level)).select("_level", *CELL, node))  # a leaf stays itself
        seen = seen.select(*here, "_level", *CELL).join(below, ["_level", *CELL]).select(*here, "_next.*").withColumns(_chord_bounds())
        seen = seen.withColumn("_cum", F.sum("_n").over(by_place))
        seen = seen.withColumn("_reach", F.min(F.when(F.col("_cum") >= k, F.col("_far"))).over(whole))
        seen = seen.where(F.col("_reach").isNull() | (F.col("_near") <= F.col("_reach") + LOOSE))

    leaves = tree.where("_leaf").select("_level", *CELL, F.ceil(F.col("_n") / LEAF).alias("_pages"))
    ups = F.explode(F.sequence(F.lit(0), F.lit(FINEST), F.lit(STEP)))
    homes = cells.select(*[F.col(c).alias(f"_f{c}") for c in CELL], *CELL, ups.alias("_up")).select(
        *[F.col(f"_f{c}") for c in CELL], (F.lit(FINEST) - F.col("_up")).alias("_level"), *_above("_up")).join(leaves, ["_level", *CELL])
    point = F.struct(F.col("_lat").alias("a"), F.col("_lon").alias("o"), F.col(right_id).alias("id"))
    stored = spots.select(right_id, "_lat", "_lon", *[F.col(c).alias(f"_f{c}") for c in CELL]).join(
        homes, [f"_f{c}" for c in CELL]).groupBy("_level", *CELL, F.pmod(F.xxhash64(right_id), F.col("_pages")).alias("_page")).agg(
        F.collect_list(point).alias("_points")).drop("_page")
    measured = F.transform("_points", lambda e: F.struct(haversine(F.col(lat), F.col(lon), e["a"], e["o"]).alias("dist_mi"), e["id"].alias(right_id)))
    near = seen.select("_spot", lat, lon, "_level", *CELL).join(written(stored), ["_level", *CELL]).select(
        "_spot", lat, lon, F.inline(F.slice(F.array_sort(measured), 1, k)))
    best = top_k_per_group(near, ["_spot", lat, lon], [F.col("dist_mi"), F.col(right_id)], k)
    return left.select(left_id, lat, lon).join(
        best.select(lat, lon, right_id, "dist_mi", "rank"), [lat, lon]
    ).select(left_id, right_id, "dist_mi", "rank")


def ring_edges(rings: DataFrame, poly: str, ring: str = "ring", seq: str = "seq", x: str = "x", y: str = "y") -> DataFrame:
    """Edges (poly, x1, y1, x2, y2) of closed rings whose vertices ascend by ``seq``, from any number and with gaps.

    Each ring closes on itself; a table without the column ``ring`` has one ring per polygon.
    """
    of = [poly, ring] if ring in rings.columns else [poly]
    order = Window.partitionBy(*of).orderBy(seq)
    first = Window.partitionBy(*of).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(first))
    return rings.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        poly, F.col(x).alias("x1"), F.col(y).alias("y1"), after(x).alias("x2"), after(y).alias("y2"))


def polygon_tiles(edges: DataFrame, poly: str, cell: float) -> DataFrame:
    """(poly, _tile, _band, _border): the grid tiles that a polygon touches.

    A border tile meets an edge. The other tiles are wholly inside or outside: the edges cut
    the middle line of each band in pairs of crossings, over all rings, and a tile whose
    middle lies between the two of a pair is inside. Tiles outside are left out.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    margin = cell * 1e-6
    banded = edges.withColumn("_band", F.explode(F.sequence(F.floor((low - margin) / cell), F.floor((high + margin) / cell))))
    slope = (F.col("x2") - F.col("x1")) / F.when(F.col("y2") != F.col("y1"), F.col("y2") - F.col("y1"))
    at = lambda y: F.coalesce(F.col("x1") + (F.least(F.greatest(y, low), high) - F.col("y1")) * slope, F.col("x1"))
    ends = [at(F.col("_band") * cell - margin), at((F.col("_band") + 1) * cell + margin)]
    flat = F.col("y1") == F.col("y2")
    x_low = F.when(flat, F.least("x1", "x2")).otherwise(F.least(*ends)) - margin
    x_high = F.when(flat, F.greatest("x1", "x2")).otherwise(F.greatest(*ends)) + margin
    border = banded.select(poly, "_band", F.explode(F.sequence(F.floor(x_low / cell), F.floor(x_high / cell))).alias("_tile")).distinct()
    middle = (F.col("_band") + 0.5) * cell
    crossing = banded.where((F.col("y1") > middle) != (F.col("y2") > middle)).select(
        poly, "_band", (F.col("x1") + (middle - F.col("y1")) * slope).alias("_x"))
    line = Window.partitionBy(poly, "_band").orderBy("_x")
    pairs = crossing.select(poly, "_band", "_x", F.lead("_x").over(line).alias("_to"), F.row_number().over(line).alias("_no")).where("_no % 2 = 1")
    first, last = F.ceil(F.col("_x") / cell - 0.5), F.floor(F.col("_to") / cell - 0.5)
    inside = pairs.where(first <= last).select(poly, "_band", F.explode(F.sequence(first, last)).alias("_tile"))
    return border.withColumn("_border", F.lit(True)).unionByName(
        inside.join(border, [poly, "_band", "_tile"], "left_anti").withColumn("_border", F.lit(False)))


def points_in_polygons(
    points: DataFrame, rings: DataFrame, point_id: str, poly: str,
    x: str = "lon", y: str = "lat", cell: float = 1.0,
) -> DataFrame:
    """(point_id, poly) for every polygon that contains the point, border included.

    A polygon has any number of rings (column ``ring``): a point is inside if a ray from it
    crosses an odd number of edges of all rings together, so islands belong to it and
    holes do not. Distinct places meet the tiles of the polygons; those in a tile wholly
    inside are settled, and only those in border tiles meet the edges of their band.
    """
    edges = ring_edges(rings, poly)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    bands = edges.withColumn(
        "_band", F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell)))
    )
    tiles = polygon_tiles(edges, poly, cell)
    places = points.select(x, y).dropna().distinct().withColumns(
        {"_tile": F.floor(F.col(x) / cell), "_band": F.floor(F.col(y) / cell)}
    )
    px, py = F.col(x), F.col(y)
    met = places.join(tiles, ["_tile", "_band"])
    tested = met.where("_border").select(x, y, poly, "_band").join(bands, [poly, "_band"])
    cross = (F.col("x2") - F.col("x1")) * (py - F.col("y1")) - (F.col("y2") - F.col("y1")) * (px - F.col("x1"))
    on_edge = (
        (cross == 0)
        & px.between(F.least("x1", "x2"), F.greatest("x1", "x2"))
        & py.between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    )
    spans = (F.col("y1") > py) != (F.col("y2") > py)
    right_of = px < F.col("x1") + (py - F.col("y1")) * F.try_divide(
        F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    )
    by_edges = tested.groupBy(x, y, poly).agg(
        (F.count_if(spans & right_of) % 2 == 1).alias("_odd"), F.max(on_edge).alias("_edge")
    ).where(F.col("_odd") | F.col("_edge"))
    inside = met.where(~F.col("_border")).select(x, y, poly).unionByName(by_edges.select(x, y, poly))
    return points.select(point_id, x, y).join(inside, [x, y]).select(point_id, poly)
