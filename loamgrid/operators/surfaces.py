"""Surfaces through scattered points: linear by Delaunay triangles, or the nearest point.

Space is cut into a quadtree.  A cell is split while the nine cells of its size around and with it hold more than
``most`` points, so leaves beside each other differ by one level at most.  Each leaf is a group of those points, of which
a task makes the Delaunay triangles.  A triangle whose circumcircle is no wider than the leaf and that reaches into it has
its circle within the nine cells, so no other point lies in it and it is a triangle of all points.  Places in such
triangles are done.  A point is done when all triangles around it are so, with circles of half that width: then every leaf
that they reach takes them too.  All other triangles have only points that aren't done, and are found among the Delaunay
triangles of these alone, so the next round goes on with the open points (those near the hull and at gaps) and the places
left, and with twice as many points to a leaf, until one leaf holds them all.

The nearest point is searched in a place's leaf first.  Places whose nearest point may lie beyond it go down the tree of
point boxes by joins, a level at a time, keeping the boxes that can hold a point as near as the nearest one known to be in
some box.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import written

#: Points of a leaf with its neighbours in the first round, places of a task, and points of a box that isn't split.
MOST_POINTS, MOST_PLACES, FEW = 4000, 50_000, 64
#: Levels of the quadtree.
DEEPEST = 40


def delaunay(points: np.ndarray) -> np.ndarray:
    """Triangles (counterclockwise, rows of three numbers) of different points that are in order of x, then y.

    Points are added in order, each outside the hull of those before, and edges are flipped until all circles are empty.
    Of four points on a circle those triangles stay that are there first.
    """
    n = len(points)
    x, y = (points - points.mean(axis=0)).T.tolist() if n else ([], [])

    def turn(a: int, b: int, c: int) -> float:
        return (x[b] - x[a]) * (y[c] - y[a]) - (y[b] - y[a]) * (x[c] - x[a])

    flat = 1e-14 * float(np.ptp(points, axis=0).max()) ** 2 if n else 0.0
    first = next((k for k in range(2, n) if abs(turn(0, k - 1, k)) > flat), None)
    if first is None:
        return np.zeros((0, 3), dtype=np.int64)
    third: dict[tuple[int, int], int] = {}  # of a directed edge, the corner on its left

    def add(a: int, b: int, c: int) -> None:
        third[a, b], third[b, c], third[c, a] = c, a, b

    def flip(edges: list[tuple[int, int]], i: int) -> None:
        while edges:
            u, v = edges.pop()
            d = third.get((v, u))
            if d is None or third.get((u, v)) != i:
                continue
            ax, ay, bx, by, cx, cy = x[u] - x[d], y[u] - y[d], x[v] - x[d], y[v] - y[d], x[i] - x[d], y[i] - y[d]
            inside = (ax * ax + ay * ay) * (bx * cy - cx * by) - (bx * bx + by * by) * (ax * cy - cx * ay) + (cx * cx + cy * cy) * (ax * by - bx * ay)
            if inside > 1e-13 * ((ax * ax + ay * ay) + (bx * bx + by * by) + (cx * cx + cy * cy)) ** 2:
                del third[u, v], third[v, u]
                add(u, d, i)
                add(d, v, i)
                edges += [(u, d), (d, v)]

    upward = turn(0, first - 1, first) > 0
    line = list(range(first)) if upward else list(range(first - 1, -1, -1))
    ring = [*line, first]
    after, before = dict(zip(ring, [*ring[1:], ring[0]], strict=True)), dict(zip([*ring[1:], ring[0]], ring, strict=True))
    for a, b in zip(line, line[1:], strict=False):
        add(a, b, first)
    flip(list(zip(line, line[1:], strict=False)), first)
    for i in range(first + 1, n):
        b = a = i - 1
        seen = []
        while turn(b, after[b], i) < 0:
            add(after[b], b, i)
            seen.append((after[b], b))
            b = after[b]
        while turn(before[a], a, i) < 0 or not seen:  # one edge at least, whatever rounding says
            add(a, before[a], i)
            seen.append((a, before[a]))
            a = before[a]
        after[a], before[i], after[i], before[b] = i, a, b, i
        flip(seen, i)
    return np.array([(a, b, c) for (a, b), c in third.items() if a < b and a < c], dtype=np.int64).reshape(-1, 3)


def circles(points: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """Diameter of the circle through each triangle's corners."""
    a, b, c = (points[corners[:, k]] for k in range(3))
    sides = [np.hypot(*(p - q).T) for p, q in ((a, b), (b, c), (c, a))]
    area = np.abs((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0]))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(area > 0, sides[0] * sides[1] * sides[2] / area, np.inf)


def planes(points: np.ndarray, values: np.ndarray, corners: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Values at places by the triangle that each lies in; NaN outside of all."""
    out = np.full((len(places), values.shape[1]), np.nan)
    order = np.argsort(places[:, 0], kind="stable")
    x = places[order, 0]
    box = points[corners]
    slack = 1e-9 * np.maximum(1e-300, np.ptp(box, axis=1).max(axis=1))
    low, high = box.min(axis=1) - slack[:, None], box.max(axis=1) + slack[:, None]
    first, last = np.searchsorted(x, low[:, 0], side="left"), np.searchsorted(x, high[:, 0], side="right")
    for t in np.flatnonzero(first < last).tolist():
        here = order[first[t] : last[t]]
        here = here[(places[here, 1] >= low[t, 1]) & (places[here, 1] <= high[t, 1]) & np.isnan(out[here, 0])]
        if not len(here):
            continue
        a, b, c = box[t]
        det = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        if not det:
            continue
        d = places[here] - a
        u, v = (d[:, 0] * (c[1] - a[1]) - d[:, 1] * (c[0] - a[0])) / det, (d[:, 1] * (b[0] - a[0]) - d[:, 0] * (b[1] - a[1])) / det
        inside = (u >= -1e-9) & (v >= -1e-9) & (u + v <= 1 + 1e-9)
        z = values[corners[t]]
        out[here[inside]] = z[0] + u[inside, None] * (z[1] - z[0]) + v[inside, None] * (z[2] - z[0])
    return out


class Tree:
    """A quadtree over a square; cells of a level are numbered along x and y."""

    def __init__(self, points: DataFrame):
        row = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("n")).first()
        self.n, self.x, self.y = row["n"], row["x0"] or 0.0, row["y0"] or 0.0
        self.size = max((row["x1"] or 0.0) - self.x, (row["y1"] or 0.0) - self.y, 1e-300) * (1 + 1e-12)

    def holds(self) -> Column:
        return F.col("x").between(self.x, self.x + self.size) & F.col("y").between(self.y, self.y + self.size)

    def cell(self, depth: Column) -> Column:
        """The cell of a place at a level; places outside the square have the nearest one."""
        many = F.pow(F.lit(2.0), depth)
        along = lambda v, start: F.least(F.greatest(F.floor((F.col(v) - start) / self.size * many), F.lit(0)), (many - 1).cast("long"))
        return F.struct(depth.cast("int").alias("depth"), along("x", self.x).alias("i"), along("y", self.y).alias("j"))


def _moved(rows: DataFrame, steps: tuple[int, ...], times: int, *keep: str) -> DataFrame:
    """A row for each cell (i, j) times ``times`` and moved by the steps along both axes."""
    cells = F.array(*[F.struct((F.col("i") * times + di).alias("i"), (F.col("j") * times + dj).alias("j")) for di in steps for dj in steps])
    return rows.select(*keep, F.explode(cells).alias("c")).select(*keep, "c.i", "c.j")


def _leaves(tree: Tree, points: DataFrame, most: int) -> DataFrame:
    """The leaves as cells: split while a cell and its eight neighbours hold more than ``most`` points."""
    spark = points.sparkSession
    leaves, full = spark.createDataFrame([(0, 0, 0)], "depth int, i long, j long"), None
    if tree.n <= most:
        return leaves
    out, depth = [], 0
    full = leaves
    while depth < DEEPEST:
        depth += 1
        counts = points.select(tree.cell(F.lit(depth)).alias("c")).groupBy("c").agg(F.count("*").alias("n")).select("c.i", "c.j", "n")
        over = _moved(counts, (-1, 0, 1), 1, "n").groupBy("i", "j").agg(F.sum("n").alias("n")).where(F.col("n") > most).select("i", "j")
        marked = written(_moved(full, (0, 1), 2).join(over.withColumn("over", F.lit(True)), ["i", "j"], "left").withColumn("depth", F.lit(depth)))
        out.append(marked.where("over IS NULL").select("depth", "i", "j"))
        full = marked.where("over").select("depth", "i", "j")
        if full.isEmpty():
            break
    else:
        out.append(full)
    leaves = out[0]
    for more in out[1:]:
        leaves = leaves.unionByName(more)
    return written(leaves)


_ROW = "x double, y double, v array<double>, kind int"


def _grouped(tree: Tree, leaves: DataFrame, points: DataFrame, places: DataFrame) -> DataFrame:
    """The rows of each leaf: its points (kind 0), those of the cells around it (1), and places (2), these in pieces."""
    depths = F.array(*[F.lit(r["depth"]) for r in leaves.select("depth").distinct().collect()])  # DEEPEST at most
    ring = [(di, dj) for di in (-1, 0, 1) for dj in (-1, 0, 1)]
    cells = points.select("x", "y", "v", F.explode(depths).alias("depth")).select("x", "y", "v", tree.cell(F.col("depth")).alias("c"))
    around = F.explode(F.array(*[F.struct((F.col("c.i") + di).alias("i"), (F.col("c.j") + dj).alias("j"), F.lit(int(bool(di or dj))).alias("kind")) for di, dj in ring]))
    cells = cells.select("x", "y", "v", "c.depth", around.alias("n")).select("x", "y", "v", "depth", "n.i", "n.j", "n.kind")
    there = places.select("x", "y", F.explode(depths).alias("depth")).select("x", "y", tree.cell(F.col("depth")).alias("c")).select("x", "y", "c.*")
    there = there.join(leaves, ["depth", "i", "j"])
    # a leaf's places are dealt to tasks of bounded size, each with all its points
    pieces = there.groupBy("depth", "i", "j").agg(F.ceil(F.count("*") / MOST_PLACES).cast("int").alias("pieces"))
    sized = written(leaves.join(pieces, ["depth", "i", "j"], "left").na.fill(1, ["pieces"]))
    near = cells.join(sized, ["depth", "i", "j"]).select("depth", "i", "j", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "x", "y", "v", "kind")
    piece = F.pmod(F.xxhash64("x", "y"), F.col("pieces")).cast("int").alias("piece")
    own = there.join(sized, ["depth", "i", "j"]).select("depth", "i", "j", piece, "x", "y", F.lit(None).cast("array<double>").alias("v"), F.lit(2).alias("kind"))
    return near.unionByName(own)


def _prepared(table: pa.Table, width: int) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A leaf's rows in order of x and y, their kinds and coordinates, which are points and which places, and the points' values."""
    table = table.sort_by([("x", "ascending"), ("y", "ascending")]).combine_chunks()
    kind = table["kind"].to_numpy()
    at, where = np.flatnonzero(kind < 2), np.flatnonzero(kind == 2)
    values = np.concatenate([np.zeros(0), *[c.flatten().to_numpy() for c in table["v"].take(pa.array(at)).chunks]]).reshape(len(at), width)
    return table, kind, np.column_stack([table["x"].to_numpy(), table["y"].to_numpy()]), at, where, values


def _with_values(table: pa.Table, at: np.ndarray, values: np.ndarray, kind: int) -> pa.Table:
    own = table.select(["x", "y"]).take(pa.array(at))
    lists = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * values.shape[1], pa.array(values.reshape(-1)))
    return own.append_column("v", lists).append_column("kind", pa.array(np.full(len(at), kind, dtype=np.int32)))


DONE, LEFT, OPEN = 3, 4, 5


def _linear_tile(table: pa.Table, size: float, width: int, last: bool) -> pa.Table:
    """Places done (kind 3, with values), places left (4), and the leaf's own points that stay open (5)."""
    piece = table["piece"][0].as_py()
    cell = 2.0 ** table["depth"][0].as_py()
    table, kind, xy, at, where, values = _prepared(table, width)
    points = xy[at]
    corners = delaunay(points)
    across = circles(points, corners)
    good = np.ones(len(corners), dtype=bool) if last else across <= size / cell * (1 - 1e-9)
    found = planes(points, values, corners[good], xy[where])
    done = ~np.isnan(found[:, 0]) | last
    out = [_with_values(table, where[done], found[done], DONE), _with_values(table, where[~done], np.zeros((int((~done).sum()), width)), LEFT)]
    if not last and piece == 0:
        edges = np.concatenate([corners[:, [0, 1]], corners[:, [1, 2]], corners[:, [2, 0]]]) if len(corners) else np.zeros((0, 2), dtype=np.int64)
        # on the hull there is an edge with no triangle on its other side
        code = np.sort(edges, axis=1) @ np.array([len(points) + 1, 1])
        names, times = np.unique(code, return_counts=True)
        alone = np.isin(code, names[times == 1])
        stays = np.zeros(len(points), dtype=bool)
        stays[edges[alone].reshape(-1)] = True
        stays[corners[across > size / cell / 2 * (1 - 1e-9)].reshape(-1)] = True
        stays[np.setdiff1d(np.arange(len(points)), corners)] = True
        mine = stays & (kind[at] == 0)
        out.append(_with_values(table, at[mine], values[mine], OPEN))
    return pa.concat_tables(out)


def _nearest_tile(table: pa.Table, size: float, width: int, last: bool) -> pa.Table:
    cell = 2.0 ** table["depth"][0].as_py()
    table, _, xy, at, where, values = _prepared(table, width)
    best, far = np.zeros(len(where), dtype=np.int64), np.full(len(where), np.inf)
    for i in range(0, len(where) if len(at) else 0, 256):
        d = ((xy[where[i : i + 256], None, :] - xy[None, at, :]) ** 2).sum(axis=2)
        best[i : i + 256] = d.argmin(axis=1)  # of several the first in order of x and y
        far[i : i + 256] = d.min(axis=1)
    done = (far <= (size / cell) ** 2 * (1 - 1e-9)) | (last & (len(at) > 0))
    return pa.concat_tables([_with_values(table, where[done], values[best[done]], DONE), _with_values(table, where[~done], np.zeros((int((~done).sum()), width)), LEFT)])


def _tiles(tree: Tree, points: DataFrame, places: DataFrame, most: int, width: int, tile) -> tuple[DataFrame, bool]:
    last, size = tree.n <= most, tree.size
    rows = _grouped(tree, _leaves(tree, points, most), points, places)
    return written(rows.groupBy("depth", "i", "j", "piece").applyInArrow(lambda table: tile(table, size, width, last), _ROW)), last


def linear_at(points: DataFrame, places: DataFrame, width: int, most: int = MOST_POINTS) -> DataFrame:
    """x, y and v (null outside the hull) of different places; points are different x and y with ``width`` values v."""
    tree = Tree(points)
    found = []
    if not tree.n:
        return places.select("x", "y", F.lit(None).cast("array<double>").alias("v"))
    places = places.where(tree.holds())  # others lie outside the hull
    while True:
        # a round for each doubling of the leaves
        tiles, last = _tiles(tree, points, places, most, width, _linear_tile)
        found.append(tiles.where(F.col("kind") == DONE).select("x", "y", "v"))
        if last:
            break
        points = tiles.where(F.col("kind") == OPEN).select("x", "y", "v")
        places = tiles.where(F.col("kind") == LEFT).select("x", "y")
        if places.isEmpty():
            break
        most *= 2
        tree.n = points.count()
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("x", "y", F.when(~F.isnan(F.get("v", 0)), F.col("v")).alias("v"))


def _descended(tree: Tree, points: DataFrame, places: DataFrame) -> DataFrame:
    """x, y and v of the nearest point of each place, by the tree of point boxes."""
    boxes = [F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("n")]
    gap = lambda v: F.greatest(F.col(f"{v}0") - F.col(v), F.col(v) - F.col(f"{v}1"), F.lit(0.0))
    reach = lambda v: F.greatest(F.abs(F.col(v) - F.col(f"{v}0")), F.abs(F.col(v) - F.col(f"{v}1")))
    at_least, at_most = F.pow(gap("x"), 2) + F.pow(gap("y"), 2), F.pow(reach("x"), 2) + F.pow(reach("y"), 2)
    ends, depth = [], 0
    front = places.select("x", "y", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))
    bound = None
    while True:
        level = points.select("x", "y", tree.cell(F.lit(depth)).alias("c")).groupBy("c.i", "c.j").agg(*boxes)
        seen = front.join(level, ["i", "j"]).withColumns({"low": at_least, "high": at_most})
        known = seen.groupBy("x", "y").agg(F.min("high").alias("bound"))
        if bound is not None:
            known = known.unionByName(bound).groupBy("x", "y").agg(F.min("bound").alias("bound"))
        bound = written(known)
        seen = written(seen.join(bound, ["x", "y"]).where(F.col("low") <= F.col("bound") * (1 + 1e-12)))
        small = (F.col("n") <= FEW) | F.lit(depth == DEEPEST)
        ends.append(seen.where(small).select("x", "y", F.struct(F.lit(depth).alias("depth"), "i", "j").alias("c"), "low"))
        front = seen.where(~small)
        if front.isEmpty():
            break
        front = _moved(front, (0, 1), 2, "x", "y")
        depth += 1
    pairs = ends[0]
    for more in ends[1:]:
        pairs = pairs.unionByName(more)
    pairs = pairs.join(bound, ["x", "y"]).where(F.col("low") <= F.col("bound") * (1 + 1e-12)).select(F.struct("x", "y").alias("place"), "c")
    cells = points.select("x", "y", "v", F.explode(F.array(*[F.lit(d) for d in range(depth + 1)])).alias("depth")).select(F.struct("x", "y", "v").alias("p"), tree.cell(F.col("depth")).alias("c"))
    met = pairs.join(cells, "c")
    apart = F.pow(F.col("place.x") - F.col("p.x"), 2) + F.pow(F.col("place.y") - F.col("p.y"), 2)
    best = met.groupBy("place").agg(F.min_by("p.v", F.struct(apart.alias("d"), "p.x", "p.y")).alias("v"))
    return best.select("place.x", "place.y", "v")


def nearest_at(points: DataFrame, places: DataFrame, width: int, most: int = MOST_POINTS) -> DataFrame:
    """x, y and v of the point nearest to each place; of several the one with the smallest x, then y."""
    tree = Tree(points)
    if not tree.n:
        return places.select("x", "y", F.lit(None).cast("array<double>").alias("v"))
    inside = tree.holds()
    tiles, last = _tiles(tree, points, places.where(inside), most, width, _nearest_tile)
    done = tiles.where(F.col("kind") == DONE).select("x", "y", "v")
    rest = written(tiles.where(F.col("kind") == LEFT).select("x", "y").unionByName(places.where(~inside)))
    return done if rest.isEmpty() else done.unionByName(_descended(tree, points, rest))


def interpolated(places: DataFrame, points: DataFrame, values: dict[str, str], xy: tuple[str, str] = ("cdp_x", "cdp_y"), method: str = "linear", most: int = MOST_POINTS) -> DataFrame:
    """Rows of places with columns (name: column of points) interpolated from scattered points; both have columns xy.

    ``linear`` is the plane through the Delaunay triangle that a place lies in, null outside the hull of the points;
    ``nearest`` the value of the nearest point.  Points without coordinates or a value are left out, of equal points the
    means are taken; places without coordinates get nulls.
    """
    if method not in ("linear", "nearest"):
        raise ValueError("the method must be linear or nearest")
    if missing := [c for c in xy if c not in places.columns or c not in points.columns] + [c for c in values.values() if c not in points.columns]:
        raise ValueError(f"columns {missing} are missing")
    number = lambda c: F.col(c).cast("double") + 0.0  # noqa: E731  -0.0 is 0.0
    there = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in (*xy, *values.values())]
    known = points
    for c in there:
        known = known.where(c)
    known = known.select(number(xy[0]).alias("x"), number(xy[1]).alias("y"), *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(values.values())])
    known = written(known.groupBy("x", "y").agg(F.array(*[F.avg(f"_{i}") for i in range(len(values))]).alias("v")))
    keyed = places.withColumns({"_x": number(xy[0]), "_y": number(xy[1])})
    asked = keyed.where(F.col("_x").isNotNull() & F.col("_y").isNotNull() & ~F.isnan("_x") & ~F.isnan("_y")).select(F.col("_x").alias("x"), F.col("_y").alias("y")).distinct()
    found = {"linear": linear_at, "nearest": nearest_at}[method](known, written(asked), len(values), most)
    found = found.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("v").alias("_v"))
    out = keyed.drop(*values).join(found, ["_x", "_y"], "left")
    return out.select(*[c for c in places.columns if c not in values], *[F.get("_v", F.lit(i)).alias(name) for i, name in enumerate(values)])
