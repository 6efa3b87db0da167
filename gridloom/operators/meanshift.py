"""Mean shift in the plane: points climb to modes, and modes close together are one cluster.

A round moves each point that still moves towards the mean of the data closer than the radius; data lie in cells
as wide as the radius, so that a point meets nine of them. Equal data and equal points are counted, not paired.
A task that has all the data of these nine cells goes on with a point until it stops or leaves its cell; where the data are
too many for that, parts of them give sums, and a round is a step. Inside a task data lie in small tiles: those wholly
within the radius of a block of points count by their sums, and only those that its circles cut are tested one by one.

Clusters are taken in the order of ids: the first point without a cluster takes all others without one whose mode is
within the radius of its own. A point is the first of a cluster if no earlier point without one is near. In smaller cells,
all of whose points are near each other, only the earliest point of a cell can be such a first one: each round tests these few
points against the points around them, so that a dense mode isn't paired with itself.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._tasks import importable, spread
from .cluster import cut_lineage

#: Data around a cell that one task takes, and points of a cell that meet them in one task.
CHUNK, POINTS = 1 << 20, 1 << 13
#: Data of a tile, points of a block, and data that a block meets at once.
TILE, BLOCK, WIDE = 24, 32, 2048
#: Squared distance below which a point has stopped.
STOP = 1e-3


def _cell(c: str, side: float) -> Column:
    return F.floor(F.col(c) / side)


def _around(reach: int) -> Column:
    steps = range(-reach, reach + 1)
    return F.explode(F.array(*(F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in steps for j in steps)))


def _gap() -> Column:
    return (F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2


def _finite() -> Column:
    return (F.col("x") - F.col("x") == 0) & (F.col("y") - F.col("y") == 0)


def _parts(df: DataFrame, name: str, most: int) -> tuple[DataFrame, DataFrame]:
    """df with a part of its cell, a number that a hash of the place gives, and (cx, cy, {name}s): how many parts a cell has."""
    n = df.groupBy("cx", "cy").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(f"{name}s"))
    return df.join(n, ["cx", "cy"]).withColumn(name, F.pmod(F.xxhash64(*df.columns), F.col(f"{name}s")).cast("int")).drop(f"{name}s"), n


class Tiles:
    """Places with numbers of data in tiles, for sums over circles."""

    def __init__(self, x: np.ndarray, y: np.ndarray, n: np.ndarray):
        self.at = (float(x[0]), float(y[0]))  # sums are of differences from here
        # columns of as many data each, cut into tiles of TILE
        order = np.lexsort((y, x))
        tall = int(np.ceil(np.sqrt(len(x) / TILE))) * TILE
        column = np.arange(len(x)) // tall
        order = order[np.lexsort((y[order], column))]
        self.x, self.y = x[order], y[order]
        self.start = np.arange(0, len(x), TILE)  # tall is a multiple of TILE
        self.size = np.diff(np.r_[self.start, len(x)])
        n = n[order].astype(np.float64)
        self.w = np.column_stack((n, n * (self.x - self.at[0]), n * (self.y - self.at[1])))
        self.sums = np.add.reduceat(self.w, self.start)
        self.x0, self.y0 = (np.minimum.reduceat(v, self.start) for v in (self.x, self.y))
        self.x1, self.y1 = (np.maximum.reduceat(v, self.start) for v in (self.x, self.y))

    def within(self, px: np.ndarray, py: np.ndarray, radius: float) -> np.ndarray:
        """Of the data closer than radius to each place: number, and sums of x and y less ``at``."""
        out, square = np.zeros((len(px), 3)), radius * radius
        columns = int(np.ceil(np.sqrt(len(px) / BLOCK)))
        rank = np.empty(len(px), np.int64)
        rank[np.argsort(px, kind="stable")] = np.arange(len(px))
        order = np.lexsort((py, rank * columns // max(1, len(px))))
        for s in range(0, len(order), BLOCK):
            b = order[s : s + BLOCK]
            bx, by = px[b], py[b]
            left, right, low, high = bx.min(), bx.max(), by.min(), by.max()
            # rounding keeps order, so these bounds hold for the computed distances, too
            near = np.maximum(np.maximum(self.x0 - right, left - self.x1), 0) ** 2 + np.maximum(np.maximum(self.y0 - high, low - self.y1), 0) ** 2 < square
            t = np.flatnonzero(near)
            far = np.maximum(self.x1[t] - left, right - self.x0[t]) ** 2 + np.maximum(self.y1[t] - low, high - self.y0[t]) ** 2
            out[b] = self.sums[t[far < square]].sum(0)
            cut = t[far >= square]
            size = self.size[cut]
            ends = np.cumsum(size)
            which = np.repeat(self.start[cut] - ends + size, size) + np.arange(size.sum())
            for k in range(0, len(which), WIDE):
                w = which[k : k + WIDE]
                d, e = bx[:, None] - self.x[w], by[:, None] - self.y[w]
                d *= d
                e *= e
                d += e
                out[b] += (d < square).astype(np.float64) @ self.w[w]
        return out


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def _climb(places: pa.Table, data: pa.Table, radius: float, rate: float, rounds: int | None) -> pa.Table:
    """Places of one cell after as many rounds as they stay in it, with all the data around it."""
    u, v, x, y, k = (c.copy() for c in _columns(places, "u", "v", "x", "y", "k"))
    live = np.ones(len(x), bool)
    here = np.arange(len(x))
    cx, cy = np.floor(x / radius), np.floor(y / radius)
    tiles = Tiles(*_columns(data, "x2", "y2", "n")) if len(data) else None
    while len(here):
        s = tiles.within(x[here], y[here], radius) if tiles else np.zeros((len(here), 3))
        any_ = s[:, 0] > 0
        live[here[~any_]] = False  # a place without data stays
        here, s = here[any_], s[any_]
        nx, ny = ((1 - rate) * c[here] + rate * (s[:, i + 1] / s[:, 0] + tiles.at[i]) for i, c in enumerate((x, y))) if tiles else (x[here], y[here])
        live[here] = (nx - x[here]) ** 2 + (ny - y[here]) ** 2 > STOP
        x[here], y[here] = nx, ny
        k[here] += 1
        more = live[here] & (np.floor(nx / radius) == cx[here]) & (np.floor(ny / radius) == cy[here])
        here = here[more if rounds is None else more & (k[here] < rounds)]
    return pa.table({"u": u, "v": v, "x": x, "y": y, "k": k, "live": live if rounds is None else live & (k < rounds)})


def _sums(places: pa.Table, data: pa.Table, radius: float) -> pa.Table:
    """(x, y, n, sx, sy): of the data closer than radius to each place their number and sums, where there are some."""
    x, y = _columns(places, "x", "y")
    if not len(x) or not len(data):
        return pa.table({c: np.zeros(0) for c in ("x", "y", "n", "sx", "sy")})
    tiles = Tiles(*_columns(data, "x2", "y2", "n"))
    s = tiles.within(x, y, radius)
    some = s[:, 0] > 0
    n = s[some, 0]
    return pa.table({"x": x[some], "y": y[some], "n": n, "sx": s[some, 1] + n * tiles.at[0], "sy": s[some, 2] + n * tiles.at[1]})


def _sent(data: DataFrame, radius: float) -> DataFrame:
    """(x2, y2, n, cx, cy): data (x, y, n) in all the nine cells around their own."""
    cells = data.where(_finite()).select(F.col("x").alias("x2"), F.col("y").alias("y2"), "n", _cell("x", radius).alias("cx"), _cell("y", radius).alias("cy"))
    return cells.select("x2", "y2", "n", _around(1).alias("t")).select("x2", "y2", "n", "t.cx", "t.cy")


def _count(c: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(c) - 1))


def moved(points: DataFrame, data: DataFrame, radius: float, rate: float) -> DataFrame:
    """(x, y, nx, ny): where each place (x, y) goes: by rate to the mean of the data (x, y, n) closer than radius;
    a place without data stays."""
    importable(points.sparkSession)
    at = points.select("x", "y").distinct()
    # crowded cells meet in pairs of parts, dealt over all tasks
    one, ones = _parts(at.where(_finite()).withColumn("cx", _cell("x", radius)).withColumn("cy", _cell("y", radius)), "i", min(POINTS, CHUNK))
    two, twos = _parts(_sent(data, radius), "j", CHUNK)
    keys = ["cx", "cy", "i", "j"]
    a = spread(one.join(twos, ["cx", "cy"]).withColumn("j", _count("js")), *keys).groupBy(*keys)
    b = spread(two.join(ones, ["cx", "cy"]).withColumn("i", _count("is")), *keys).groupBy(*keys)
    near = a.cogroup(b).applyInArrow(lambda p, d: _sums(p, d, radius), "x double, y double, n double, sx double, sy double")
    mean = near.groupBy("x", "y").agg((F.sum("sx") / F.sum("n")).alias("mx"), (F.sum("sy") / F.sum("n")).alias("my"))
    step = lambda c: (1 - rate) * F.col(c) + rate * F.coalesce(f"m{c}", c)
    return at.join(mean, ["x", "y"], "left").select("x", "y", step("x").alias("nx"), step("y").alias("ny"))


def _ends(data: DataFrame, radius: float, rate: float, rounds: int | None) -> DataFrame:
    """(u, v, x, y): where each place (x, y) of the data (x, y, n), called (u, v), ends."""
    importable(data.sparkSession)
    sent = cut_lineage(_sent(data, radius))
    crowded = cut_lineage(sent.groupBy("cx", "cy").agg((F.count(F.lit(1)) > CHUNK).alias("crowded")))
    some = not crowded.where("crowded").isEmpty()
    state = data.select(F.col("x").alias("u"), F.col("y").alias("v"), "x", "y", F.lit(0).cast("long").alias("k"), F.lit(True).alias("live"))
    done = None
    while rounds != 0:
        live = state.where("live").drop("live").withColumn("cx", _cell("x", radius)).withColumn("cy", _cell("y", radius))
        if some:
            live = live.join(crowded, ["cx", "cy"], "left")
            by_step, live = live.where("crowded").drop("cx", "cy", "crowded"), live.where("crowded IS NOT TRUE").drop("crowded")
        one, ones = _parts(live, "i", POINTS)
        keys = ["cx", "cy", "i"]
        a = spread(one, *keys).groupBy(*keys)
        b = spread(sent.join(ones, ["cx", "cy"]).withColumn("i", _count("is")), *keys).groupBy(*keys)
        new = a.cogroup(b).applyInArrow(lambda p, d: _climb(p, d, radius, rate, rounds), "u double, v double, x double, y double, k long, live boolean")
        if some:
            far = (F.col("nx") - F.col("x")) ** 2 + (F.col("ny") - F.col("y")) ** 2 > STOP
            step = by_step.join(moved(by_step, data, radius, rate), ["x", "y"]).withColumn("k", F.col("k") + 1)
            new = new.unionByName(step.select("u", "v", F.col("nx").alias("x"), F.col("ny").alias("y"), "k", (far if rounds is None else far & (F.col("k") < rounds)).alias("live")))
        state = cut_lineage(spread(new, "u", "v"))  # checkpoint() computes its last stage twice: not the climb
        rest = state.where("NOT live").select("u", "v", "x", "y")
        done = rest if done is None else done.unionByName(rest)
        if state.where("live").isEmpty():
            return done
    return state.select("u", "v", "x", "y")


def modes(rows: DataFrame, radius: float, rate: float = 0.2, rounds: int | None = None, blur: bool = False) -> DataFrame:
    """(id, x, y): where each row (id, x, y) ends, once all have stopped or after so many rounds. blur: the data move with
    the points, a round behind. Rows whose x or y isn't a finite number are left out."""
    still = rows.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.lit(True).alias("live")).where(_finite())
    state = cut_lineage(still)
    places = lambda: cut_lineage(state.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")))
    if not blur:
        ends = _ends(places(), radius, rate, rounds)
        return state.select("id", F.col("x").alias("u"), F.col("y").alias("v")).join(ends, ["u", "v"]).select("id", "x", "y")
    for _ in count() if rounds is None else range(rounds):
        step = moved(state.where("live"), places(), radius, rate)
        far = (F.col("nx") - F.col("x")) ** 2 + (F.col("ny") - F.col("y")) ** 2 > STOP
        new = state.where("live").join(step, ["x", "y"]).select("id", F.col("nx").alias("x"), F.col("ny").alias("y"), far.alias("live"))
        state = cut_lineage(state.where("NOT live").unionByName(new))
        if state.where("live").isEmpty():
            break
    return state.select("id", "x", "y")


def consolidated(points: DataFrame, radius: float) -> DataFrame:
    """(id, first): the first point of the cluster of each point (id, x, y), clusters taken in the order of ids."""
    side = radius / 1.5  # the diagonal is within the radius
    at = points.where(_finite()).select("id", "x", "y", _cell("x", side).alias("cx"), _cell("y", side).alias("cy"))
    left, firsts = cut_lineage(at), None

    def near(few: DataFrame, many: DataFrame) -> DataFrame:
        """Pairs of the few (id2, x2, y2) with the many (id, x, y) within the radius."""
        sent = few.select(F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"), _around(2).alias("t")).select("id2", "x2", "y2", "t.cx", "t.cy")
        return many.join(sent, ["cx", "cy"]).where(_gap() < radius * radius)

    while not left.isEmpty():
        heads = cut_lineage(left.groupBy("cx", "cy").agg(F.min(F.struct("id", "x", "y")).alias("h")).select("h.*", "cx", "cy"))
        behind = near(heads, left).where("id < id2").select(F.col("id2").alias("id")).distinct()
        new = cut_lineage(heads.join(behind, "id", "left_anti"))
        firsts = new if firsts is None else cut_lineage(firsts.unionByName(new))
        covered = near(new, left).select("id").distinct()
        left = cut_lineage(left.join(covered, "id", "left_anti"))
    if firsts is None:
        return at.select("id", F.col("id").alias("first"))
    return near(firsts, at).groupBy("id").agg(F.min("id2").alias("first"))


def mean_shift(rows: DataFrame, radius: float, rate: float = 0.2, rounds: int | None = None, least: int = 1, blur: bool = False) -> tuple[DataFrame, DataFrame]:
    """(id, cluster) and (cluster, x, y, n): clusters from 1 on by falling size (ties by their first id), -1 for those of under
    ``least`` rows, and the mean of the clusters' modes."""
    at = cut_lineage(modes(rows, radius, rate, rounds, blur))
    own = at.join(consolidated(at, radius), "id")
    sums = own.groupBy("first").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"))
    # a row a cluster
    ranked = cut_lineage(sums.withColumn("cluster", F.row_number().over(Window.orderBy(F.desc("n"), "first"))))
    named = ranked.select("first", F.when(F.col("n") >= least, F.col("cluster")).otherwise(-1).alias("cluster"))
    return own.join(named, "first").select("id", "cluster"), ranked.where(F.col("n") >= least).select("cluster", "x", "y", "n")
