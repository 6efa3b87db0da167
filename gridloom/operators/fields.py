"""Relaxations and offsets on grids: geodesic distances, segments of a field, lattices, gains, cell histograms."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import cut_lineage
from .grid import EIGHT, gradient


def geodesic(df: DataFrame, start: DataFrame, delta: float, rounds: int = 1000) -> DataFrame:
    """(r, c, dist): least over paths of 8-neighbour steps of sqrt(length^2 + delta^2 * change of v^2),
    from the cells of start (r, c, dist). Only cells that got nearer pass it on; each round is checkpointed."""
    dist = df.select("r", "c", "v").join(start, ["r", "c"], "left")
    front = dist.where("dist IS NOT NULL")
    for _ in range(rounds):
        arr = F.explode(F.array(*(F.struct((F.col("r") + i).alias("r"), (F.col("c") + j).alias("c"), F.lit(float(i * i + j * j)).alias("a")) for i, j in EIGHT)))
        sent = front.select(F.col("v").alias("v0"), F.col("dist").alias("d0"), arr.alias("t")).select("v0", "d0", "t.r", "t.c", "t.a")
        step = F.sqrt(F.col("a") + delta * delta * (F.col("v") - F.col("v0")) ** 2)
        new = df.select("r", "c", "v").join(sent, ["r", "c"]).groupBy("r", "c").agg(F.min(F.col("d0") + step).alias("new"))
        both = cut_lineage(dist.join(new, ["r", "c"], "left"))
        front = both.where("new IS NOT NULL AND (dist IS NULL OR new < dist - 1e-12)").select("r", "c", "v", F.col("new").alias("dist"))
        dist = both.select("r", "c", "v", F.least("dist", "new").alias("dist"))
        if not front.limit(1).count():
            return dist.select("r", "c", "dist")
    raise RuntimeError("distances have not settled")


def segments(field: DataFrame) -> DataFrame:
    """(y, x, segment): 4-connected places whose patches are shifted alike; a segment is known by its
    first place in scan order, as y * 2^20 + x. Labels spread and jump; each round is checkpointed."""
    at = field.select("y", "x", (F.col("ty") - F.col("y")).alias("dy"), (F.col("tx") - F.col("x")).alias("dx"), (F.col("y").cast("long") * (1 << 20) + F.col("x")).alias("me"))
    arr = F.explode(F.array(*(F.struct((F.col("y") + i).alias("y"), (F.col("x") + j).alias("x")) for i, j in ((0, 1), (1, 0)))))
    sent = at.select("dy", "dx", F.col("me").alias("a"), arr.alias("t")).select("dy", "dx", "a", "t.y", "t.x")
    links = sent.join(at.select("y", "x", "dy", "dx", F.col("me").alias("b")), ["y", "x", "dy", "dx"]).select("a", "b")
    links = cut_lineage(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = at.select("me", F.col("me").alias("low"))
    while True:
        near = links.join(label, F.col("b") == F.col("me")).groupBy("a").agg(F.min("low").alias("near"))
        low = label.join(near, F.col("me") == F.col("a"), "left").select("me", F.col("low").alias("was"), F.least("low", "near").alias("low"))
        up = low.select(F.col("me").alias("low"), F.col("low").alias("top"))
        new = cut_lineage(low.join(up, "low").select("me", "was", F.least("low", "top").alias("low")))
        moved = new.where("low < was").limit(1).count()
        label = new.select("me", "low")
        if not moved:
            return at.join(label, "me").select("y", "x", F.col("low").alias("segment"))


def offset_density(field: DataFrame, sigma: float, reach: int) -> DataFrame:
    """(dy, dx, e): for each offset of the field, sum of exp(-d^2 / (2 sigma)) over all places' offsets
    within reach, less the mean over the offsets there are."""
    n = field.groupBy((F.col("ty") - F.col("y")).alias("dy"), (F.col("tx") - F.col("x")).alias("dx")).agg(F.count(F.lit(1)).alias("n"))
    arr = F.explode(F.array(*(F.struct((F.col("dy") + i).alias("dy"), (F.col("dx") + j).alias("dx"), F.lit(math.exp(-(i * i + j * j) / (2 * sigma))).alias("g")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1))))
    sent = n.select("n", arr.alias("t")).select("t.dy", "t.dx", (F.col("n") * F.col("t.g")).alias("g"))
    e = n.select("dy", "dx").join(sent, ["dy", "dx"]).groupBy("dy", "dx").agg(F.sum("g").alias("e"))
    mean = e.agg(F.avg("e").alias("m"))
    return e.crossJoin(F.broadcast(mean)).select("dy", "dx", (F.col("e") - F.col("m")).alias("e"))  # one row


def gain_bias(pairs: DataFrame, a: str, b: str, gains: tuple[float, float], biases: tuple[float, float]) -> DataFrame:
    """pairs with gain and bias that take the array b to the array a: ratio of deviations and
    difference of means, clamped."""
    mean = lambda c: F.aggregate(F.col(c), F.lit(0.0), lambda s, x: s + x) / F.size(c)
    dev = lambda c: F.sqrt(F.aggregate(F.col(c), F.lit(0.0), lambda s, x: s + (x - F.col(f"_{c}")) * (x - F.col(f"_{c}"))) / F.size(c))
    rows = pairs.withColumn(f"_{a}", mean(a)).withColumn(f"_{b}", mean(b))
    gain = F.least(F.lit(gains[1]), F.greatest(F.lit(gains[0]), F.coalesce(dev(a) / F.nullif(dev(b), F.lit(0.0)), F.lit(1.0))))
    rows = rows.withColumn("gain", gain)
    bias = F.least(F.lit(biases[1]), F.greatest(F.lit(biases[0]), F.col(f"_{a}") - F.col("gain") * F.col(f"_{b}")))
    return rows.withColumn("bias", bias).drop(f"_{a}", f"_{b}")


def cell_histograms(df: DataFrame, cell: int, bins: int) -> DataFrame:
    """(cr, cc, bin, m): gradient magnitude by cell and orientation modulo pi, hard bins."""
    g = gradient(df)
    m = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))
    turn = F.pmod(F.atan2("gy", "gx"), F.lit(math.pi)) / math.pi
    b = F.pmod(F.floor(turn * bins + 1e-9), F.lit(bins)).cast("int")
    return g.where(m > 0).groupBy(F.floor(F.col("r") / cell).cast("int").alias("cr"), F.floor(F.col("c") / cell).cast("int").alias("cc"), b.alias("bin")).agg(F.sum(m).alias("m"))


def subset(df: DataFrame, n: int, how: str, order: str, value: str | None = None) -> DataFrame:
    """n rows of df: first, last, uniform (evenly spread over the order), largest or smallest values
    (earlier rows first among equal ones). Rows keep their order column."""
    if how in ("first", "last"):
        return df.orderBy(F.asc(order) if how == "first" else F.desc(order)).limit(n)
    if how in ("largest", "smallest"):
        return df.orderBy(F.desc(value) if how == "largest" else F.asc(value), order).limit(n)
    if how != "uniform":
        raise ValueError(how)
    from .ranked import running

    total = df.count()
    ranks = running(df.withColumn("_s", -F.col(order).cast("double")), "_s", order, {})
    wanted = sorted({round((total - 1) * k / max(1, n - 1)) + 1 for k in range(n)})
    return ranks.where(F.col("rank").isin(wanted)).select(*df.columns)


def path_counts(paths: DataFrame, k: int) -> DataFrame:
    """(node, n): how many paths (arrays of children 1 .. k) pass each node of a tree; the root is 0
    and the d-th child of node p is p * k + d."""
    run = F.aggregate(F.col("path"), F.array(F.lit(0).cast("long")), lambda s, d: F.concat(s, F.array(F.element_at(s, -1) * k + d)))
    return paths.select(F.explode(run).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))


def components_of(links: DataFrame) -> DataFrame:
    """(node, root) of links (a, b): the least node reachable. All joins are by shuffle: tables that get small enough for a
    broadcast would go through the driver, several a round."""
    both = cut_lineage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
    while True:
        near = both.join(label.hint("merge"), F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        low = label.join(near.hint("merge"), F.col("node") == F.col("a")).select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        # all nodes of a root go to the least root next to any of them, so that long chains take few rounds
        hook = low.groupBy("was").agg(F.min("root").alias("root"))
        low = cut_lineage(low.select("node", "was").join(hook.hint("merge"), "was"))
        up = low.select(F.col("node").alias("root"), F.col("root").alias("top"))
        new = cut_lineage(low.join(up.hint("merge"), "root").select("node", "was", F.least("root", "top").alias("root")))
        moved = new.where("root < was").limit(1).count()
        label = new.select("node", "root")
        if not moved:
            return label


