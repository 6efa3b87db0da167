"""Clustering steps and loops, and trees of parents.

Loops keep their state in small tables (centres, labels); rows are only read. State of the size of
the data (labels, distances) is checkpointed each round into the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .neighbors import nearest_centre


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() into spark.checkpoint.dir; a local session without one uses a temporary folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            base = tempfile.mkdtemp(prefix="gridloom-")
        sc.setCheckpointDir(base)
    return df.checkpoint()


def means(rows: DataFrame, by: str, digits: int | None = None) -> DataFrame:
    """(k, c): mean of x (arrays) by column ``by``."""
    m = F.avg("v")
    long = rows.select(F.col(by).alias("k"), F.posexplode("x").alias("i", "v")).groupBy("k", "i").agg((F.round(m, digits) if digits is not None else m).alias("m"))
    return long.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))


def kmeans_step(rows: DataFrame, centres: DataFrame, digits: int | None = None) -> DataFrame:
    """(k, c) after one step: rows (id, x) go to the nearest centre, centres to the mean of their
    rows; a centre without rows stays."""
    at = nearest_centre(rows, centres)
    moved = means(rows.join(at.select("id", "k"), "id"), "k", digits).withColumnRenamed("c", "n")
    return centres.join(moved, "k", "left").select("k", F.coalesce("n", "c").alias("c"))


def kmeans(rows: DataFrame, centres: DataFrame, rounds: int = 100, tolerance: float = 1e-9) -> tuple[DataFrame, list[float]]:
    """Centres and the energy before each step, until it falls by less than tolerance of itself."""
    energies: list[float] = []
    for _ in range(rounds):
        energy = nearest_centre(rows, centres).agg(F.sum("distance")).first()[0]
        energies.append(energy)
        if len(energies) > 1 and energies[-2] - energy <= tolerance * energies[-2]:
            break
        centres = cut_lineage(kmeans_step(rows, centres))
    return centres, energies


def sized(assigned: DataFrame) -> DataFrame:
    """Labels 1, 2, .. by falling size of the cluster, then old label. Clusters are few."""
    from pyspark.sql import Window

    size = assigned.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    order = size.select("k", F.row_number().over(Window.orderBy(F.desc("n"), "k")).alias("lbl"))
    return assigned.join(F.broadcast(order), "k").select("id", "lbl")


def gaussian_log(x: Column, mean: Column, variance: Column) -> Column:
    """Log density of a Gaussian with diagonal covariance."""
    import math

    d = F.zip_with(x, mean, lambda a, b: (a - b) * (a - b))
    terms = F.zip_with(d, variance, lambda q, v: -0.5 * (q / v + F.ln(v) + math.log(2 * math.pi)))
    return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)


def posteriors(rows: DataFrame, modes: DataFrame) -> DataFrame:
    """(id, k, p): share of each mode (k, mean, variance, prior) in each row."""
    from pyspark.sql import Window

    both = rows.select("id", "x").join(F.broadcast(modes), F.lit(True))  # a fixed number of modes
    g = both.select("id", "k", (F.ln("prior") + gaussian_log(F.col("x"), F.col("mean"), F.col("variance"))).alias("l"))
    w = Window.partitionBy("id")
    g = g.withColumn("e", F.exp(F.col("l") - F.max("l").over(w)))
    return g.select("id", "k", (F.col("e") / F.sum("e").over(w)).alias("p"))


def em_step(rows: DataFrame, modes: DataFrame, floor: float = 1e-4) -> DataFrame:
    """Modes after one step of expectation and maximisation; variances are at least floor."""
    n = rows.count()
    least = 1e-2 / max(1, modes.count())
    p = posteriors(rows, modes).where(F.col("p") >= least).join(rows.select("id", F.posexplode("x").alias("i", "v")), "id")
    s = p.groupBy("k", "i").agg(F.sum("p").alias("w"), F.sum(F.col("p") * F.col("v")).alias("a"), F.sum(F.col("p") * F.col("v") * F.col("v")).alias("b"))
    s = s.select("k", "i", "w", (F.col("a") / F.col("w")).alias("m"), F.greatest(F.lit(floor), F.col("b") / F.col("w") - (F.col("a") / F.col("w")) ** 2).alias("s"))
    arr = F.array_sort(F.collect_list(F.struct("i", "m", "s")))
    return s.groupBy("k").agg(arr.alias("a"), F.max("w").alias("w")).select("k", F.transform("a", lambda t: t["m"]).alias("mean"), F.transform("a", lambda t: t["s"]).alias("variance"), (F.col("w") / n).alias("prior"))


def mean_shift_step(rows: DataFrame, radius: float, rate: float = 1.0, cell_of: tuple[str, str] = ("x", "y")) -> DataFrame:
    """(id, x, y): points moved by rate towards the mean of the points closer than radius. Points
    are compared with those of the nine cells around them alone."""
    a, b = cell_of
    at = rows.select("id", F.col(a).alias("x"), F.col(b).alias("y")).withColumn("cx", F.floor(F.col("x") / radius)).withColumn("cy", F.floor(F.col("y") / radius))
    # equal points are counted, not paired
    cells = at.groupBy("x", "y", "cx", "cy").agg(F.count(F.lit(1)).alias("n"))
    around = F.explode(F.array(*(F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    sent = cells.select(F.col("x").alias("x2"), F.col("y").alias("y2"), "n", around.alias("t")).select("x2", "y2", "n", "t.cx", "t.cy")
    d = (F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2
    near = cells.select("x", "y", "cx", "cy").join(sent, ["cx", "cy"]).where(d < radius * radius)
    mean = near.groupBy("x", "y").agg((F.sum(F.col("x2") * F.col("n")) / F.sum("n")).alias("mx"), (F.sum(F.col("y2") * F.col("n")) / F.sum("n")).alias("my"))
    return at.join(mean, ["x", "y"]).select("id", ((1 - rate) * F.col("x") + rate * F.col("mx")).alias("x"), ((1 - rate) * F.col("y") + rate * F.col("my")).alias("y"))


def flat_roots(parents: DataFrame) -> DataFrame:
    """(node, root) of (node, parent): the parent's parent, until nothing moves; roots are their own parent."""
    cur = parents.select("node", F.col("parent").alias("root"))
    while True:
        up = cur.select(F.col("node").alias("root"), F.col("root").alias("top"))
        new = cut_lineage(cur.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("top"), "root"))
        moved = new.where("top <> root").limit(1).count()
        cur = new.select("node", F.col("top").alias("root"))
        if not moved:
            return cur


def shortest_paths(edges: DataFrame, source: int, rounds: int = 1000) -> DataFrame:
    """(node, dist): least sums of w over paths of (src, dst, w), w not negative, from source. Only
    nodes that got nearer in a round pass it on."""
    spark = edges.sparkSession
    dist = spark.createDataFrame([(source, 0.0)], "node int, dist double")
    front = dist
    for _ in range(rounds):
        step = front.join(edges, F.col("node") == F.col("src")).groupBy("dst").agg(F.min(F.col("dist") + F.col("w")).alias("new"))
        both = cut_lineage(dist.join(step.withColumnRenamed("dst", "node"), "node", "full"))
        front = both.where("dist IS NULL OR new < dist").where("new IS NOT NULL").select("node", F.col("new").alias("dist"))
        dist = both.select("node", F.least("dist", "new").alias("dist"))
        if not front.limit(1).count():
            return dist
    raise RuntimeError("paths have not settled")


def quick_shift(df: DataFrame, sigma: float, tau: float) -> DataFrame:
    """(r, c, density, pr, pc, gap): Parzen density over the window of 3 sigma, and the nearest cell
    of higher density within tau; cells without one are their own parent, with a null gap."""
    import math

    def near(reach: int, left: DataFrame, right: DataFrame) -> DataFrame:
        shifts = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]
        arr = F.explode(F.array(*(F.struct((F.col("r") + i).alias("r"), (F.col("c") + j).alias("c")) for i, j in shifts)))
        sent = right.select(*(F.col(n).alias(f"{n}2") for n in right.columns), arr.alias("t")).select("*", "t.r", "t.c").drop("t")
        both = left.join(sent, ["r", "c"])
        d = (F.col("r") - F.col("r2")) ** 2 + (F.col("c") - F.col("c2")) ** 2 + (F.col("v") - F.col("v2")) ** 2
        return both.withColumn("d", d)

    g = df.select("r", "c", "v")
    dens = near(math.ceil(3 * sigma), g, g).groupBy("r", "c", "v").agg(F.round(F.sum(F.exp(-F.col("d") / (2 * sigma * sigma))), 9).alias("e"))
    up = near(math.ceil(tau), dens, dens).where((F.col("e2") > F.col("e")) & (F.col("d") <= tau * tau))
    best = up.groupBy("r", "c").agg(F.min(F.struct("d", "c2", "r2")).alias("b"))
    out = dens.join(best, ["r", "c"], "left")
    return out.select("r", "c", F.col("e").alias("density"), F.coalesce("b.r2", "r").alias("pr"), F.coalesce("b.c2", "c").alias("pc"), F.sqrt("b.d").alias("gap"))


def information_loss(joint: DataFrame) -> DataFrame:
    """(a, b, beta): information about cls that merging the values a < b of (val, cls, p) loses.
    Values are a code's letters: few."""
    p = joint.groupBy("val", "cls").agg(F.sum("p").alias("p"))
    xlog = lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0)
    tot = p.groupBy("val").agg(F.sum("p").alias("t"))
    own = p.join(tot, "val").groupBy("val", "t").agg(F.sum(xlog(F.col("p")) - F.when(F.col("p") > 0, F.col("p") * F.ln("t")).otherwise(0.0)).alias("s"))
    arrays = p.groupBy("val").agg(F.map_from_entries(F.collect_list(F.struct("cls", "p"))).alias("m")).join(own, "val")
    left = arrays.select(*(F.col(c).alias(f"{c}1") for c in arrays.columns))
    right = F.broadcast(arrays.select(*(F.col(c).alias(f"{c}2") for c in arrays.columns)))
    both = left.join(right, F.col("val1") < F.col("val2"))
    keys = F.array_union(F.map_keys("m1"), F.map_keys("m2"))
    part = F.aggregate(F.transform(keys, lambda k: xlog(F.coalesce(F.element_at("m1", k), F.lit(0.0)) + F.coalesce(F.element_at("m2", k), F.lit(0.0)))), F.lit(0.0), lambda a, b: a + b)
    return both.select(F.col("val1").alias("a"), F.col("val2").alias("b"), (xlog(F.col("t1") + F.col("t2")) + F.col("s1") + F.col("s2") - part).alias("beta"))


