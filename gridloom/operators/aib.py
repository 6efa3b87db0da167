"""Merging of words by the information that they lose about classes, and cuts of the tree.

Leaves are words 0 .. n - 1 with their shares of each class; merge m makes node n + m. A tree is a
table (node, parent); the root has a null parent. Words are a vocabulary, so the tree is small
against the data: merging runs on the driver over at most ``WORDS`` words, and says so beyond.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that the driver merges at most: the pair table has their square.
WORDS = 4096


def information(joint: np.ndarray) -> float:
    """Mutual information of a table of shares, in nats."""
    p = joint / joint.sum()
    e = p.sum(axis=1, keepdims=True) * p.sum(axis=0, keepdims=True)
    m = p > 0
    return float((p[m] * np.log(p[m] / e[m])).sum())


def _losses(p: np.ndarray, i: int) -> np.ndarray:
    """Information lost by merging row i with each row."""
    xlogx = lambda a: np.where(a > 0, a * np.log(np.where(a > 0, a, 1)), 0)
    own = lambda a: xlogx(a).sum(axis=-1) - xlogx(a.sum(axis=-1))
    return own(p) + own(p[i]) - own(p + p[i])


def merge_words(joint: np.ndarray) -> tuple[list[tuple[int, int, int]], list[float]]:
    """Merges (a, b, new node), cheapest first (least nodes of equal ones), and the information before
    each and at the end. Words without counts merge first."""
    p = joint / joint.sum()
    n = len(p)
    p = np.concatenate((p, np.zeros((max(n - 1, 0), p.shape[1]))))
    alive = list(range(n))
    best = {i: None for i in alive}

    def look(i: int):
        others = [j for j in alive if j > i]
        if not others:
            return (np.inf, i, i)
        d = np.maximum(_losses(p[others + [i]], len(others))[:-1], 0)
        k = int(np.argmin(np.round(d, 12)))
        return (round(float(d[k]), 12), i, others[k])

    for i in alive:
        best[i] = look(i)
    steps, left = [], [information(joint)]
    for new in range(n, 2 * n - 1):
        _, a, b = min(best.values())
        p[new] = p[a] + p[b]
        alive = [x for x in alive if x not in (a, b)] + [new]
        del best[a], best[b]
        best[new] = (np.inf, new, new)
        for i in alive[:-1]:
            if best[i][2] in (a, b) or best[i][0] == np.inf:
                best[i] = look(i)
            else:
                d = round(max(float(_losses(p[[i, new]], 0)[1]), 0.0), 12)
                best[i] = min(best[i], (d, i, new))
        steps.append((a, b, new))
        left.append(information(p[alive]))
    return steps, left


def tree(counts: DataFrame) -> tuple[DataFrame, list[float]]:
    """(node, parent) of the merges over counts (word, class, n), words numbered from 0; and the
    information left after each merge."""
    spark = counts.sparkSession
    table = counts.groupBy("word").pivot("class").agg(F.sum("n")).fillna(0).orderBy("word")
    rows = table.limit(WORDS + 1).collect()
    if len(rows) > WORDS:
        raise ValueError(f"more than {WORDS} words")
    joint = np.array([r[1:] for r in rows], float)
    steps, left = merge_words(joint)
    parent = {x: new for a, b, new in steps for x in (a, b)}
    nodes = range(len(rows) + len(steps))
    return spark.createDataFrame([(x, parent.get(x)) for x in nodes], "node long, parent long"), left


def cut(parents: DataFrame, words: int, clusters: int) -> DataFrame:
    """(word, node, cluster): the node that stands for each word when the last clusters - 1 merges are
    undone, and its number from 1, in the order of nodes."""
    top = 2 * words - 1 - clusters  # nodes above this one are undone
    at = parents.where(F.col("node") < words).select(F.col("node").alias("word"), "node")
    up = parents.where(F.col("parent") <= top).select(F.col("node").alias("low"), "parent")
    while True:
        new = at.join(up, F.col("node") == F.col("low"), "left").select("word", F.coalesce("parent", "node").alias("node"), F.col("parent").isNotNull().alias("moved"))
        new = new.sparkSession.createDataFrame(new.collect(), new.schema)  # a row a word
        at = new.select("word", "node")
        if new.where("moved").limit(1).count() == 0:
            break
    number = at.select("node").distinct()
    from pyspark.sql import Window

    number = number.select("node", F.row_number().over(Window.orderBy("node")).alias("cluster"))  # clusters rows
    return at.join(number, "node").select("word", "node", "cluster")


def push(data: DataFrame, cut_: DataFrame) -> DataFrame:
    """data (.., word) with the cluster of each word; null for other words."""
    return data.join(cut_.select("word", "cluster"), "word", "left")


def cut_histogram(data: DataFrame, cut_: DataFrame, clusters: int) -> DataFrame:
    """(cluster, n): rows of data of each cluster, 0 included."""
    n = push(data.groupBy("word").agg(F.count(F.lit(1)).alias("m")), cut_).where("cluster IS NOT NULL").groupBy("cluster").agg(F.sum("m").alias("n"))
    every = data.sparkSession.range(1, clusters + 1).select(F.col("id").cast("int").alias("cluster"))
    return every.join(n, "cluster", "left").select("cluster", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def tree_histogram(data: DataFrame, parents: DataFrame) -> DataFrame:
    """(node, n): rows of data whose word is below each node, or the node itself if it is a leaf; values
    that aren't leaves of the tree count nowhere."""
    leaves = parents.select("node").join(parents.select(F.col("parent").alias("node")), "node", "left_anti")
    level = data.groupBy(F.col("word").cast("long").alias("node")).agg(F.count(F.lit(1)).alias("n")).join(leaves, "node")
    total = level
    while True:
        level = level.join(parents.where("parent IS NOT NULL"), "node").groupBy(F.col("parent").alias("node")).agg(F.sum("n").alias("n"))
        rows = level.collect()  # nodes of a level of the tree
        if not rows:
            break
        level = data.sparkSession.createDataFrame(rows, level.schema)
        total = total.unionByName(level)
    n = total.groupBy("node").agg(F.sum("n").alias("n"))
    return parents.select("node").join(n, "node", "left").select("node", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
