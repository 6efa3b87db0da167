"""Sessions of a replayed stream against the batch answer; late rows."""

import datetime
import random
import uuid

import pytest

from gridloom.operators import cluster
from gridloom.streaming import sessions

T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def batch(rows, gap):
    """Sessions of (key, seconds, value) rows."""
    out = []
    for key in {r[0] for r in rows}:
        own = sorted((int(s * 1000), v) for k, s, v in rows if k == key)
        for t, v in own:
            if out and out[-1][0] == key and t - out[-1][2] < gap:
                out[-1] = (key, out[-1][1], t, out[-1][3] + 1, out[-1][4] + v)
            else:
                out.append((key, t, t, 1, v))
    base = int(T0.timestamp() * 1000)
    return sorted((k, base + a, base + b, n, round(v, 6)) for k, a, b, n, v in out)


def frame(spark, rows):
    return spark.createDataFrame([(k, T0 + datetime.timedelta(seconds=s), v) for k, s, v in rows], "key long, ts timestamp, value double")


def shared(spark):
    cluster.cut_lineage(spark.range(1))  # sets a folder, if there is none
    return f"{spark.sparkContext.getCheckpointDir()}/sessions-{uuid.uuid4().hex}"


def got(df):
    return sorted((r.key, r.start, r.stop, r.n, round(r.total, 6)) for r in df.collect())


def test_joined():
    assert sessions.joined([(10, 12, 2, 1.0), (0, 3, 1, 2.0), (5, 6, 1, 1.0)], 5) == [(0, 12, 4, 4.0)]
    assert sessions.joined([(10, 12, 2, 1.0), (0, 3, 1, 2.0)], 5) == [(0, 3, 1, 2.0), (10, 12, 2, 1.0)]


@pytest.mark.parametrize("n", [3])
def test_same_as_batch(spark, n):
    """Batches overlap by less than the watermark's delay, so nothing is late."""
    rng = random.Random(n)
    rows = [(rng.randrange(5), float(rng.randrange(2000)), float(rng.randrange(10))) for _ in range(200)]
    parts = [[r for r in rows if min(int((r[1] + rng.uniform(-40, 40)) * n / 2000), n - 1) == i or (i == 0 and r[1] * n < -1)] for i in range(n)]
    left = [r for r in rows if not any(r in p for p in parts)]
    parts[-1] += left if n == 1 else []
    parts[0] += left if n > 1 else []
    seen = [r for p in parts for r in p]
    out = sessions.replayed(frame(spark, seen), [frame(spark, p) for p in parts], shared(spark), 30_000, "20 minutes")
    assert got(out) == batch(seen, 30_000)


def test_late(spark):
    """A row behind the watermark changes no session."""
    first = [(1, 0.0, 1.0), (1, 5.0, 2.0), (2, 1000.0, 3.0)]
    second = [(1, 7.0, 9.0), (1, 1001.0, 4.0), (2, 1010.0, 5.0)]
    out = sessions.replayed(frame(spark, first + second), [frame(spark, first), frame(spark, second)], shared(spark), 30_000, "60 seconds")
    assert got(out) == batch([*first, *second[1:]], 30_000)
