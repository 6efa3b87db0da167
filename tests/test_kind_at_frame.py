"""Kinds at frames, asked for every frame of every stream."""

from gridloom.plans import catalog
from gridloom.plans import inputs as I

D = "/root/testdata/sf0.001"


def test_every_frame_has_its_kind(spark):
    want = {(r.user_id, r.seq): r.type for r in I.ordered_events(spark, D).collect()}
    rows = catalog.QUERIES["kind_at_frame"](spark, D).collect()
    assert len(rows) == len(want) == I.table(spark, D, "events").count()
    assert {(r.stream, r.frame): r.kind for r in rows} == want
