"""The driver's contract on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from gridloom.plans import catalog

D = "/root/testdata/sf0.001"
SAMPLE = ["ratio_match", "pairwise_emd", "roc_eer", "pr_ap11", "histc2_2d", "box_nms_greedy", "vlad", "split_gini", "behavior_runs", "lbp_hist", "flatmap_roots"]
# queries of new operators and of rules that changed
SAMPLE += ["forest_apply", "stump_errors", "pca_covariance", "pca_first", "kd_neighbours", "hog_uoctti", "hog_tiles", "fhog", "dense_sift", "dense_sift_flat", "slic_two_rounds", "poisson_rounds", "patch_search_random"]
SAMPLE += ["solve2", "solve_any", "to_size_odd", "scale_field_sizes", "difference_matrix_masked", "combine_means", "combine_strongest", "box_filter_sampled", "triangle_filter_wide", "homography_grid", "grid_moments", "frame_ellipses", "box_nms_max", "box_iou"]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "part", "orders", "customer", "supplier", "events", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, D)
    names = sorted(got.columns)
    shown = lambda rows: sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    want = con.sql(catalog.ORACLE[name])
    assert sorted(want.columns) == names
    assert shown(got.select(*names).collect()) == shown(con.sql(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({catalog.ORACLE[name]})").fetchall())
