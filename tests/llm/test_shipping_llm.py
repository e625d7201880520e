"""The training-data operators run where workers cannot import the package."""

from tests.test_shipping import run_away


def test_queries_run_where_workers_lack_the_package(tmp_path):
    out = run_away(tmp_path, ["p1_found", "p2_found", "p4_found", "p7_ids", "p8_packing", "p9_found"])
    assert all(q in out for q in ("p1_found", "p9_found"))
