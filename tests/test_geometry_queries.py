"""The geometry queries reach both branches of what they test."""

from __future__ import annotations

from gridlake.plans import geometry

FOLDER = "/root/testdata/sf0.001"


def test_yard_flag_and_extents(spark):
    ties = geometry.tie_detection(spark, "/root/testdata/sf0.01").select("EM_SUB", "DIST_M", "CTMT", "CTMT_VIZ").collect()
    assert {r.EM_SUB for r in ties} == {True, False}
    assert all(0 <= r.DIST_M <= 2 and r.CTMT != r.CTMT_VIZ for r in ties)
    rows = geometry.area_inventory(spark, FOLDER).collect()
    assert rows and all(r.lon_min is not None and r.lat_max >= r.lat_min for r in rows)
