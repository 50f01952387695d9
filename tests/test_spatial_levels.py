"""Nearest ends in dense places: several widths of cells give what comparing all pairs gives."""

from __future__ import annotations

import math
import random

from gridlake.operators import spatial


def test_dense_places_are_searched_in_finer_cells(spark):
    draw = random.Random(5)
    # one crowded corner, scattered rest, steps of an eighth so that distances tie
    places = [(round(draw.random() * 16) / 8, round(draw.random() * 16) / 8) for _ in range(150)] + [(draw.random() * 9, draw.random() * 9) for _ in range(250)]
    points = [(i, i % 3, *p) for i, p in enumerate(places)]
    ends = [(1000 - i, i % 4, i % 2, y, x) for i, (_, _, x, y) in enumerate(points)]
    radius = 1.5
    found = spatial.proximity_pairs(
        spark.createDataFrame(points, "COD_ID int, CTMT int, x double, y double"),
        spark.createDataFrame(ends, "SSDMT_VIZ int, CTMT_VIZ int, PAC_VIZ int, x double, y double"), radius)
    got = {(r.COD_ID, r.CTMT_VIZ): (r.DIST_M, r.SSDMT_VIZ, r.PAC_VIZ) for r in found.collect()}
    want = {}
    for cod, own, px, py in points:
        for seg, viz, pac, ex, ey in ends:
            d = math.hypot(px - ex, py - ey)
            if viz != own and d <= radius:
                want[cod, viz] = min(want.get((cod, viz), (9.0, 0, 0)), (d, seg, pac))
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1:] == want[k][1:] for k in want)
    # before, every point met every end of the nine cells of the whole radius
    held = spark.createDataFrame([(y, x, viz) for _, viz, _, x, y in ends], "_ex double, _ey double, _eo int").distinct()
    assert spatial._halvings(held, radius) >= 1
