"""Limits of density maps: seeded placements counted again by hand, the same in any partitioning."""

import itertools
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.operators import maps


@pytest.fixture(scope="module")
def given(spark):
    rows = [("a", 2, 2), ("a", 2, 3), ("b", 2, 2), ("b", 9, 9), ("c", 3, 2), ("d", 7, 1), ("d", 7, 1), ("e", 2, 2)]
    mask = [(x, y) for x in range(12) for y in range(10) if (x + y) % 5]
    return spark.createDataFrame(rows, "study string, x int, y int"), spark.createDataFrame(mask + mask[:3], "x int, y int"), rows, set(mask)


def test_placements_stay_in_the_mask_and_use_all_of_it(spark, given):
    foci, mask, rows, points = given
    got = maps.placed(foci, mask, ["x", "y"], "study", 200, 3).collect()
    assert {(r.x, r.y) for r in got} == points
    assert Counter((r["round"], r.study) for r in got) == {(n, s): c for n in range(1, 201) for s, c in Counter(r[0] for r in rows).items()}
    again = maps.placed(foci.repartition(5), mask.repartition(3), ["x", "y"], "study", 200, 3).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    other = maps.placed(foci, mask, ["x", "y"], "study", 200, 4).collect()
    assert sorted(map(tuple, got)) != sorted(map(tuple, other))


@pytest.mark.parametrize("share", [0.9, 0.95])
def test_limit_is_that_of_the_maxima(spark, given, share):
    foci, mask, _, points = given
    drawn = defaultdict(set)
    for r in maps.placed(foci, mask, ["x", "y"], "study", 40, 1).collect():
        for dx, dy in itertools.product((-2, -1, 0, 1, 2), repeat=2):
            if math.hypot(dx, dy) <= 2 and (r.x + dx, r.y + dy) in points:
                drawn[r["round"]].add((r.study, r.x + dx, r.y + dy))
    want = {n: max(Counter((x, y) for _, x, y in v).values()) / 5 for n, v in drawn.items()}
    limit, largest = maps.density_limit(foci, mask, ["x", "y"], "study", 2.0, 40, share, 1)
    assert {r["round"]: r.largest for r in largest.collect()} == want
    assert limit.first().limit == sorted(want.values())[math.ceil(40 * share) - 1]


def test_points_above_chance(spark, given):
    foci, mask, _, points = given
    got = {(r.x, r.y): r for r in maps.above_chance(foci, mask, ["x", "y"], "study", 1.0, 60).collect()}
    own = {(r.x, r.y): r.share for r in maps.kernel_density(foci, ["x", "y"], "study", 1.0).collect()}
    assert {k: r.share for k, r in got.items()} == {k: v for k, v in own.items() if k in points}
    assert all(r.above == (r.share > r.limit) for r in got.values()) and got[2, 2].above
    assert maps.above_chance(foci.where(F.lit(False)), mask, ["x", "y"], "study", 1.0, 5).collect() == []
