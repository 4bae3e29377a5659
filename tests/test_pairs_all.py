"""Pairs over every frame, not only over purchases."""

from collections import Counter

from conftest import SF
from waymark.plans import queries as base


def test_every_frame_takes_part(spark):
    sizes = Counter(r.user_id for r in base.table(spark, SF, "events").select("user_id").collect())
    every = base.QUERIES["exhaustive_pairs_all"](spark, SF)
    near = base.QUERIES["sequential_pairs_all"](spark, SF)
    assert every.count() == sum(n * (n - 1) // 2 for n in sizes.values())
    assert near.count() == sum(min(3, n - 1 - i) for n in sizes.values() for i in range(n))
