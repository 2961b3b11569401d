"""The packing search ends in bounded time, whatever the lengths."""

import time
from collections import Counter

import numpy as np
import pytest

from spreadlake.llm.packing import best_fit, complete, fillings

CAPACITY = 2048


@pytest.mark.parametrize("mean,sd,n", [(300, 30, 50_000), (120, 15, 10_000), (200, 20, 2_000), (900, 80, 20_000)])
def test_close_lengths(mean, sd, n):
    counts = dict(Counter(np.clip(np.random.default_rng(1).normal(mean, sd, n).round(), 1, CAPACITY).astype(int).tolist()))
    start = time.process_time()
    packing = complete(counts, CAPACITY)
    assert time.process_time() - start < 60
    used = Counter()
    for pattern, times in packing:
        assert sum(pattern) <= CAPACITY
        for s in pattern:
            used[s] += times
    assert used == Counter(counts)
    assert sum(t for _, t in packing) <= sum(t for _, t in best_fit(counts, CAPACITY))


def test_fillings_are_undominated_and_fit():
    counts = {3: 2, 5: 1, 7: 4, 11: 1}
    for room in range(0, 40):
        found = fillings(sorted(counts), counts, room, room)
        assert found
        sums = []
        for f in found:
            assert sum(f) <= room and all(f.count(s) <= counts[s] for s in f)
            sums.append(sum(f))
        assert sums == sorted(sums, reverse=True)
        # the best sum is the best of all subsets
        reach = {0}
        for s, n in counts.items():
            reach |= {x + s * k for x in reach for k in range(1, n + 1)}
        assert sums[0] == max(x for x in reach if x <= room)
