"""Sums of weights by key, and items by passage, against plain sums."""

import numpy as np
import pytest

from spanweave.llm import decontamination


@pytest.mark.parametrize("n", [40, 100_000])
def test_sums_do_not_depend_on_how_keys_lie(n):
    rnd = np.random.default_rng(3)
    key, weight = rnd.integers(0, n, 500), rnd.random(500)
    some = np.unique(rnd.integers(0, n, 20))
    total = {}
    for k, w in zip(key.tolist(), weight.tolist()):
        total[k] = total.get(k, 0.0) + w
    keys, sums = decontamination._reached(key, weight, n, 0.8)
    assert dict(zip(keys.tolist(), sums.tolist())) == {k: total[k] for k in sorted(total) if total[k] >= 0.8} and len(keys)
    assert decontamination._among(key, some, n).tolist() == [k in set(some.tolist()) for k in key.tolist()]
    assert decontamination._distinct(key).tolist() == sorted(set(key.tolist())) and not len(decontamination._distinct(key[:0]))
