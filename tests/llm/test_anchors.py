"""Entries of a text do not depend on the batch that it lies in."""

import numpy as np

from spanweave.llm import substrings


def test_entries_do_not_depend_on_the_batch():
    rng = np.random.default_rng(4)
    for text in (rng.integers(97, 123, 3000, dtype=np.uint8), np.full(3000, 97, dtype=np.uint8), np.tile(rng.integers(97, 123, 40, dtype=np.uint8), 75)):
        alone = substrings.find_entries(text, np.array([len(text)]), 400)
        other = rng.integers(97, 123, 3_000_000, dtype=np.uint8)
        row, key, lo, n = substrings.find_entries(np.r_[other, text], np.array([len(other), len(text)]), 400)
        last = row == 1
        assert np.array_equal(key[last], alone[1]) and np.array_equal(lo[last], alone[2]) and np.array_equal(n[last], alone[3])
        assert n[last].sum() == len(text) - 399
