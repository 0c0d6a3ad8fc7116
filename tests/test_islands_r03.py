"""Cuts of many islands at once are those of each island by itself."""

import numpy as np
import pytest

from strandloom.operators import consensus


@pytest.mark.parametrize("width", [0.4, 3.2, 9.0])
def test_cuts_of_many_islands(width):
    rng = np.random.default_rng(1)
    size = int(8 * width) + 1
    summits, island, lengths, want, at = [], [], [], [], -20
    for k in range(300):
        s = np.sort(at + rng.integers(0, int(size * rng.choice([0.3, 3, 12])) + 1, rng.integers(1, 12)))
        s = s[: int(np.append(np.flatnonzero(np.diff(s) > size), len(s) - 1)[0]) + 1]
        lo, heads = consensus.separators(s, np.ones(len(s)), width, size)
        length = int(s[0]) + 2000 if k else 5
        edges = np.concatenate([[0], np.clip(heads + lo, 0, length), [length]])
        j = np.searchsorted(heads + lo, s, side="right")
        want += list(zip(edges[j].tolist(), edges[j + 1].tolist(), strict=True))
        summits.append(s)
        island += [k] * len(s)
        lengths += [length] * len(s)
        at = int(s[-1]) + size + 1
    left, right = consensus.bounds(np.concatenate(summits), np.array(island), np.array(lengths), width, size)
    assert list(zip(left.tolist(), right.tolist(), strict=True)) == want
