"""Bitmaps of shingle sets bound what two sets share from above."""

import numpy as np
import pytest

from pathfold.llm import jaccard, textvec


@pytest.mark.parametrize("seed", range(4))
def test_bitmaps_never_lose_a_link(seed):
    r = np.random.default_rng(seed)
    every = textvec.mix(np.arange(3000, dtype=np.uint64)) >> np.uint64(1)
    sets = [np.unique(r.choice(every, r.integers(1, 400))) for _ in range(20)]
    for _ in range(100):
        a = sets[r.integers(len(sets))]
        sets.append(np.unique(np.concatenate((r.choice(a, r.integers(0, len(a) + 1)), r.choice(every, r.integers(1, 60))))))
    maps = jaccard.Bitmaps([np.frombuffer(jaccard.bitmap(x), dtype=np.uint64) for x in sets], np.array([len(x) for x in sets]))
    for k in range(0, len(sets), 7):
        ok = np.arange(len(sets)) != k
        most = maps.most_shared(k, ok)
        assert most[k] == -1 and all(most[j] >= len(np.intersect1d(sets[k], sets[j])) for j in range(len(sets)) if j != k)
