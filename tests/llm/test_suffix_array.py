import itertools
import random

import numpy as np

from tidemark.llm.suffix_array import permuted_prefixes, suffix_array


def check(t):
    b = t.tobytes()
    sa = suffix_array(t, 1000)
    assert sa.tolist() == sorted(range(len(t)), key=lambda i: b[i:])
    before, shared = permuted_prefixes(t, sa, 200)
    for i, k in zip(sa[1:].tolist(), sa[:-1].tolist()):
        m = next((m for m in range(len(t)) if max(i, k) + m >= len(t) or b[i + m] != b[k + m]), len(t))
        assert before[i] == k and (shared[i] == m or max(i, k) + m == len(t) and shared[i] >= m)


def test_all_short_strings():
    for n in range(1, 7):
        for t in itertools.product([1, 2, 3], repeat=n):
            check(np.array(t, np.uint8))


def test_random_strings_runs_and_periods():
    rng = random.Random(2)
    for _ in range(150):
        top = rng.choice([1, 2, 3, 40])
        check(np.array([rng.randrange(1, top + 1) for _ in range(rng.randrange(1, 150))], np.uint8))
    check(np.tile(np.array([3, 1, 2], np.uint8), 50))


def test_ordered_to_the_depth_over_many_letters():
    t = np.random.default_rng(1).integers(1, 250, 20_000).astype(np.uint8)
    t[9_000:12_000] = t[1_000:4_000]
    b, sa = t.tobytes(), suffix_array(t, 400)
    assert sorted(sa.tolist()) == list(range(len(t)))
    assert all(b[i : i + 400] <= b[k : k + 400] for i, k in zip(sa, sa[1:]))
