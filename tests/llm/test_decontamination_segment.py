"""The segment with at most one mismatch in five: every substitution pattern within the rule, by brute force."""

from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from lexigraph.llm import decontamination as dc


def within(same):
    """Most matches of the segments with at most one mismatch in five."""
    n = len(same)
    return max(sum(same[a:b]) for a in range(n) for b in range(a + 1, n + 1) if 5 * (b - a - sum(same[a:b])) <= b - a)


@pytest.mark.parametrize("words", range(dc.LEAST, 21))
def test_all_patterns(words):
    """Every pattern of up to a fifth of the words substituted: found if a segment within the rule has enough matches."""
    item = [f"w{i}" for i in range(words)]
    need = min(dc.ENOUGH, -(-4 * words // 5))
    patterns = [p for gone in range(words // 5 + 1) for p in combinations(range(words), gone)]
    most = [within([i not in p for i in range(words)]) for p in patterns]
    texts = [" ".join("other" if i in p else w for i, w in enumerate(item)) for p in patterns]
    got = {row: v[0] for (row, _), v in dc.Block([7], [" ".join(item)]).overlaps(pa.array(texts)).items()}
    assert got == {row: m for row, m in enumerate(most) if m >= need}


def test_segment_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(500):
        same = rng.random(rng.integers(1, 25)) < 0.75
        start, end, matched = dc._segment(same)
        assert matched == int(same[start:end].sum()) and 5 * (end - start - matched) <= end - start
        assert matched == (within(same.tolist()) if same.any() else 0)
