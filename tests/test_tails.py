import itertools
import math

import numpy as np
import pytest

from cohortframe.functions import tails


def test_t_tail_known_values():
    got = tails.t_sf(np.array([2.0, -2.0, 0.0, 12.706]), np.array([5.0, 5.0, 3.3, 1.0]))
    assert got == pytest.approx([0.05096974, 0.94903026, 0.5, 0.025], abs=1e-6)


def test_t_tail_with_one_degree_is_cauchy():
    t = np.linspace(-30, 30, 41)
    assert tails.t_sf(t, np.ones_like(t)) == pytest.approx(0.5 - np.arctan(t) / math.pi, abs=1e-12)


def test_normal_and_chi_square():
    assert tails.normal_sf(np.array([1.959964]))[0] == pytest.approx(0.025, abs=1e-7)
    assert tails.chi2_1_sf(np.array([3.841459]))[0] == pytest.approx(0.05, abs=1e-7)


@pytest.mark.parametrize("k, population, successes, draws", [(2, 10, 4, 3), (0, 10, 4, 3), (3, 10, 4, 3), (5, 20, 12, 14), (6, 20, 12, 14)])
def test_hypergeometric_counts(k, population, successes, draws):
    total = math.comb(population, draws)
    want = sum(
        math.comb(successes, i) * math.comb(population - successes, draws - i)
        for i in range(k, min(successes, draws) + 1)
        if 0 <= draws - i <= population - successes
    )
    assert tails.hypergeometric_sf(k, population, successes, draws) == pytest.approx(want / total, rel=1e-9)


@pytest.mark.parametrize("n1, n2", [(3, 4), (2, 2), (4, 2), (1, 5)])
def test_exact_rank_sum_by_listing(n1, n2):
    us = []
    for chosen in itertools.combinations(range(n1 + n2), n1):
        us.append(sum(chosen) - n1 * (n1 - 1) // 2)
    us = np.array(us)
    for u in range(n1 * n2 + 1):
        tail = (us >= u).mean() if u > n1 * n2 / 2 else (us <= u).mean()
        assert tails.exact_rank_sum_p(u, n1, n2) == pytest.approx(min(1.0, 2 * tail))
