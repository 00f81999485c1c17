import math

import pytest

from tablescout.functions.tails import chi2_tail, f_tail, t_tail


@pytest.mark.parametrize("tail,args,expected", [
    (chi2_tail, (3.841459, 1), 0.05),
    (chi2_tail, (18.307038, 10), 0.05),
    (chi2_tail, (0.0, 4), 1.0),
    (chi2_tail, (5.0, 0), 1.0),
    (t_tail, (2.228139, 10), 0.05),
    (t_tail, (12.706205, 1), 0.05),
    (t_tail, (0.0, 7), 1.0),
    (f_tail, (4.102821, 2, 10), 0.05),
    (f_tail, (161.447639, 1, 1), 0.05),
    (f_tail, (math.inf, 2, 10), 0.0),
])
def test_textbook_values(tail, args, expected):
    assert tail(*args) == pytest.approx(expected, abs=1e-6)


@pytest.mark.parametrize("stat", [0.3, 1.7, 9.0, 60.0])
def test_two_numerator_degrees_have_a_closed_form(stat):
    assert f_tail(stat, 2, 599_997) == pytest.approx((599_997 / (599_997 + 2 * stat)) ** (599_997 / 2), rel=1e-8)


@pytest.mark.parametrize("stat", [0.5, 3.0, 40.0])
def test_even_chi_square_has_a_closed_form(stat):
    half = stat / 2
    assert chi2_tail(stat, 6) == pytest.approx(math.exp(-half) * (1 + half + half * half / 2), rel=1e-10)


def test_large_samples_approach_the_normal_law():
    assert t_tail(1.959964, 5_000_000) == pytest.approx(0.05, abs=1e-6)


@pytest.mark.parametrize("dof", [1e6, 1e9, 1e12])
@pytest.mark.parametrize("t", [0.1, 1.0, 2.0, 5.0])
def test_many_degrees_of_freedom_approach_the_normal_law(t, dof):
    # The first term of the t law's expansion about the normal one.
    normal, density = math.erfc(t / math.sqrt(2)), math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
    assert t_tail(t, dof) == pytest.approx(normal + density * (t**3 + t) / (2 * dof), abs=1e-9)
