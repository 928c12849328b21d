import math

import pytest

from helixframe.functions import matrix as M
from helixframe.plans import adapters as A


@pytest.mark.parametrize("values", [[[1], [2], [3]], [[1, 2], [1], [1], [1]], [[], [], [], []], [["a"], [1], [1], [1]]])
def test_shapes(values):
    with pytest.raises(ValueError):
        M.Matrix(values)


def test_kinds():
    for bad in ([[0], [0], [0], [0]], [[-1], [1], [1], [1]], [[0.5], [1], [1], [1]]):
        with pytest.raises(ValueError):
            M.Pfm(bad)
    for bad in ([[0.5], [0.5], [0.5], [0]], [[-0.1], [0.6], [0.5], [0]]):
        with pytest.raises(ValueError):
            M.Ppm(bad)
    assert M.Ppm([[0.1], [0.2], [0.3], [0.4]]).length == 1
    assert M.Pfm([[1], [1], [1], [1]], "i").label == "i,i"


def test_score():
    m = M.Pwm([[1, 0], [0, 1], [0, 0], [1, -1]], "x", "y")
    assert m.score("AC") == m.score("tc") == 1.0 and m.score("NN") == 0 and m.score("AT") == 0
    with pytest.raises(ValueError):
        m.score("A")
    assert m.reverse() == [[-100_000, 100_000], [0, 0], [100_000, 0], [0, 100_000]]


def test_algebra(spark):
    long = M.long_form(spark, A.PFMS)
    ppm = M.collected(M.to_ppm(long))
    assert ppm[0][0][0] == pytest.approx(12 / 21) and ppm[0][0][1] == 0
    norm = M.collected(M.normalize(M.to_ppm(long)))
    extra = 0.001 / (1 - 0.004)
    assert norm[0][0][1] == pytest.approx(extra / (1 + 4 * extra)) and norm[0][0][0] == pytest.approx(12 / 21)
    for pfm, w in zip(A.PFMS, M.pfms_to_pwms(spark, A.PFMS)):
        assert w.values == M.weights(pfm).values
    bg = {"A": 0.3, "C": 0.3, "G": 0.15, "T": 0.25}
    assert M.weights(A.PFMS[0], bg).values[0][0] == round(math.log(12 / 21 / 0.3), 5)
    for pseudo in (0, 0.25, 1):
        with pytest.raises(ValueError):
            M.normalize(long, pseudo)
