"""Update rules against the goldens of FIXTURES.md section 6 and closed forms."""

import numpy as np
import pytest

from kestrel.operators.gram import settled
from kestrel.operators.rules import SGD, LogisticGD, NormalizedGD

G = np.array([[18.0]])   # points (y=2, x=3), (y=4, x=3)
C = np.array([18.0])
N = 2.0


@pytest.mark.parametrize("updater,reg,after1,after2", [
    ("none", 0.0, 1.91, 1.8520879546),
    ("l1", 0.5, 1.905, 1.8438706188),
    ("l2", 0.5, 1.9, 1.8360068363),
])
def test_sgd_updaters_match_golden(updater, reg, after1, after2):
    rule = SGD(step=0.01, iterations=1, reg=reg, updater=updater)
    w1 = rule.apply([2.0], G, C, N)
    assert w1[0] == pytest.approx(after1, abs=1e-10)
    w2 = SGD(step=0.01, iterations=2, reg=reg, updater=updater).apply([2.0], G, C, N)
    assert w2[0] == pytest.approx(after2, abs=1e-10)


def test_empty_minibatch_keeps_weights():
    w = SGD(step=0.1).apply_iter(np.array([1.0, 2.0]), 1, np.eye(2), np.zeros(2), 0)
    assert list(w) == [1.0, 2.0]


def test_normalized_step_length_and_zero_gradient():
    rule = NormalizedGD(step=0.05, iterations=1, reg=0.0, penalty="none")
    w = rule.apply([0.0, 0.0], np.eye(2), np.array([1.0, 1.0]), 1.0)
    assert np.linalg.norm(w) == pytest.approx(0.05)
    # gradient exactly zero: iterations stop instead of producing NaN (Q3)
    w0 = [1.0, 1.0]
    w = NormalizedGD(step=0.05, iterations=5, reg=0.0, penalty="none").apply(
        w0, np.eye(2), np.array([1.0, 1.0]), 1.0)
    assert list(w) == w0


def test_gram_fold_equals_row_fold():
    rng = np.random.default_rng(0)
    X = np.c_[rng.integers(1, 10, (50, 3)).astype(float), np.ones(50)]
    y = np.where(rng.random(50) < 0.4, 1.0, -1.0)
    rule = NormalizedGD(step=0.05, iterations=50, reg=0.01, penalty="l2")
    w_gram = rule.apply(np.zeros(4), X.T @ X, X.T @ y, 50)
    w = np.zeros(4)
    for _ in range(50):   # the reference's row loop
        g = sum(x * (w @ x - t) for x, t in zip(X, y)) / 50 + 0.01 * w
        w = w - (g / np.linalg.norm(g)) * 0.05
    assert np.allclose(w_gram, w, atol=1e-9)


@pytest.mark.parametrize("unit", [1e-11, 1.0, 1e8])
def test_fold_does_not_depend_on_units(unit):
    rng = np.random.default_rng(2)
    X = np.c_[rng.normal(size=(50, 2)), np.ones(50)]
    y = np.where(rng.random(50) < 0.5, 1.0, -1.0)
    Z = np.c_[X * unit, y]
    iu = np.triu_indices(4)
    forward, backward = (sum(np.outer(z, z)[iu] for z in rows) for rows in (Z, Z[::-1]))
    G, c, _ = settled(forward, 4, 13)
    G2, c2, _ = settled(backward, 4, 13)
    assert (G == G2).all() and (c == c2).all()     # the order of a sum leaves no trace
    assert np.allclose(G, (X * unit).T @ (X * unit), rtol=1e-10, atol=1e-12 * unit * unit)
    rule = NormalizedGD(step=0.05, iterations=5, reg=0.0)
    w = rule.apply(np.zeros(3), G, c, 50.0)
    assert np.abs(w).max() > 0.01
    first = NormalizedGD(step=0.05, iterations=1, reg=0.0).apply(np.zeros(3), G, c, 50.0)
    unscaled = NormalizedGD(step=0.05, iterations=1, reg=0.0).apply(np.zeros(3), X.T @ X, X.T @ y, 50.0)
    assert np.allclose(first, unscaled, atol=1e-9)


def test_logistic_rule_decreases_loss():
    rng = np.random.default_rng(1)
    X = np.c_[rng.normal(size=(200, 2)), np.ones(200)]
    y = np.where(X[:, 0] + 0.5 * X[:, 1] > 0, 1.0, -1.0)
    w = LogisticGD(step=0.05, iterations=50, reg=0.0).apply_rows(np.zeros(3), X, y)
    assert np.mean(np.sign(X @ w) == y) > 0.9
