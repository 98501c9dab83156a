"""Update rules: one window / micro-batch -> new weights.

These are the only sequential step of online training.  ``apply`` folds a window from its sums of products
(``O(d^2)`` numbers), ``apply_rows`` from its rows; ``operators.relay`` runs count windows through them on the
executors.  One generic trainer takes any rule (the extension point of the reference's model/algorithm pair).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

# Defaults of the reference's count-window jobs and streaming SGD.
V1_STEP = 0.1
V1_ITERATIONS = 50
V1_WINDOW = 50
RIDGE_REG = 0.01
LASSO_REG = 0.1
LASSO_EPSILON = 0.01
SGD_STEP = 0.1
SGD_ITERATIONS = 50
SGD_FRACTION = 1.0
SGD_LASSO_REG = 0.1

#: Up to so many dimensions a window is folded in plain floats.
NARROW = 6
#: Numbers of a block of rows that are held at a time, to expand a gradient at several weights.
EXPANDED = 1 << 20


@dataclass(frozen=True)
class NormalizedGD:
    """Count-window rule (M1 ridge, M2 lasso): T steps of fixed length along the
    normalised gradient ``g = mean(x (w.x - y)) + reg * penalty'(w)``.

    ``penalty``: ``"l2"`` (ridge, penalty' = w), ``"huber"`` (lasso, Huber-smoothed
    sign) or ``"none"``.  The bias weight is regularised too.  A zero gradient
    ends the window's iterations (the reference would produce NaN).
    """

    step: float = V1_STEP
    iterations: int = V1_ITERATIONS
    reg: float = RIDGE_REG
    penalty: str = "l2"
    epsilon: float = LASSO_EPSILON
    #: significant digits of the sums it is given (see ``gram.settled``)
    digits: int = 13

    def apply(self, w, G, c, n):
        """Fold one window of sums of products, as ``gram.settled`` gives them.

        Every dot product is the plain left-to-right sum of rounded products, computed for
        all rows at once (``acc += G[:, j] * w[j]`` for j in order), so the roundings do
        not depend on the vector length or the machine's libraries.
        """
        d = len(w)
        if d <= NARROW and n and (self.penalty != "huber" or self.epsilon):
            return self._apply_narrow(w, G, c, n)
        Gs = np.asarray(G, dtype=float).reshape(d, d)
        cs = np.asarray(c, dtype=float).reshape(d)
        cols = [np.ascontiguousarray(Gs[:, j]) for j in range(d)]
        n = float(n)
        eps, reg, step = self.epsilon, self.reg, self.step
        w = np.array(w, dtype=float)
        for _ in range(self.iterations):
            acc = np.zeros(d)
            for j in range(d):
                acc = acc + cols[j] * w[j]
            if self.penalty == "l2":
                pen = w
            elif self.penalty == "huber":
                pen = np.where(w > eps, 1.0, np.where(w < -eps, -1.0, w / eps))
            elif self.penalty == "none":
                pen = np.zeros(d)
            else:
                raise ValueError(f"unknown penalty {self.penalty!r}")
            g = (acc - cs) / n + reg * pen
            # scaled by its largest entry, so that tiny gradients do not underflow in the squares
            top = float(np.abs(g).max())
            if top == 0.0:
                break
            sq = 0.0
            for v in g:
                sq += float(v) * float(v)
            nrm = math.sqrt(sq)
            if nrm == 0.0:
                g = g / top
                nrm = math.sqrt(float(sum(float(v) * float(v) for v in g)))
            w = w - (g / nrm) * step
        return w

    def _apply_narrow(self, w, G, c, n):
        """:meth:`apply` in plain floats, the same operations in the same order: for a few dimensions, calls of
        array functions would take longer than the arithmetic, and windows fold one after another."""
        rows = np.asarray(G, dtype=float).reshape(len(w), len(w)).tolist()
        cs, w = np.asarray(c, dtype=float).reshape(len(w)).tolist(), [float(v) for v in w]
        n, eps, reg, step, penalty = float(n), self.epsilon, self.reg, self.step, self.penalty
        if penalty not in ("l2", "huber", "none"):
            raise ValueError(f"unknown penalty {penalty!r}")
        terms = list(zip(rows, cs))
        for _ in range(self.iterations):
            if penalty == "l2":
                pen = w
            elif penalty == "huber":
                pen = [1.0 if v > eps else -1.0 if v < -eps else v / eps for v in w]
            else:
                pen = [0.0] * len(w)
            g, sq = [], 0.0
            for (row, ci), pi in zip(terms, pen):
                acc = 0.0
                for a, b in zip(row, w):
                    acc += a * b
                v = (acc - ci) / n + reg * pi
                g.append(v)
                sq += v * v
            nrm = math.sqrt(sq)
            if nrm == 0.0:
                top = max(map(abs, g))
                if top == 0.0:
                    break
                g = [v / top for v in g]
                nrm = math.sqrt(sum(v * v for v in g))
            w = [a - (v / nrm) * step for a, v in zip(w, g)]
        return np.array(w)

    def apply_rows(self, w, X: np.ndarray, y: np.ndarray):
        """Fold one window from its rows (fewer rows than dimensions): no sums of products are formed.

        Without a penalty or with l2, the weights stay ``a * w + X' b``; an iteration moves the scalar
        ``a`` and the vector ``b`` by inner products of the rows with each other (rows x rows) and with ``w``.
        The Huber penalty leaves that space, so its gradient is taken from the rows.
        """
        w = np.array(w, dtype=float)
        n = float(len(y))
        if self.penalty == "huber":
            for _ in range(self.iterations):
                pen = np.where(w > self.epsilon, 1.0, np.where(w < -self.epsilon, -1.0, w / self.epsilon))
                g = X.T @ (X @ w - y) / n + self.reg * pen
                nrm = math.sqrt(float(g @ g))
                if nrm == 0.0:
                    break
                w = w - (g / nrm) * self.step
            return w
        reg = self.reg if self.penalty == "l2" else 0.0
        inner, along, own = X @ X.T, X @ w, float(w @ w)
        a, b = 1.0, np.zeros(len(y))
        for _ in range(self.iterations):
            # gradient = reg * a * w + X' beta
            shadow = inner @ b
            beta = (a * along + shadow - y) / n + reg * b
            square = (reg * a) ** 2 * own + 2.0 * reg * a * float(along @ beta) + float(beta @ (inner @ beta))
            if square <= 0.0:
                break
            length = self.step / math.sqrt(square)
            a, b = a - length * reg * a, b - length * beta
        return a * w + X.T @ b


@dataclass(frozen=True)
class SGD:
    """Streaming SGD rule (M4 linear, M5 lasso, M6 ridge) with MLlib's updaters.

    Iteration t (1-based) uses step ``step / sqrt(t)`` and the mean squared-loss
    gradient ``mean(x (w.x - y))`` of that iteration's mini-batch:
    ``none``: w -= s g;  ``l2``: w = w (1 - s reg) - s g;
    ``l1``: w = soft_threshold(w - s g, s reg).
    Exactly ``iterations`` steps (no convergence test); an empty mini-batch
    leaves the weights unchanged for that iteration.
    """

    step: float = SGD_STEP
    iterations: int = SGD_ITERATIONS
    fraction: float = SGD_FRACTION
    reg: float = 0.0
    updater: str = "none"

    def apply_iter(self, w, t: int, G, c, n):
        if n == 0:
            return w
        g = (G @ w - c) / n
        s = self.step / math.sqrt(t)
        if self.updater == "none":
            return w + (-s) * g
        if self.updater == "l2":
            return w * (1.0 - s * self.reg) + (-s) * g
        if self.updater == "l1":
            v = w + (-s) * g
            return np.sign(v) * np.maximum(0.0, np.abs(v) - self.reg * s)
        raise ValueError(f"unknown updater {self.updater!r}")

    def apply(self, w, G, c, n):
        w = np.array(w, dtype=float)
        for t in range(1, self.iterations + 1):
            w = self.apply_iter(w, t, G, c, n)
        return w


def ridge_rule(**kw) -> NormalizedGD:
    return NormalizedGD(**{"reg": RIDGE_REG, "penalty": "l2", **kw})


def lasso_rule(**kw) -> NormalizedGD:
    return NormalizedGD(**{"reg": LASSO_REG, "penalty": "huber", "epsilon": LASSO_EPSILON, **kw})


@dataclass(frozen=True)
class LogisticGD:
    """Count-window logistic rule (M3): as :class:`NormalizedGD` but with the
    logistic gradient ``mean(x y (sigmoid(y w.x) - 1)) + reg * w`` (labels +-1).

    The gradient is not quadratic, so it needs the window's rows, not a Gram.
    """

    step: float = V1_STEP
    iterations: int = V1_ITERATIONS
    reg: float = 0.1

    def step_along(self, w, mean_gradient: np.ndarray) -> tuple[np.ndarray, bool]:
        """One step from the mean data gradient; False when the gradient is zero."""
        g = mean_gradient + self.reg * w
        nrm = math.sqrt(float(g.dot(g)))
        return (w, False) if nrm == 0.0 else (w - (g / nrm) * self.step, True)

    def expand(self, at: np.ndarray, X: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(longest row, data gradients, their derivatives) summed over rows, at each of several weights."""
        d = X.shape[1]
        upper, lower = np.triu_indices(d)
        longest, gradient, slope = 0.0, np.zeros((len(at), d)), np.zeros((len(at), len(upper)))
        few = max(1, EXPANDED // max(len(at), len(upper)))
        with np.errstate(over="ignore", invalid="ignore"):
            for i in range(0, len(y), few):
                own = X[i:i + few] * y[i:i + few, None]
                longest = max(longest, math.sqrt(np.square(own).sum(axis=1).max()))
                scale = 1.0 / (1.0 + np.exp(-(at @ own.T))) - 1.0
                gradient += scale @ own
                slope += (-scale * (1.0 + scale)) @ (own[:, upper] * own[:, lower])
        full = np.empty((len(at), d, d))
        full[:, upper, lower] = full[:, lower, upper] = slope
        return longest, gradient, full

    def settles(self, longest: float, moved: np.ndarray) -> bool:
        """Whether a gradient and its derivative, ``moved`` away, give the gradient here to rounding: what they leave out is
        at most 0.05 |x| (|x| |moved|)^2 a row, below 1e-17 of |x|."""
        return bool(longest * math.sqrt(float(moved.dot(moved))) <= 1e-8)

    def apply_rows(self, w, X: np.ndarray, y: np.ndarray):
        w = np.array(w, dtype=float)
        n = float(len(y))
        # labels go into the rows once; every iteration then fills one array
        own = X * y[:, None]
        against, along, scale = -own, own.T, np.empty(len(y))
        for _ in range(self.iterations):
            np.dot(against, w, out=scale)
            np.exp(scale, out=scale)
            scale += 1.0
            np.reciprocal(scale, out=scale)
            scale -= 1.0
            w, moved = self.step_along(w, along.dot(scale) / n)
            if not moved:
                break
        return w
