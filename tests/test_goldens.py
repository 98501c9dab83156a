"""Count-window ridge / lasso / logistic over labelled-points files against an independent computation.

The files are written by the test from a rule; the expected weights and error traces come from plain
row loops over the same files, which share no code with the library.
"""

import math

import numpy as np
import pytest

from kestrel.operators.glm import train_count_windows
from kestrel.operators.logistic import train_logistic_windows
from kestrel.operators.metrics import error_trace
from kestrel.operators.rules import LogisticGD, NormalizedGD
from kestrel.sources.text import read_points_csv

D, WINDOW, STEP, ITERATIONS = 9, 50, 0.05, 50


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """559 training and 140 hold-out lines ``label,f1..f9`` of small whole numbers."""
    folder = tmp_path_factory.mktemp("points")
    rng = np.random.default_rng(7)
    out = {}
    for name, n in (("train", 559), ("test", 140)):
        label = (rng.random(n) < 0.36).astype(int)
        x = np.clip(np.round(rng.gamma(1.5, 1.6, (n, D)) + 3.2 * label[:, None] * rng.random((n, D)) * 2), 1, 10)
        lines = [",".join([str(v)] + [str(int(f)) for f in row]) for v, row in zip(label, x, strict=True)]
        (folder / name).write_text("\n".join(lines) + "\n")
        out[name] = (str(folder / name), [([*map(float, row), 1.0], 1.0 if v else -1.0)
                                          for v, row in zip(label, x, strict=True)])
    return out


def expected(rows, kind):
    """Weights after each window, by loops over rows."""
    w, out = [0.0] * (D + 1), []
    for k in range(len(rows) // WINDOW):
        window = rows[k * WINDOW:(k + 1) * WINDOW]
        for _ in range(ITERATIONS):
            g = [0.0] * (D + 1)
            for x, y in window:
                s = math.fsum(a * b for a, b in zip(x, w, strict=True))
                e = y * (1 / (1 + math.exp(-y * s)) - 1) if kind == "logistic" else s - y
                for i in range(D + 1):
                    g[i] += x[i] * e
            reg = {"ridge": 0.01, "lasso": 0.1, "logistic": 0.1}[kind]
            pen = [max(-1.0, min(1.0, v / 0.01)) for v in w] if kind == "lasso" else w
            g = [a / WINDOW + reg * b for a, b in zip(g, pen, strict=True)]
            length = math.sqrt(math.fsum(a * a for a in g))
            w = [a - STEP * b / length for a, b in zip(w, g, strict=True)]
        out.append(list(w))
    return out


@pytest.mark.parametrize("kind", ["ridge", "lasso", "logistic"])
def test_weights_and_error_trace(spark, files, kind):
    path, rows = files["train"]
    train = read_points_csv(spark, path, D)
    if kind == "logistic":
        store = train_logistic_windows(train, D + 1, WINDOW, LogisticGD(step=STEP, iterations=ITERATIONS, reg=0.1))
    else:
        rule = NormalizedGD(step=STEP, iterations=ITERATIONS, reg=0.01 if kind == "ridge" else 0.1,
                            penalty="l2" if kind == "ridge" else "huber", epsilon=0.01)
        store = train_count_windows(train, rule, D + 1, WINDOW)
    versions = store.versions().filter("version >= 0")
    got = [r["weights"] for r in versions.orderBy("version").collect()]
    want = expected(rows, kind)
    assert len(got) == 11
    # rounding noise grows along the fixed-length steps: the first windows agree closely
    assert np.allclose(got[0], want[0], atol=1e-6)
    test_path, test_rows = files["test"]
    trace = {r["version"]: r["n_err"] for r in error_trace(
        read_points_csv(spark, test_path, D), versions.select("version", "weights")).collect()}
    for k, w in enumerate(got):
        assert trace[k] == sum((1.0 if sum(a * b for a, b in zip(x, w, strict=True)) > 0 else -1.0) != y for x, y in test_rows)
    assert store.latest().first()["n_seen"] == 550
    assert min(trace.values()) < 30


def test_open_window_is_never_flushed(spark, files):
    train = read_points_csv(spark, files["train"][0], D)
    assert train.count() == 559
    assert train.filter("seq >= 550").count() == 9
