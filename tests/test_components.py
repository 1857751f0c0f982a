"""Independent components: sources come back up to sign and order, whatever the partitioning."""

import numpy as np
import pytest

from tidemark.operators import components


def mixed(seed=1, n=3000):
    rng = np.random.default_rng(seed)
    s = np.stack([rng.uniform(-1, 1, n), rng.laplace(size=n), np.sign(np.sin(np.arange(n) / 7)) + 0.05 * rng.normal(size=n)], axis=1)
    a = rng.normal(size=(5, 3)) * [4, 2, 1]
    return s, a, s @ a.T + 10


@pytest.mark.parametrize("contrast", ["tanh", "cube"])
def test_sources_come_back(spark, contrast):
    s, a, x = mixed()
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(-1, None)], "id long, x array<double>")
    told = []
    for parts in (1, 5):
        found = components.independent_components(df.repartition(parts), "x", 5, contrast)  # the mixture has three axes
        assert found.settled and found.unmixing.shape == (3, 5)
        told.append(found)
    assert np.allclose(told[0].unmixing, told[1].unmixing, atol=1e-4)
    got = {r.id: r.sources for r in components.source_values(df, "x", told[0]).collect()}
    assert got.pop(-1) is None
    y = np.array([got[k] for k in range(len(x))])
    assert np.allclose(np.cov(y.T), np.eye(3), atol=1e-8) and np.allclose(y @ told[0].mixing.T + told[0].mean, x, atol=1e-8)
    c = np.abs(np.corrcoef(y.T, s.T)[:3, 3:])
    assert sorted(c.argmax(1)) == [0, 1, 2] and (c.max(1) > 0.98).all()
    norms = np.linalg.norm(told[0].mixing, axis=0)
    assert (np.diff(norms) <= 0).all() and (told[0].mixing[np.abs(told[0].mixing).argmax(0), range(3)] > 0).all()


def test_rounds_are_those_of_the_whole_matrix(spark):
    """A few rounds by numpy from the same start."""
    _, _, x = mixed(4, 400)
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").repartition(4)
    found = components.independent_components(df, "x", 2, most=3, seed=5)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    whiten = (vectors[:, [-1, -2]] / np.sqrt(values[[-1, -2]])).T
    z = (x - x.mean(0)) @ whiten.T
    w = components._orthogonal(np.random.default_rng(5).normal(size=(2, 2)))
    for _ in range(3):
        u = z @ w.T
        w = components._orthogonal(np.tanh(u).T @ z / len(z) - (1 - np.tanh(u) ** 2).mean(0)[:, None] * w)
    want = w @ whiten
    assert found.rounds == 3 and not found.settled
    assert all(min(np.abs(row - v).max() for v in (*want, *-want)) < 1e-8 for row in found.unmixing)


def test_few_rows(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "x array<double>")
    assert components.independent_components(df, "x", 2).unmixing.shape == (0, 2)
    assert components.independent_components(df.where("false"), "x", 2).settled
