"""Mahalanobis' distance against its definition."""

import numpy as np
import pytest

from pairwright.operators import standardize
from pairwright.plans.coordinate import coordinate


def tables(spark, g, d, missing=0.0):
    turn = g.normal(size=(d, d))
    a, b = g.normal(size=(30, d)) @ turn * 5 + 3, g.normal(size=(40, d)) @ turn * 5 + 3
    for x in (a, b):
        x[g.random(x.shape) < missing] = np.nan
    kinds = ", ".join(f"x{k} double" for k in range(d))
    frames = [spark.createDataFrame([(i, *(None if np.isnan(v) else float(v) for v in r)) for i, r in enumerate(x)], f"id long, {kinds}") for x in (a, b)]
    return a, b, frames


@pytest.mark.parametrize("d", [1, 3, 7])
def test_complete_rows_have_the_distance_of_the_definition(spark, d):
    a, b, frames = tables(spark, np.random.default_rng(d), d)
    found = {r["target_idx"]: r for r in coordinate(*frames, [(f"x{k}", f"x{k}", f"x{k}") for k in range(d)], "id", "id", metric="mahalanobis").per_target.collect()}
    inverse = np.linalg.inv(np.atleast_2d(np.cov(np.vstack([a, b]).T, bias=True)))
    for i, x in enumerate(a):
        gaps = b - x
        want = np.sqrt(np.einsum("ij,jk,ik->i", gaps, inverse, gaps))
        assert found[i]["match_idx"] == want.argmin() and found[i]["best_distance"] == pytest.approx(want.min(), rel=1e-8)
        assert sum(found[i]["contributions"]) == pytest.approx(1)


def test_rows_with_missing_cells_are_turned_by_what_they_have(spark):
    d = 4
    a, b, frames = tables(spark, np.random.default_rng(9), d, 0.3)
    x = coordinate(*frames, [(f"x{k}", f"x{k}", f"x{k}") for k in range(d)], "id", "id", metric="mahalanobis")
    both = np.vstack([a, b])
    z = (both - np.nanmean(both, axis=0)) / np.nanstd(both, axis=0)
    products = z[:, :, None] * z[:, None, :]
    covariance = standardize.positive_definite(np.nanmean(products, axis=0))
    turned = np.full(z.shape, np.nan)
    for i, row in enumerate(z):
        at = np.flatnonzero(~np.isnan(row))
        if len(at):
            turned[i, at] = np.linalg.solve(np.linalg.cholesky(covariance[np.ix_(at, at)]), row[at])
    found = {r["target_idx"]: r for r in x.matches.collect()}
    for i in range(len(a)):
        terms = (turned[i] - turned[len(a) :]) ** 2
        want = np.sqrt(np.where(np.isnan(terms), 2.0, terms).sum(axis=1))
        want[np.isnan(terms).all(axis=1)] = np.inf
        if np.isinf(want).all():
            assert found[i]["no_match"]
        else:
            assert found[i]["match_idx"] == want.argmin() and found[i]["best_distance"] == pytest.approx(want.min(), rel=1e-8)


def test_improper_covariances_are_repaired():
    bad = np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1.0]])
    c = standardize.positive_definite(bad.copy())
    assert np.linalg.eigvalsh(c)[0] > 0 and np.allclose(np.diag(c), 1)
    good = np.array([[1, 0.5], [0.5, 1]])
    assert (standardize.positive_definite(good.copy()) == good).all()
    assert (standardize.positive_definite(np.array([[1.0, 0.3], [0.3, 0.0]])) == np.eye(2)).all()
    with np.errstate(all="raise"):
        assert np.isfinite(standardize.Whitener(standardize.positive_definite(np.ones((3, 3))))(np.ones((2, 3)))).all()


def test_equal_rows_tie_and_the_metric_is_checked(spark):
    g = np.random.default_rng(1)
    a, b, frames = tables(spark, g, 3)
    twice = frames[1].unionByName(frames[1].selectExpr("id + 40 as id", "x0", "x1", "x2"))
    features = [(f"x{k}", f"x{k}", f"x{k}") for k in range(3)]
    assert all(r["repeats"] == 2 and r["match_idx"] < 40 for r in coordinate(frames[0], twice, features, "id", "id", metric="mahalanobis").matches.collect())
    with pytest.raises(ValueError, match="metric"):
        coordinate(*frames, features, "id", "id", metric="cosine")
