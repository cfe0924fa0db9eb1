import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.operators.models import fit_linear, fit_trees
from chronoweave.operators.least_squares import fit_folds, store_for_fits
from chronoweave.plans.experiment import run_folds, run_grid, run_sweep, with_folds
from chronoweave.roles import Roles

ROLES = Roles(
    key="rn", id="stay_id", target="glc_next", time_vars=("t0", "t1"), target_mask="msk", timevarying=("glc",),
    static=("age",), counts=("n",),
)


@pytest.fixture(scope="module")
def cohort(spark):
    rng = random.Random(4)
    rows, rn = [], 0
    for stay in range(12):
        glc = 140.0
        for n in range(25):
            nxt = max(60.0, glc + rng.gauss(0, 15))
            rows.append((rn, stay, float(n), n + 1.0, glc if rng.random() > 0.1 else None, 40.0 + stay, n + 1, nxt,
                         float(n % 9 == 8)))
            glc, rn = nxt, rn + 1
    return spark.createDataFrame(
        rows, "rn long, stay_id long, t0 double, t1 double, glc double, age double, n int, glc_next double, msk double")


def test_linear_matches_least_squares(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    x[5, 0] = np.nan
    filled = np.nan_to_num(x)
    y = 1 + filled @ [2.0, -1.0] + rng.normal(size=200) * (1 + np.abs(filled[:, 0]))
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))],
                               "i long, a double, b double, target double")
    out = fit_linear(df, ["a", "b"]).predict(df).orderBy("i").toPandas()
    design = np.c_[np.ones(200), filled]
    mu = design @ np.linalg.lstsq(design, y, rcond=None)[0]
    var = design @ np.linalg.lstsq(design, (y - mu) ** 2 + 1e-2, rcond=None)[0]
    assert np.allclose(out.mu, mu)
    known = var >= 0
    assert np.allclose(out.sigma[known], np.sqrt(var[known])) and out.sigma[~known].isna().all()
    point = fit_linear(df, ["a", "b"], task="conditional_expectation").predict(df)
    assert "sigma" not in point.columns and point.count() == 200


def test_trees_learn_and_give_deviation(spark):
    df = spark.range(300).select(
        (F.col("id") % 10).cast("double").alias("x"), F.when(F.col("id") % 10 < 5, 0.0).otherwise(4.0).alias("target"),
        (F.col("id") % 7 == 0).alias("held"),
    )
    out = fit_trees(df, ["x"], validation="held", rounds=20).predict(df)
    error = out.agg(F.avg(F.pow(F.col("mu") - F.col("target"), 2))).first()[0]
    assert error < 0.5 and out.filter("sigma is null").count() <= 300


def test_sigma_of_trees_holds_on_rows_they_have_not_seen(spark):
    """Noise of deviation 0.2 or 1 by a second input; half the rows are kept from the fit altogether."""
    rng = np.random.default_rng(7)
    n = 6000
    x, loud = rng.integers(0, 12, n).astype(float), rng.integers(0, 2, n).astype(float)
    y = 0.7 * x + 2 * loud + rng.normal(size=n) * np.where(loud > 0, 1.0, 0.2)
    rows = [(i, *map(float, v)) for i, v in enumerate(zip(x, loud, y))]
    df = spark.createDataFrame(rows, "i long, x double, loud double, target double").withColumn("held", F.col("i") % 10 == 1)
    fitted = fit_trees(df.filter("i % 2 = 1"), ["x", "loud"], validation="held")
    assert 2 < fitted.mean.getNumTrees < 500  # ended by the held rows, far below the allowed 10,000 rounds
    out = fitted.predict(df.filter("i % 2 = 0")).toPandas()
    z = (out.target - out.mu) / out.sigma
    assert 0.9 < float((z**2).mean()) < 1.1
    for side in (0.0, 1.0):
        part = out[out.loud == side]
        assert 0.4 < float((((part.target - part.mu) / part.sigma) ** 2).mean()) < 1.6
    assert out[out.loud == 1].sigma.mean() > 1.5 * out[out.loud == 0].sigma.mean()


def test_folds_cover_every_scored_row_once(cohort, tmp_path):
    predictions, scores = run_folds(
        cohort, ROLES, k=3, predictions_path=str(tmp_path / "p"), metrics_path=str(tmp_path / "m"))
    assert sorted(r.rn for r in predictions.collect()) == sorted(r.rn for r in cohort.filter("msk = 0").collect())
    assert {(r.model, r.fold) for r in scores.collect()} == {("LinearModel", f) for f in range(3)}
    spark = cohort.sparkSession
    assert spark.read.parquet(str(tmp_path / "p")).count() == predictions.count()
    assert spark.read.parquet(str(tmp_path / "m")).count() == 3


def test_tree_folds_and_point_task(cohort):
    predictions, scores = run_folds(cohort, ROLES, "BoostedTrees", 2, "conditional_expectation", rounds=2)
    assert scores.columns == ["model", "fold", "rmse"] and scores.count() == 2
    assert {r.model for r in predictions.select("model").distinct().collect()} == {"BoostedTrees"}


def test_grid_over_one_split(cohort):
    out = run_grid(cohort, ROLES, [{"seed": 1}, {"seed": 2}], "seed", k=1, task="conditional_expectation").collect()
    assert {(r.param, r.value, r.fold) for r in out} == {("seed", 1.0, 0), ("seed", 2.0, 0)}


def test_sweep_of_models_parameters_and_values(cohort):
    sweeps = {
        "LinearModel": {"roles": ["all", ["glc"]], "task": ["gaussian", "conditional_expectation"]},
        "BoostedTrees": {"rate": [0.1, 0.3], "depth": [1]},
    }
    linear = run_sweep(cohort, ROLES, {"LinearModel": sweeps["LinearModel"]}, k=2).collect()
    trees = run_sweep(cohort, ROLES, {"BoostedTrees": sweeps["BoostedTrees"]}, k=2, rounds=2).collect()
    assert {(r.model, r.param, r.value, r.number) for r in linear + trees} == {
        ("LinearModel", "roles", "all", None), ("LinearModel", "roles", "glc", None), ("LinearModel", "task", "gaussian", None),
        ("LinearModel", "task", "conditional_expectation", None), ("BoostedTrees", "rate", "0.1", 0.1),
        ("BoostedTrees", "rate", "0.3", 0.3), ("BoostedTrees", "depth", "1", 1.0),
    }
    assert len(linear) == 8 and len(trees) == 6 and all(r.rmse > 0 for r in linear + trees)


def test_folds_together_equal_folds_alone(cohort):
    """Every fold's weights are those of a plain fit on the other folds' rows, mean and variance."""
    predictions, _ = run_folds(cohort, ROLES, k=3)
    rows = {r.rn: r for r in with_folds(cohort.filter("msk = 0"), ROLES, 3).collect()}
    inputs = ROLES.model_inputs
    design = {i: np.array([1.0] + [float(r[c] or 0.0) for c in inputs]) for i, r in rows.items()}
    y = {i: np.log(r.glc_next / 140) for i, r in rows.items()}
    for p in predictions.collect():
        assert abs(p.target - y[p.rn]) < 1e-12
    for fold in range(3):
        train = [i for i, r in rows.items() if r.fold != fold]
        a, b = np.array([design[i] for i in train]), np.array([y[i] for i in train])
        w = np.linalg.lstsq(a, b, rcond=None)[0]
        v = np.linalg.lstsq(a, (b - a @ w) ** 2 + 1e-2, rcond=None)[0]
        for p in predictions.filter(F.col("fold") == fold).collect():
            assert abs(p.mu - design[p.rn] @ w) < 1e-8
            var = design[p.rn] @ v
            assert p.sigma is None and var < 0 or abs(p.sigma - np.sqrt(var)) < 1e-8


def test_linear_folds_with_nothing_to_learn_from(spark):
    rows = [(1, 0, 1.0, 2.0), (2, 0, 1.0, None), (3, 0, 1.0, 2.0)]
    stored, seen = store_for_fits(spark.createDataFrame(rows, "i long, fold int, same double, target double"), ["same"])
    out = {r.i: (r.mu, r.sigma) for r in fit_folds(stored, seen, ["same"], [0, 1]).predict(stored.withColumn("fold", F.lit(1))).collect()}
    assert out[1][0] == pytest.approx(2.0) and out[1][1] == pytest.approx(0.1)
    assert {(r.mu, r.sigma) for r in fit_folds(stored, seen, ["same"], [0, 1]).predict(stored).collect()} == {(None, None)}
