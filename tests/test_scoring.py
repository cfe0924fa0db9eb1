import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from chronoweave.functions.gaussian import normal_cdf, normal_quantile
from chronoweave.functions.links import exp_link, guarded_log_link, log_link
from chronoweave.operators import scoring, summaries


def phi(z):
    return 0.5 * math.erfc(-z / math.sqrt(2))


def test_normal_cdf_against_erf(spark):
    zs = [x / 37 for x in range(-1500, 1501)] + [0.0, 7.07, 7.0711, -7.0711, 38.0, -38.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    for r in df.select("z", normal_cdf(F.col("z")).alias("p")).collect():
        assert r.p == pytest.approx(phi(r.z), rel=1e-9, abs=2e-16)
    assert df.limit(1).select(normal_cdf(F.lit(None).cast("double"))).first()[0] is None


def test_links(spark):
    r = spark.createDataFrame([(140.0, 0.0, -2.0)], "a double, b double, c double").select(
        log_link(F.col("a")), log_link(F.col("b")), guarded_log_link(F.col("b")), guarded_log_link(F.col("c")),
        exp_link(log_link(F.col("a"))),
    ).first()
    assert r[0] == pytest.approx(0) and r[1] is None and (r[2], r[3]) == (0.0, -2.0) and r[4] == pytest.approx(140)


def by_hand(rows, alpha=0.05):
    q = normal_quantile(1 - alpha / 2)
    crps, ig, ints, pit, cover, width, sq = [], [], [], [], [], [], []
    for m, s, y in rows:
        z = (y - m) / s
        pdf = math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        crps.append(s * (z * (2 * phi(z) - 1) + 2 * pdf - 1 / math.sqrt(math.pi)))
        ig.append(math.log(pdf / s))
        low, high, at = (140 * math.exp(x) for x in (m - q * s, m + q * s, y))
        ints.append(high - low + 2 / alpha * max(low - at, 0) + 2 / alpha * max(at - high, 0))
        pit.append(phi(z))
        cover.append(low < at < high)
        width.append(high - low)
        sq.append((140 * math.exp(m) - at) ** 2)
    mean = statistics.fmean
    return {
        "crps_mean": mean(crps), "ig_mean": mean(ig), "int_score_mean": mean(ints), "var_pit": statistics.pvariance(pit),
        "int_coverage": mean(cover), "int_av_width": mean(width), "int_med_width": statistics.median(width),
        "rmse": math.sqrt(mean(sq)),
    }


@pytest.mark.parametrize("limit", [None, 30])
def test_scores_match_hand_computation(spark, limit):
    rng = random.Random(1)
    rows = [(g, rng.gauss(0, 0.4), 0.05 + rng.random() / 2, rng.gauss(0, 0.5)) for g in ["a"] * 90 + ["b"] * 25]
    df = spark.createDataFrame(rows, "model string, mu double, sigma double, target double")
    out = {r.model: r.asDict() for r in scoring.score(df, ["model"], exp_link, rows=limit).collect()}
    for g in "ab":
        for name, value in by_hand([r[1:] for r in rows if r[0] == g]).items():
            assert out[g][name] == pytest.approx(value, rel=1e-9), name
    whole = scoring.score(df, [], exp_link, rows=limit).first().asDict()
    assert whole["int_med_width"] == pytest.approx(by_hand([r[1:] for r in rows])["int_med_width"])
    points = {r.model: r.rmse for r in scoring.score_points(df, ["model"], exp_link).collect()}
    assert points["a"] == pytest.approx(out["a"]["rmse"])


def test_prepare_caps_and_drops(spark):
    nan = float("nan")
    predictions = spark.createDataFrame(
        [(1, 0.0, 5.0, "m", 0), (2, 0.0, nan, "m", 0), (3, nan, 1.0, "m", 0), (4, 0.0, 0.5, "m", 0), (5, 0.0, 0.5, "m", 0),
         (6, 0.0, 0.5, "m", 0)], "rn long, mu double, sigma double, model string, fold int")
    rows = spark.createDataFrame([(1, 140.0, 0.0), (2, 140.0, 0.0), (3, 140.0, 0.0), (4, None, 0.0), (5, 140.0, 1.0)],
                                 "rn long, glc_next double, msk double")
    out = scoring.prepare_forecasts(predictions, rows).collect()
    assert [(r.mu, r.sigma, r.target) for r in out] == [(0.0, 2.0, pytest.approx(0.0))]


def test_losses(spark):
    df = spark.createDataFrame([(0.1, 0.5, 0.2), (0.0, 1.0, -1.0)], "mu double, sigma double, target double")
    r = scoring.score_losses(df, [], error=0.1).first()

    def lp(y, m, s):
        return -0.5 * math.log(2 * math.pi) - math.log(s) - ((y - m) / s) ** 2 / 2

    rows = [(0.1, 0.5, 0.2), (0.0, 1.0, -1.0)]
    own = lp(0, 0, 0.1)
    assert r.nll == pytest.approx(-sum(lp(y, m, s) for m, s, y in rows)) and r.nll_mean == pytest.approx(r.nll / 2)
    assert r.update_divergence == pytest.approx(sum(math.exp(own) * (own - lp(y, m, s)) for m, s, y in rows))
    assert r.sse == pytest.approx(sum((140 * math.exp(m) - 140 * math.exp(y)) ** 2 for m, s, y in rows))
    assert r.sse_link == pytest.approx(0.01 + 1.0) and r.n == 2


def test_summary_long_and_names(spark):
    df = spark.createDataFrame([("GRUModel", 0, 1.0, 2.0), ("GRUModel", 1, 3.0, 2.0)], "model string, fold int, rmse double, crps_mean double")
    s = summaries.summarise(df, ["model"], ["rmse"]).first()
    assert s.rmse_mean == 2.0 and s.rmse_std == pytest.approx(math.sqrt(2))
    long = summaries.display_names(summaries.melt_metrics(df, ["model"], ["rmse", "crps_mean"]))
    assert long.count() == 4 and {r.model_name for r in long.collect()} == {"TimeGap-GRU"}
    with pytest.raises(Exception, match="unknown code: Nope"):
        summaries.display_names(spark.createDataFrame([("Nope",)], "model string")).collect()


def test_last_prefix_and_empty(spark):
    df = spark.createDataFrame([("a", 1, 0.5, None), ("a", 3, 0.1, None), ("b", 2, None, None)],
                               "run string, step int, val_loss double, epoch int")
    last = {r.run: r.val_loss for r in summaries.last_metric(df, ["run"]).collect()}
    assert last == {"a": 0.1, "b": None}
    assert summaries.select_prefixes(df, "val", "epoch").columns == ["val_loss", "epoch"]
    assert summaries.drop_empty(df, ["val_loss", "epoch"]).count() == 2
    assert summaries.drop_empty(df, ["val_loss", "epoch"], "any").count() == 0
    assert [r.N1 for r in summaries.rescale(spark.createDataFrame([(5000,)], "N int"), N1=F.col("N") / 1000).collect()] == [5.0]
