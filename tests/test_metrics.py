"""Score metrics, exact quantiles, prefix sums, WoE/IV and fairness goldens."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditspark.operators import metrics as mt
from creditspark.operators.audit import disparate_impact, segment_audit, split_report, stratified_split
from creditspark.operators.cumulative import prefix_sums
from creditspark.operators.quantiles import exact_quantiles
from creditspark.operators.woe import iv_ranking, woe_bins
from creditspark.sources.portfolio import derive_portfolio

from conftest import SF_CHECK

Y = [0, 0, 0, 0, 1, 1, 1, 1]


def _long(spark, y, p):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "default_flag double, s double")
    return mt.stack_scores(df, {"m": "s"}, "default_flag")


def test_ece_perfect(spark):
    long = _long(spark, Y, [0, 0, 0, 0, 1, 1, 1, 1])
    r = mt.calibration_errors(mt.calibration_bins(long, 5)).first()
    assert r["ece"] == 0.0 and r["mce"] == 0.0


def test_separable_gini_ks(spark):
    r = mt.rank_metrics(_long(spark, Y, [.1, .2, .3, .4, .6, .7, .8, .9])).first()
    assert r["gini"] == pytest.approx(1.0) and r["ks"] == pytest.approx(1.0)
    assert 0.4 <= r["ks_threshold"] <= 0.6


def test_constant_score(spark):
    r = mt.rank_metrics(_long(spark, Y, [.5] * 8)).first()
    assert r["gini"] == pytest.approx(0.0)
    assert r["ks_threshold"] == float("inf")


def test_auc_matches_pairwise_brute_force(spark):
    rng = random.Random(7)
    y = [rng.random() < 0.3 for _ in range(300)]
    p = [round(rng.random(), 2) for _ in range(300)]
    pos = [s for s, t in zip(p, y) if t]
    neg = [s for s, t in zip(p, y) if not t]
    brute = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    r = mt.rank_metrics(_long(spark, [int(t) for t in y], p)).first()
    assert r["auc"] == pytest.approx(brute, abs=1e-12)


def test_thinned_curve_keeps_bends_area_and_ks(spark):
    """Second differences over all points, by definition; area and largest difference stay."""
    rng = random.Random(8)
    y = [int(rng.random() < 0.4) for _ in range(600)]
    p = [round(rng.random(), 2) + (0.3 if t else 0) if i % 2 else i / 1000 for i, t in enumerate(y)]
    long = _long(spark, y, p)
    cuts = sorted(set(p), reverse=True)
    pos = [sum(t for t, q in zip(y, p) if q == c) for c in cuts]
    neg = [sum(1 - t for t, q in zip(y, p) if q == c) for c in cuts]
    kept = [i for i in range(len(cuts)) if i in (0, len(cuts) - 1) or (pos[i + 1], neg[i + 1]) != (pos[i], neg[i])]
    rows = sorted(mt.roc_curve_points(long).collect(), key=lambda r: -r["threshold"])
    assert [r["threshold"] for r in rows] == [float("inf")] + [cuts[i] for i in kept] and len(kept) < len(cuts)
    area = sum((b["fpr"] - a["fpr"]) * (a["tpr"] + b["tpr"]) / 2 for a, b in zip(rows, rows[1:]))
    whole = mt.rank_metrics(long).first()
    assert area == pytest.approx(whole["auc"], abs=1e-12)
    assert max(r["ks_diff"] for r in rows) == pytest.approx(whole["ks"], abs=1e-12)


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    vals = np.round(rng.normal(size=2000), 2)
    df = spark.createDataFrame([(float(v), "a" if i % 3 else "b") for i, v in enumerate(vals)], "v double, g string")
    fr = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    for n_ranges in (5, None):
        got = {(r["g"], r["fraction"]): r["quantile"]
               for r in exact_quantiles(df, "v", fr, ["g"], n_ranges=n_ranges).collect()}
        _check_groups(got, vals, fr)


def _check_groups(got, vals, fr):
    for g, sel in (("a", [i % 3 != 0 for i in range(2000)]), ("b", [i % 3 == 0 for i in range(2000)])):
        ref = np.quantile(vals[np.array(sel)], fr)
        for f, q in zip(fr, ref):
            assert got[(g, f)] == pytest.approx(q, abs=1e-12)


def test_exact_quantiles_nearest_rank(spark):
    # Brute force: sorted values at rank round((n-1) q), halves rounded away from zero.
    rng = random.Random(5)
    for n in (1, 2, 3, 4, 5, 9, 10, 401):
        vals = [float(rng.randint(0, 40)) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in vals], "v double")
        fr = [0.0, 0.125, 0.25, 0.5, 0.75, 1.0]
        s = sorted(vals)
        got = {r["fraction"]: r["quantile"] for r in exact_quantiles(
            df, "v", fr, n_ranges=3, method="nearest").collect()}
        for f in fr:
            assert got[f] == s[int(math.floor((n - 1) * f + 0.5))], (n, f)


def test_quantiles_of_a_bracketed_column_read_few_values(spark):
    """Only values inside brackets are kept by value; the brackets hold a few percent of the rows."""
    from creditspark.operators import quantiles as q

    rng = np.random.default_rng(9)
    vals = rng.lognormal(size=40_000)
    df = spark.createDataFrame([(float(v),) for v in vals], "v double").repartition(11)
    fr = [i / 10 for i in range(11)]
    sketch = q.rank_sketch(df, "v", len(fr))
    got = {r["fraction"]: r["quantile"] for r in exact_quantiles(df, "v", fr, sketch=sketch).collect()}
    assert [got[f] for f in fr] == pytest.approx(list(np.quantile(vals, fr)), abs=0)
    ranks = [q.target_ranks(len(vals), f, "linear")[:2] for f in fr]
    starts, stops = q._joined([sketch.bracket((), low, high) for low, high in ranks])
    inside = sum(sum(a <= v and (math.isnan(b) or v <= b) for a, b in zip(starts, stops)) for v in vals)
    assert inside < 0.06 * len(vals)


def test_quantiles_with_nan_and_hot_values(spark):
    vals = [1.0] * 700 + [2.0] * 5 + [float("nan")] * 3
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "v double").repartition(5)
    got = {r["fraction"]: r["quantile"] for r in exact_quantiles(df, "v", [0.0, 0.5, 0.99, 1.0], method="nearest").collect()}
    assert (got[0.0], got[0.5], got[0.99]) == (1.0, 1.0, 2.0) and math.isnan(got[1.0])
    assert exact_quantiles(df.limit(0), "v", [0.5]).collect() == []


def test_prefix_sums_match_cumsum(spark):
    rng = random.Random(1)
    rows = [(float(rng.randint(0, 50)), float(rng.randint(1, 5))) for _ in range(500)]
    df = spark.createDataFrame(rows, "k double, w double")
    out = prefix_sums(df, "k", ["w"], n_ranges=7).select("k", "w_cum").distinct().collect()
    for r in out:
        assert r["w_cum"] == sum(w for k, w in rows if k <= r["k"])
    desc = prefix_sums(df, "k", ["w"], n_ranges=4, descending=True).select("k", "w_cum").distinct().collect()
    for r in desc:
        assert r["w_cum"] == sum(w for k, w in rows if k >= r["k"])


@pytest.fixture(scope="module")
def check_portfolio(spark):
    return derive_portfolio(spark, SF_CHECK).cache()


def test_score_metric_goldens(spark, check_portfolio):
    long = mt.stack_scores(check_portfolio, {"pd": "pd"}, "default_flag")
    r = mt.rank_metrics(long).first()
    assert round(r["auc"], 6) == pytest.approx(0.786309)
    assert round(r["gini"], 6) == pytest.approx(0.572619)
    assert round(r["ks"], 4) == pytest.approx(0.4427)
    assert round(r["ks_threshold"], 4) == pytest.approx(0.0859)
    assert round(r["average_precision"], 6) == pytest.approx(0.356968)
    b = mt.metrics_bundle(long).first()
    assert b["brier_score"] == pytest.approx(0.073582)
    assert b["expected_calibration_error"] == pytest.approx(0.003068)
    assert b["maximum_calibration_error"] == pytest.approx(0.130985)


def test_iv_goldens(spark, check_portfolio):
    feats = ["interest_rate", "monthly_income", "historical_delinquencies", "loan_amount",
             "revolving_utilization", "debt_to_income"]
    got = {r["feature"]: (r["information_value"], r["n_bins"])
           for r in iv_ranking(woe_bins(check_portfolio, feats, "default_flag", 10)).collect()}
    expect = {"interest_rate": (1.0381, 10), "monthly_income": (0.7622, 10), "historical_delinquencies": (0.1700, 3),
              "loan_amount": (0.1193, 10), "revolving_utilization": (0.0501, 10), "debt_to_income": (0.0419, 10)}
    for k, (iv, nb) in expect.items():
        assert got[k][0] == pytest.approx(iv, abs=1e-4) and got[k][1] == nb


def test_fairness_goldens(spark, check_portfolio):
    seg = {r["group"]: r for r in segment_audit(check_portfolio, "pd", 0.18).collect()}
    assert seg["Bajo Ingreso"]["applications"] == 3541
    assert seg["Bajo Ingreso"]["approval_rate"] == pytest.approx(0.512567)
    assert seg["Medio/Alto Ingreso"]["applications"] == 11459
    assert seg["Medio/Alto Ingreso"]["approval_rate"] == pytest.approx(0.973820)
    di = disparate_impact(check_portfolio, "pd", 0.18).first()
    assert round(di["disparate_impact_ratio"], 4) == pytest.approx(0.5263)
    assert di["passes_four_fifths"] is False


def test_stratified_split_is_exact(spark, check_portfolio):
    rep = {r["split"]: r for r in split_report(stratified_split(check_portfolio)).collect()}
    n = check_portfolio.count()
    d = check_portfolio.agg(F.sum("default_flag")).first()[0]
    assert sum(r["applications"] for r in rep.values()) == n
    assert rep["train"]["defaults"] == int(d * 0.6)
    assert rep["train"]["applications"] == int(d * 0.6) + int((n - d) * 0.6)


def test_robust_stats_impute_nulls_with_median(spark):
    from creditspark.ml.preprocess import robust_stats

    rng = random.Random(11)
    a = [float(rng.randint(0, 30)) if rng.random() > 0.3 else None for _ in range(300)]
    b = [float(rng.randint(0, 9)) for _ in range(300)]
    df = spark.createDataFrame(list(zip(a, b)), "a double, b double")
    got = {r["feature"]: r for r in robust_stats(df, ["a", "b"]).collect()}
    for name, col in (("a", a), ("b", b)):
        present = np.array([v for v in col if v is not None])
        med = float(np.median(present))
        filled = np.array([med if v is None else v for v in col])
        q25, q75 = np.quantile(filled, [0.25, 0.75])
        r = got[name]
        assert r["median"] == pytest.approx(med, abs=1e-12)
        assert r["q25"] == pytest.approx(q25, abs=1e-12) and r["q75"] == pytest.approx(q75, abs=1e-12)
        assert r["scale"] == pytest.approx(q75 - q25 if q75 > q25 else 1.0, abs=1e-12)


def test_distinct_score_running_counts(spark):
    rng = random.Random(13)
    y = [int(rng.random() < 0.3) for _ in range(500)]
    p = [round(rng.random(), 2) for _ in range(500)]
    long = mt.stack_scores(spark.createDataFrame([(float(a), b, 1.0 - b) for a, b in zip(y, p)],
                                                 "default_flag double, s double, t double"),
                           {"m": "s", "n": "t"}, "default_flag")
    cols = ["score_name", "score", "pos", "neg", "pos_cum", "neg_cum"]
    dist = sorted(tuple(r) for r in mt.distinct_scores(long).select(*cols).collect())
    for name, scores in (("m", p), ("n", [1.0 - b for b in p])):
        for r in [t for t in dist if t[0] == name][::17]:
            assert r[4] == sum(a for a, s in zip(y, scores) if s >= r[1])


def test_comparison_text(spark):
    row = spark.createDataFrame([(0.2, 0.1, 0.05, 0.04, 0.3, 0.2, 50.0, 20.0, 0.01)],
                                "brier_before double, brier_after double, ece_before double, ece_after double, mce_before double, mce_after double, "
                                "brier_score_reduction_pct double, expected_calibration_error_reduction_pct double, auc_delta double")
    assert mt.comparison_text(row).first()["summary"].splitlines() == [
        "Brier score: 0.20000 to 0.10000 (-50.00 %)", "Expected calibration error: 0.05000 to 0.04000 (-20.00 %)",
        "Largest calibration error: 0.30000 to 0.20000", "ROC-AUC change: +0.0100"]


def test_column_quantiles_equal_exact_ones_in_shared_scans(spark):
    from creditspark.operators.quantiles import column_quantiles, exact_quantiles

    rng = np.random.default_rng(3)
    rows = [(float(rng.normal()), float(rng.integers(0, 4)), None if i % 3 else float("nan"), None,
             [float("-inf"), -0.0, 1.0, float("inf")][i % 4], None if i % 5 == 0 else i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f long").repartition(5)
    fr = [0.0, 0.25, 0.5, 0.75, 1.0]
    for cells in (None, 3):
        got = column_quantiles(df, df.columns, fr, cells)
        for c in df.columns:
            want = {r["fraction"]: r["quantile"] for r in exact_quantiles(df.select(F.col(c).cast("double").alias(c)), c, fr).collect()}
            assert got[c][0] == df.where(F.col(c).isNull()).count()
            assert {k: repr(v) for k, v in got[c][1].items()} == {k: repr(v) for k, v in want.items()}, c
    assert column_quantiles(df.limit(0), ["a", "d"], fr) == {"a": (0, {}), "d": (0, {})}
