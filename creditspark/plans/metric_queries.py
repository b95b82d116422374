"""Score-metric queries (M11-M21, M26) on the scorecard PD and comparison scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditspark.functions.scorecard import FUNNEL_SCORECARD, scorecard_pd
from creditspark.ml.isotonic import isotonic_blocks
from creditspark.operators import metrics as mt
from creditspark.plans.policy_queries import portfolio
from creditspark.plans.registry import register
from creditspark.plans.sql_base import PORTFOLIO_CTE

FUNNEL_SQL = ("ROUND(1e0/(1e0+EXP(-(-28e-1+18e-1*debt_to_income+15e-1*revolving_utilization+55e-2*historical_delinquencies"
              "-5e-1*LN(monthly_income/1e3)+12e-2*(loan_amount/monthly_income)))),5)")
# score name -> (Spark column builder, SQL expression)
SCORES = {
    "scorecard": ("pd", "pd"),
    "funnel_scorecard": (None, FUNNEL_SQL),
    "dti_rule": ("debt_to_income", "debt_to_income"),
}


def _funnel():
    return scorecard_pd(F.col("monthly_income"), F.col("debt_to_income"), F.col("revolving_utilization"),
                        F.col("historical_delinquencies"), F.col("loan_amount"), FUNNEL_SCORECARD)


def long_scores(spark, sf_dir, names):
    cols = {n: (_funnel() if SCORES[n][0] is None else SCORES[n][0]) for n in names}
    return mt.stack_scores(portfolio(spark, sf_dir), cols, "default_flag")


def _long_sql(names) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS score_name, CAST({SCORES[n][1]} AS DOUBLE) AS score, CAST(default_flag AS DOUBLE) AS label FROM portfolio"
        for n in names)


def _rank_sql(names) -> str:
    return f"""WITH {PORTFOLIO_CTE},
lg AS ({_long_sql(names)}),
d AS (SELECT score_name, score, CAST(SUM(label) AS BIGINT) AS pos, CAST(COUNT(*) - SUM(label) AS BIGINT) AS neg FROM lg GROUP BY 1, 2),
cu AS (SELECT *, SUM(pos) OVER (PARTITION BY score_name ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS pos_cum,
          SUM(neg) OVER (PARTITION BY score_name ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS neg_cum,
          SUM(pos) OVER (PARTITION BY score_name) AS P, SUM(neg) OVER (PARTITION BY score_name) AS N FROM d),
k AS (SELECT *, pos_cum / CAST(P AS DOUBLE) - neg_cum / CAST(N AS DOUBLE) AS ksd FROM cu),
rm AS (SELECT score_name,
         CAST(SUM(CAST(neg AS HUGEINT) * (2 * (pos_cum - pos) + pos)) AS DOUBLE) / (2e0 * CAST(ANY_VALUE(P) AS DOUBLE) * CAST(ANY_VALUE(N) AS DOUBLE)) AS auc,
         MAX(ksd) AS ks_max, FIRST(score ORDER BY ksd DESC, score DESC) AS ks_at,
         SUM(pos / CAST(P AS DOUBLE) * (pos_cum / CAST(pos_cum + neg_cum AS DOUBLE))) AS ap
       FROM k GROUP BY score_name)"""


# ------------------------------------------------------------------------------ M9

ISOTONIC_SCORE = "FLOOR(pd * 1e3) / 1e3"


@register("isotonic_calibration", oracle=f"""WITH {PORTFOLIO_CTE},
d AS (SELECT {ISOTONIC_SCORE} AS x, COUNT(*) AS w, SUM(default_flag) AS s FROM portfolio GROUP BY 1),
n AS (SELECT x, w, s, ROW_NUMBER() OVER (ORDER BY x) AS i, SUM(w) OVER (ORDER BY x) AS cw, SUM(s) OVER (ORDER BY x) AS cs FROM d),
m AS (SELECT a.i AS a, b.i AS b, CAST(b.cs - a.cs + a.s AS DOUBLE) / CAST(b.cw - a.cw + a.w AS DOUBLE) AS mean FROM n a JOIN n b ON a.i <= b.i),
l AS (SELECT a, b, MIN(mean) OVER (PARTITION BY a ORDER BY b DESC) AS least FROM m),
f AS (SELECT b AS i, MAX(least) AS v FROM l GROUP BY b)
SELECT MIN(x) AS score_from, MAX(x) AS score_to, CAST(SUM(w) AS BIGINT) AS applications, ROUND_EVEN(v, 9) AS calibrated_pd
FROM f JOIN n USING (i) GROUP BY v""")
def q_isotonic_calibration(spark, sf_dir):
    """The isotonic fit of defaults on scores in steps of 0.001; the oracle is its max-min formula."""
    scored = portfolio(spark, sf_dir).select(F.expr(ISOTONIC_SCORE).cast("double").alias("score"), "default_flag")
    return isotonic_blocks(scored, "score", "default_flag").select(
        "score_from", "score_to", F.col("weight").cast("bigint").alias("applications"), F.bround("value", 9).alias("calibrated_pd"))


@register("brier", oracle=f"""WITH {PORTFOLIO_CTE}, lg AS ({_long_sql(['scorecard'])})
SELECT score_name, ROUND_EVEN(AVG(POW(label - score, 2)), 6) AS brier_score FROM lg GROUP BY score_name""")
def q_brier(spark, sf_dir):
    return mt.brier(long_scores(spark, sf_dir, ["scorecard"])).select(
        "score_name", F.bround("brier", 6).alias("brier_score"))


@register("roc_auc_gini", oracle=_rank_sql(["scorecard"]) + """
SELECT score_name, ROUND_EVEN(auc, 6) AS roc_auc, ROUND_EVEN(2e0 * auc - 1e0, 6) AS gini FROM rm""")
def q_roc_auc_gini(spark, sf_dir):
    r = mt.rank_metrics(long_scores(spark, sf_dir, ["scorecard"]))
    return r.select("score_name", F.bround("auc", 6).alias("roc_auc"), F.bround("gini", 6).alias("gini"))


@register("ks_statistic", oracle=_rank_sql(["scorecard"]) + """
SELECT score_name, ROUND_EVEN(GREATEST(ks_max, 0e0), 4) AS ks,
  ROUND_EVEN(CASE WHEN ks_max > 0 THEN ks_at ELSE CAST('inf' AS DOUBLE) END, 4) AS ks_threshold FROM rm""")
def q_ks_statistic(spark, sf_dir):
    r = mt.rank_metrics(long_scores(spark, sf_dir, ["scorecard"]))
    return r.select("score_name", F.bround("ks", 4).alias("ks"), F.bround("ks_threshold", 4).alias("ks_threshold"))


@register("pr_auc", oracle=_rank_sql(["scorecard"]) + """
SELECT score_name, ROUND_EVEN(ap, 6) AS pr_auc FROM rm""")
def q_pr_auc(spark, sf_dir):
    r = mt.rank_metrics(long_scores(spark, sf_dir, ["scorecard"]))
    return r.select("score_name", F.bround("average_precision", 6).alias("pr_auc"))


@register("roc_curve", oracle=_rank_sql(["scorecard"]) + """
SELECT score_name, score AS threshold, ROUND_EVEN(pos_cum / CAST(P AS DOUBLE), 6) AS tpr,
  ROUND_EVEN(neg_cum / CAST(N AS DOUBLE), 6) AS fpr, ROUND_EVEN(ksd, 6) AS ks_diff FROM k""")
def q_roc_curve(spark, sf_dir):
    r = mt.roc_curve(long_scores(spark, sf_dir, ["scorecard"]))
    return r.select("score_name", "threshold", *[F.bround(c, 6).alias(c) for c in ("tpr", "fpr", "ks_diff")])


@register("roc_curve_points", oracle=_rank_sql(["scorecard", "dti_rule"]) + """,
t AS (SELECT *, LEAD(pos) OVER w AS pos_next, LEAD(neg) OVER w AS neg_next, ROW_NUMBER() OVER w AS i FROM k
      WINDOW w AS (PARTITION BY score_name ORDER BY score DESC))
SELECT score_name, score AS threshold, ROUND_EVEN(pos_cum / CAST(P AS DOUBLE), 6) AS tpr,
  ROUND_EVEN(neg_cum / CAST(N AS DOUBLE), 6) AS fpr, ROUND_EVEN(ksd, 6) AS ks_diff
FROM t WHERE i = 1 OR pos_next IS NULL OR pos_next <> pos OR neg_next <> neg
UNION ALL SELECT DISTINCT score_name, CAST('inf' AS DOUBLE), 0e0, 0e0, 0e0 FROM k""")
def q_roc_curve_points(spark, sf_dir):
    r = mt.roc_curve_points(long_scores(spark, sf_dir, ["scorecard", "dti_rule"]))
    return r.select("score_name", "threshold", *[F.bround(c, 6).alias(c) for c in ("tpr", "fpr", "ks_diff")])


def _bins_sql(names, n_bins: int = 10) -> str:
    return f"""WITH {PORTFOLIO_CTE},
lg AS ({_long_sql(names)}),
pb AS (SELECT score_name, label, LEAST(1e0, GREATEST(0e0, score)) AS p,
         CAST(LEAST(GREATEST(CEIL(LEAST(1e0, GREATEST(0e0, score)) * {n_bins}e0), 1), {n_bins}) AS INTEGER) AS bin FROM lg),
ag AS (SELECT score_name, bin, COUNT(*) AS cnt, SUM(label) AS pos, SUM(CAST(p AS DECIMAL(38,9))) AS psum FROM pb GROUP BY 1, 2),
gr AS (SELECT score_name, CAST(UNNEST(GENERATE_SERIES(1, {n_bins})) AS INTEGER) AS bin FROM (SELECT DISTINCT score_name FROM lg)),
bins AS (SELECT gr.score_name, gr.bin, CAST(COALESCE(cnt, 0) AS BIGINT) AS count,
          CASE WHEN COALESCE(cnt, 0) > 0 THEN pos / CAST(cnt AS DOUBLE) ELSE 0e0 END AS accuracy,
          CASE WHEN COALESCE(cnt, 0) > 0 THEN CAST(psum AS DOUBLE) / cnt ELSE 0e0 END AS confidence
        FROM gr LEFT JOIN ag ON gr.score_name = ag.score_name AND gr.bin = ag.bin),
errs AS (SELECT score_name, SUM(CASE WHEN count > 0 THEN count / CAST(SUM(count) OVER (PARTITION BY score_name) AS DOUBLE) * ABS(accuracy - confidence) ELSE 0e0 END) AS ece0,
          MAX(CASE WHEN count > 0 THEN ABS(accuracy - confidence) END) AS mce0 FROM bins GROUP BY score_name)"""


@register("ece_bins", oracle=_bins_sql(["scorecard"]) + """
SELECT score_name, bin, count, ROUND_EVEN(accuracy, 6) AS accuracy, ROUND_EVEN(confidence, 6) AS confidence FROM bins""")
def q_ece_bins(spark, sf_dir):
    b = mt.calibration_bins(long_scores(spark, sf_dir, ["scorecard"]), 10)
    return b.select("score_name", "bin", "count", F.bround("accuracy", 6).alias("accuracy"),
                    F.bround("confidence", 6).alias("confidence"))


@register("reliability_curve", oracle=_bins_sql(["scorecard"]) + """
SELECT score_name, bin, ROUND_EVEN(confidence, 6) AS mean_predicted, ROUND_EVEN(accuracy, 6) AS observed_rate
FROM bins WHERE count > 0""")
def q_reliability_curve(spark, sf_dir):
    b = mt.calibration_bins(long_scores(spark, sf_dir, ["scorecard"]), 10, keep_empty=False)
    return b.select("score_name", "bin", F.bround("confidence", 6).alias("mean_predicted"),
                    F.bround("accuracy", 6).alias("observed_rate"))


def _bundle_sql(names) -> str:
    # Window inside an aggregate is not allowed; recompute ECE from per-bin totals.
    return _bins_sql(names).replace(
        "errs AS (SELECT score_name, SUM(CASE WHEN count > 0 THEN count / CAST(SUM(count) OVER (PARTITION BY score_name) AS DOUBLE) * ABS(accuracy - confidence) ELSE 0e0 END) AS ece0,\n          MAX(CASE WHEN count > 0 THEN ABS(accuracy - confidence) END) AS mce0 FROM bins GROUP BY score_name)",
        """bt AS (SELECT *, SUM(count) OVER (PARTITION BY score_name) AS tot FROM bins),
errs AS (SELECT score_name, SUM(CASE WHEN count > 0 THEN count / CAST(tot AS DOUBLE) * ABS(accuracy - confidence) ELSE 0e0 END) AS ece0,
          COALESCE(MAX(CASE WHEN count > 0 THEN ABS(accuracy - confidence) END), 0e0) AS mce0 FROM bt GROUP BY score_name)""") + \
        """,
br AS (SELECT score_name, AVG(POW(label - score, 2)) AS brier FROM lg GROUP BY score_name),""" + \
        _rank_sql(names).split(f"WITH {PORTFOLIO_CTE},\nlg AS ({_long_sql(names)}),", 1)[1]


@register("calibration_metrics", oracle=_bundle_sql(["scorecard"]) + """
SELECT br.score_name, ROUND_EVEN(brier, 6) AS brier_score, ROUND_EVEN(ece0, 6) AS expected_calibration_error,
  ROUND_EVEN(mce0, 6) AS maximum_calibration_error, ROUND_EVEN(auc, 6) AS roc_auc
FROM br JOIN errs ON br.score_name = errs.score_name JOIN rm ON br.score_name = rm.score_name""")
def q_calibration_metrics(spark, sf_dir):
    return mt.metrics_bundle(long_scores(spark, sf_dir, ["scorecard"]), 10)


@register("calibration_comparison", oracle=_bundle_sql(["funnel_scorecard", "scorecard"]) + """,
mb AS (SELECT br.score_name, ROUND_EVEN(brier, 6) AS b, ROUND_EVEN(ece0, 6) AS e, ROUND_EVEN(mce0, 6) AS m, ROUND_EVEN(auc, 6) AS a
       FROM br JOIN errs ON br.score_name = errs.score_name JOIN rm ON br.score_name = rm.score_name),
x AS (SELECT MAX(CASE WHEN score_name = 'funnel_scorecard' THEN b END) AS bb, MAX(CASE WHEN score_name = 'scorecard' THEN b END) AS ba,
         MAX(CASE WHEN score_name = 'funnel_scorecard' THEN e END) AS eb, MAX(CASE WHEN score_name = 'scorecard' THEN e END) AS ea,
         MAX(CASE WHEN score_name = 'funnel_scorecard' THEN m END) AS mb_, MAX(CASE WHEN score_name = 'scorecard' THEN m END) AS ma,
         MAX(CASE WHEN score_name = 'funnel_scorecard' THEN a END) AS ab, MAX(CASE WHEN score_name = 'scorecard' THEN a END) AS aa FROM mb)
SELECT bb AS brier_before, ba AS brier_after, eb AS ece_before, ea AS ece_after, mb_ AS mce_before, ma AS mce_after,
  ROUND_EVEN(bb - ba, 6) AS brier_score_reduction,
  ROUND_EVEN(CASE WHEN bb > 0 THEN (bb - ba) / bb * 100e0 ELSE 0e0 END, 2) AS brier_score_reduction_pct,
  ROUND_EVEN(eb - ea, 6) AS expected_calibration_error_reduction,
  ROUND_EVEN(CASE WHEN eb > 0 THEN (eb - ea) / eb * 100e0 ELSE 0e0 END, 2) AS expected_calibration_error_reduction_pct,
  ROUND_EVEN(aa - ab, 6) AS auc_delta FROM x""")
def q_calibration_comparison(spark, sf_dir):
    return mt.calibration_comparison(long_scores(spark, sf_dir, ["funnel_scorecard", "scorecard"]),
                                     before="funnel_scorecard", after="scorecard")


@register("model_comparison", oracle=_rank_sql(list(SCORES)) + """
SELECT score_name, ROUND_EVEN(auc, 6) AS roc_auc, ROUND_EVEN(ap, 6) AS pr_auc, ROUND_EVEN(2e0 * auc - 1e0, 6) AS gini,
  ROUND_EVEN(GREATEST(ks_max, 0e0), 4) AS ks,
  ROUND_EVEN(CASE WHEN ks_max > 0 THEN ks_at ELSE CAST('inf' AS DOUBLE) END, 4) AS ks_threshold FROM rm""")
def q_model_comparison(spark, sf_dir):
    return mt.model_comparison(long_scores(spark, sf_dir, list(SCORES)))


@register("score_density", oracle=f"""WITH {PORTFOLIO_CTE},
lg AS ({_long_sql(['scorecard', 'funnel_scorecard'])}),
c AS (SELECT score_name, CAST(LEAST(FLOOR(LEAST(1e0, GREATEST(0e0, score)) * 40e0), 39) AS BIGINT) AS bin, CAST(COUNT(*) AS BIGINT) AS count
      FROM lg GROUP BY 1, 2)
SELECT score_name, bin, count, ROUND_EVEN(count / CAST(SUM(count) OVER (PARTITION BY score_name) AS DOUBLE) * 40e0, 6) AS density FROM c""")
def q_score_density(spark, sf_dir):
    return mt.score_density(long_scores(spark, sf_dir, ["scorecard", "funnel_scorecard"]), 40)
