"""Score metrics for binary labels (M11-M21, M26), any number of score columns at once.

Scores are stacked long as ``(score_name, score, label)`` with a generator (one scan for all
models). Rank metrics work on the distinct-score table -- one row per (score_name, score)
with positive/negative counts, built with partial aggregation so a hot score value costs one
row per task -- and its running sums in descending score order come from the
range-partitioned prefix sum (``operators.cumulative``), never from a single-task window.

AUC is exact: ``sum(neg_s * (2 * pos_above_s + pos_s)) / (2 P N)`` with integer numerators
summed as DECIMAL(38, 0), so no rounding error and no order dependence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditspark.operators.cumulative import prefix_sums

INT = "decimal(38,0)"


def stack_scores(df: DataFrame, scores: dict[str, Column | str], label: str = "default_flag") -> DataFrame:
    """``(score_name, score double, label double)`` for every score column (nulls dropped)."""
    items = [F.struct(F.lit(name).alias("score_name"),
                      (F.col(c) if isinstance(c, str) else c).cast("double").alias("score"))
             for name, c in scores.items()]
    long = df.select(F.col(label).cast("double").alias("label"), F.inline(F.array(*items)))
    return long.where(F.col("score").isNotNull() & F.col("label").isNotNull())


def score_counts(long: DataFrame) -> DataFrame:
    """One row per (score_name, score) with positive and negative counts.

    Every metric of this module follows from it; metrics of one query share its exchange, so
    they cost one scan of the rows together.
    """
    return long.groupBy("score_name", "score").agg(
        F.sum("label").cast("bigint").alias("pos"),
        (F.count(F.lit(1)) - F.sum("label")).cast("bigint").alias("neg"))


def distinct_scores(long: DataFrame) -> DataFrame:
    """``score_counts`` with running counts from the top score down."""
    return prefix_sums(score_counts(long), "score", ["pos", "neg"], group_cols=["score_name"], descending=True)


def _totals(dist: DataFrame) -> DataFrame:
    return dist.groupBy("score_name").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))


def rank_metrics(long: DataFrame) -> DataFrame:
    """Per score: AUC, Gini, KS and its cutoff, average precision (unrounded)."""
    dist = distinct_scores(long)
    pos_above = F.col("pos_cum") - F.col("pos")
    auc_term = F.col("neg").cast(INT) * (F.lit(2).cast(INT) * pos_above.cast(INT) + F.col("pos").cast(INT))
    # totals: one row per score column -- a bounded broadcast.
    tot = _totals(dist)
    x = dist.join(F.broadcast(tot), "score_name")
    tpr = F.col("pos_cum") / F.col("P")
    fpr = F.col("neg_cum") / F.col("N")
    precision = F.col("pos_cum") / (F.col("pos_cum") + F.col("neg_cum"))
    per = x.select(
        "score_name", "score", "P", "N", auc_term.alias("_auc"),
        (tpr - fpr).alias("_ks"),
        (F.col("pos") / F.col("P") * precision).alias("_ap"),
    )
    agg = per.groupBy("score_name").agg(
        F.first("P").alias("P"), F.first("N").alias("N"),
        F.sum("_auc").alias("_auc_num"),
        F.max("_ks").alias("_ks_max"),
        F.max_by("score", F.struct("_ks", "score")).alias("_ks_at"),
        F.sum("_ap").alias("average_precision"),
    )
    one_class = (F.col("P") == 0) | (F.col("N") == 0)
    auc = F.when(one_class, F.lit(None).cast("double")).otherwise(
        F.col("_auc_num").cast("double") / (F.lit(2.0) * F.col("P").cast("double") * F.col("N").cast("double")))
    # The ROC curve starts at (0, 0) with an infinite cutoff: with no positive separation the
    # first maximum is that point.
    ks = F.greatest(F.col("_ks_max"), F.lit(0.0))
    ks_cut = F.when(F.col("_ks_max") > 0, F.col("_ks_at")).otherwise(F.lit(float("inf")))
    return agg.select("score_name", auc.alias("auc"), (F.lit(2.0) * auc - F.lit(1.0)).alias("gini"),
                      ks.alias("ks"), ks_cut.alias("ks_threshold"), "average_precision")


def roc_curve(long: DataFrame) -> DataFrame:
    """Per distinct score (descending cutoffs): tpr, fpr and their difference."""
    dist = distinct_scores(long)
    tot = _totals(dist)
    x = dist.join(F.broadcast(tot), "score_name")
    tpr = F.col("pos_cum") / F.col("P")
    fpr = F.col("neg_cum") / F.col("N")
    return x.select("score_name", F.col("score").alias("threshold"), tpr.alias("tpr"), fpr.alias("fpr"),
                    (tpr - fpr).alias("ks_diff"))


def roc_curve_points(long: DataFrame) -> DataFrame:
    """M19, thinned: the curve's points without those on a straight line with even steps between their neighbours.

    A point goes if the next distinct score has as many positives and as many negatives as its own, so that
    the steps before and after it are equal; the first and the last one stay, and each curve starts at (0, 0) with
    an infinite cutoff. Whether a point goes depends on the next one only: a window inside its value range, and
    at the range's edge the first score of the next range (a table of ranges). What is left grows with the
    curve's bends, and the area under it and the largest difference are those of all points.
    """
    dist = prefix_sums(score_counts(long), "score", ["pos", "neg"], group_cols=["score_name"], descending=True, keep_range=True)
    step = F.struct("pos", "neg")
    heads = dist.groupBy("score_name", "_range").agg(F.max_by(step, "score").alias("_head"))
    after = heads.select("score_name", "_range", F.lead("_head").over(Window.partitionBy("score_name").orderBy("_range")).alias("_edge"))
    inside = Window.partitionBy("score_name", "_range").orderBy(F.col("score").desc())
    tot = _totals(dist)  # a row per score; after has a row per range: bounded broadcasts
    x = dist.join(F.broadcast(after), ["score_name", "_range"]).join(F.broadcast(tot), "score_name")
    x = x.withColumn("_next", F.coalesce(F.lead(step).over(inside), F.col("_edge")))
    first = (F.col("pos_cum") == F.col("pos")) & (F.col("neg_cum") == F.col("neg"))
    tpr, fpr = F.col("pos_cum") / F.col("P"), F.col("neg_cum") / F.col("N")
    bends = x.where(F.col("_next").isNull() | first | (F.col("_next") != step)).select(
        "score_name", F.col("score").alias("threshold"), tpr.alias("tpr"), fpr.alias("fpr"), (tpr - fpr).alias("ks_diff"))
    start = tot.select("score_name", F.lit(float("inf")).alias("threshold"), *[F.lit(0.0).alias(c) for c in ("tpr", "fpr", "ks_diff")])
    return start.unionByName(bends)


def brier(long: DataFrame) -> DataFrame:
    """Mean squared error of the score."""
    s, pos, neg = F.col("score"), F.col("pos"), F.col("neg")
    return score_counts(long).groupBy("score_name").agg(
        (F.sum(pos * F.pow(1.0 - s, 2) + neg * F.pow(s, 2)) / F.sum(pos + neg)).alias("brier"))


def calibration_bins(long: DataFrame, n_bins: int = 10, keep_empty: bool = True) -> DataFrame:
    """Equal-width right-closed bins (0 in bin 1, scores clipped to [0, 1]).

    ``(score_name, bin, count, accuracy, confidence)``; empty bins report zeros (or are
    dropped with ``keep_empty=False``, M20). Score sums are exact decimals.
    """
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score")))
    b = F.least(F.greatest(F.ceil(p * F.lit(float(n_bins))), F.lit(1)), F.lit(n_bins)).cast("int")
    rows = F.col("pos") + F.col("neg")
    agg = score_counts(long).groupBy("score_name", b.alias("bin")).agg(
        F.sum(rows).alias("count"), F.sum("pos").alias("_pos"),
        F.sum(p.cast("decimal(12,9)") * rows.cast("decimal(18,0)")).alias("_psum"))
    filled = agg
    if keep_empty:
        # Score names from the (names x bins)-row aggregate, not from another pass over the data.
        names = agg.select("score_name").distinct()
        grid = names.select("score_name", F.explode(F.sequence(F.lit(1), F.lit(n_bins))).alias("bin"))
        filled = grid.join(agg, ["score_name", "bin"], "left")
    cnt = F.coalesce(F.col("count"), F.lit(0)).cast("bigint")
    return filled.select(
        "score_name", "bin", cnt.alias("count"),
        F.when(cnt > 0, F.col("_pos") / cnt).otherwise(F.lit(0.0)).alias("accuracy"),
        F.when(cnt > 0, F.col("_psum").cast("double") / cnt).otherwise(F.lit(0.0)).alias("confidence"))


def calibration_errors(bins: DataFrame) -> DataFrame:
    """ECE (count-weighted mean |accuracy - confidence|) and MCE over non-empty bins."""
    w = Window.partitionBy("score_name")
    err = F.abs(F.col("accuracy") - F.col("confidence"))
    x = bins.select("score_name", "count", err.alias("err"), F.sum("count").over(w).alias("_n"))
    return x.groupBy("score_name").agg(
        F.sum(F.when(F.col("count") > 0, F.col("count") / F.col("_n") * F.col("err")).otherwise(0.0)).alias("ece"),
        F.coalesce(F.max(F.when(F.col("count") > 0, F.col("err"))), F.lit(0.0)).alias("mce"))


def metrics_bundle(long: DataFrame, n_bins: int = 10) -> DataFrame:
    """Brier, ECE, MCE and ROC-AUC per score, 6 dp."""
    b = brier(long)
    e = calibration_errors(calibration_bins(long, n_bins))
    r = rank_metrics(long).select("score_name", "auc")
    return b.join(e, "score_name").join(r, "score_name").select(
        "score_name", F.bround("brier", 6).alias("brier_score"),
        F.bround("ece", 6).alias("expected_calibration_error"),
        F.bround("mce", 6).alias("maximum_calibration_error"), F.bround("auc", 6).alias("roc_auc"))


def calibration_comparison(long: DataFrame, before: str, after: str, n_bins: int = 10) -> DataFrame:
    """Metrics before and after calibration, absolute and relative reductions (percent, 2 dp),
    AUC before and after, and its change."""
    m = metrics_bundle(long, n_bins).where(F.col("score_name").isin(before, after))
    names = ["brier_score", "expected_calibration_error", "maximum_calibration_error", "roc_auc"]
    # Two metric rows folded into one with conditional aggregates (no join needed).
    wide = m.agg(*[F.max(F.when(F.col("score_name") == side, F.col(c))).alias(f"{tag}_{c}")
                   for side, tag in ((before, "b"), (after, "a")) for c in names])

    def red(metric: str) -> list[Column]:
        bb, aa = F.col(f"b_{metric}"), F.col(f"a_{metric}")
        return [F.bround(bb - aa, 6).alias(f"{metric}_reduction"),
                F.bround(F.when(bb > 0, (bb - aa) / bb * 100.0).otherwise(F.lit(0.0)), 2).alias(f"{metric}_reduction_pct")]

    return wide.select(
        F.col("b_brier_score").alias("brier_before"), F.col("a_brier_score").alias("brier_after"),
        F.col("b_expected_calibration_error").alias("ece_before"), F.col("a_expected_calibration_error").alias("ece_after"),
        F.col("b_maximum_calibration_error").alias("mce_before"), F.col("a_maximum_calibration_error").alias("mce_after"),
        *red("brier_score"), *red("expected_calibration_error"),
        F.bround(F.col("a_roc_auc") - F.col("b_roc_auc"), 6).alias("auc_delta"))


def comparison_text(comparison: DataFrame) -> DataFrame:
    """The comparison with ``summary``, a line per error measure and its change."""
    line = lambda label, a, b, change: F.format_string(f"{label}: %.5f to %.5f (%+.2f %%)", a, b, -F.col(change))
    return comparison.withColumn("summary", F.concat_ws(
        "\n", line("Brier score", "brier_before", "brier_after", "brier_score_reduction_pct"),
        line("Expected calibration error", "ece_before", "ece_after", "expected_calibration_error_reduction_pct"),
        F.format_string("Largest calibration error: %.5f to %.5f", "mce_before", "mce_after"),
        F.format_string("ROC-AUC change: %+.4f", "auc_delta")))


def score_density(long: DataFrame, bins: int = 40) -> DataFrame:
    """Score distributions as densities over ``bins`` equal-width bins of [0, 1]."""
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score")))
    b = F.least(F.floor(p * F.lit(float(bins))), F.lit(bins - 1)).cast("bigint")
    c = long.select("score_name", b.alias("bin")).groupBy("score_name", "bin").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("score_name")
    return c.select("score_name", "bin", F.col("count").cast("bigint").alias("count"),
                    F.bround(F.col("count") / F.sum("count").over(w) * F.lit(float(bins)), 6).alias("density"))


def model_comparison(long: DataFrame) -> DataFrame:
    """AUC, PR-AUC, Gini, KS (4 dp) and KS cutoff (4 dp) per score."""
    r = rank_metrics(long)
    return r.select("score_name", F.bround("auc", 6).alias("roc_auc"), F.bround("average_precision", 6).alias("pr_auc"),
                    F.bround("gini", 6).alias("gini"), F.bround("ks", 4).alias("ks"),
                    F.bround("ks_threshold", 4).alias("ks_threshold"))

