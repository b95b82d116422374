"""Weight of evidence / information value over quantile bins.

Bins follow ``pandas.qcut(q, duplicates="drop")``: edges are the exact linear quantiles at
``linspace(0, 1, q+1)``, duplicates dropped, intervals right-closed with the lowest edge
included, so a value's 0-based bin is the number of inner edges strictly below it.

Plan: features are stacked long with a generator (one scan); edges come from the
distributed exact-quantile operator (features x (q+1) values, broadcast back); counts per
(feature, bin) are a grouped aggregate; shares and WoE are a window over <= features x q rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditspark.operators.quantiles import exact_quantiles
from creditspark.operators.sweep import linspace

ZERO_SHARE = 1e-4
# IV strength bands (upper bounds) and labels.
IV_BANDS = [(0.02, "not_predictive"), (0.10, "weak"), (0.30, "medium"), (0.50, "strong")]
IV_TOP_LABEL = "suspicious"


def _long(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])
    return df.select(F.col(target).cast("double").alias("_y"), F.inline(pairs)).where(F.col("value").isNotNull())


def quantile_edges(long: DataFrame, bins: int) -> DataFrame:
    """``(feature, edges array<double>)``: sorted unique quantile edges per feature."""
    q = exact_quantiles(long, "value", linspace(0.0, 1.0, bins + 1), group_cols=["feature"])
    return q.groupBy("feature").agg(F.array_sort(F.array_distinct(F.collect_list("quantile"))).alias("edges"))


def woe_bins(df: DataFrame, features: Sequence[str], target: str = "default_flag", bins: int = 10) -> DataFrame:
    """``(feature, bin, total, bads, goods, dist_goods, dist_bads, woe, iv_component)``."""
    long = _long(df, features, target)
    edges = quantile_edges(long, bins)
    # edges: one row per feature with <= bins+1 doubles -- a bounded broadcast.
    binned = long.join(F.broadcast(edges), "feature")
    inner = F.slice(F.col("edges"), 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    b = F.size(F.filter(inner, lambda e: e < F.col("value")))
    counts = binned.groupBy("feature", b.alias("bin")).agg(
        F.count(F.lit(1)).alias("total"), F.sum("_y").cast("bigint").alias("bads"))
    counts = counts.withColumn("goods", F.col("total") - F.col("bads"))
    per_feature = Window.partitionBy("feature")
    dg = F.col("goods") / F.sum("goods").over(per_feature)
    db = F.col("bads") / F.sum("bads").over(per_feature)
    shares = counts.select("*", F.when(dg == 0, F.lit(ZERO_SHARE)).otherwise(dg).alias("dist_goods"),
                           F.when(db == 0, F.lit(ZERO_SHARE)).otherwise(db).alias("dist_bads"))
    woe = F.ln(F.col("dist_goods") / F.col("dist_bads"))
    return shares.select("feature", F.col("bin").cast("bigint").alias("bin"), "total", "bads", "goods",
                         "dist_goods", "dist_bads", woe.alias("woe"),
                         ((F.col("dist_goods") - F.col("dist_bads")) * woe).alias("iv_component"))


def strength_label(iv: Column) -> Column:
    expr = None
    for upper, label in IV_BANDS:
        expr = F.when(iv < upper, F.lit(label)) if expr is None else expr.when(iv < upper, F.lit(label))
    return expr.otherwise(F.lit(IV_TOP_LABEL))


def iv_ranking(woe: DataFrame) -> DataFrame:
    """A10: information value per feature, bin count and strength, highest IV first."""
    iv = woe.groupBy("feature").agg(F.sum("iv_component").alias("iv"), F.count(F.lit(1)).alias("n_bins"))
    return iv.select("feature", F.bround("iv", 4).alias("information_value"),
                     F.col("n_bins").cast("bigint").alias("n_bins"), strength_label(F.col("iv")).alias("strength")
                     ).orderBy(F.col("information_value").desc(), F.col("feature"))
