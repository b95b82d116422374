"""Portfolio profiling: summary, value counts, describe, correlation, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditspark.operators.quantiles import exact_quantiles
from creditspark.operators.sweep import money_sum, round_money

SUMMARY_COLUMNS = [
    "total_applications", "total_exposure", "default_count", "default_rate", "avg_pd",
    "avg_loan_amount", "avg_monthly_income", "avg_interest_rate", "avg_cost_of_funds", "seed",
]


def portfolio_summary(df: DataFrame, seed: int | None = None) -> DataFrame:
    """A2: one aggregate pass; money to 2 dp and rates to 5 dp. Empty input is an error (V7)."""
    agg = df.agg(
        F.count(F.lit(1)).alias("n"),
        money_sum("loan_amount").alias("exposure"),
        F.sum("default_flag").alias("defaults"),
        F.avg("pd").alias("avg_pd"),
        F.avg("loan_amount").alias("avg_amount"),
        F.avg("monthly_income").alias("avg_income"),
        F.avg("interest_rate").alias("avg_rate"),
        F.avg("cost_of_funds").alias("avg_cof"),
    )
    # V7: an empty portfolio has no summary; raise_error keeps the check inside the plan.
    guard = F.when(F.col("n") == 0, F.raise_error(F.lit("a summary needs at least one row")))
    return agg.select(
        F.coalesce(guard.cast("bigint"), F.col("n")).alias("total_applications"),
        round_money("exposure").alias("total_exposure"),
        F.col("defaults").cast("bigint").alias("default_count"),
        F.bround(F.col("defaults") / F.col("n"), 5).alias("default_rate"),
        F.bround("avg_pd", 5).alias("avg_pd"),
        F.bround("avg_amount", 2).alias("avg_loan_amount"),
        F.bround("avg_income", 2).alias("avg_monthly_income"),
        F.bround("avg_rate", 5).alias("avg_interest_rate"),
        F.bround("avg_cof", 5).alias("avg_cost_of_funds"),
        F.lit(seed).cast("bigint").alias("seed"),
    )


def default_counts(df: DataFrame, label: str = "default_flag") -> DataFrame:
    """Counts per label value and the overall bad rate (a window over the <=2 grouped rows)."""
    from pyspark.sql import Window

    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    whole = Window.partitionBy()
    total = F.sum("count").over(whole)
    bads = F.sum(F.col(label) * F.col("count")).over(whole)
    return counts.select(
        label, "count",
        F.bround(F.col("count") / total, 6).alias("share"),
        F.bround(bads / total, 6).alias("bad_rate"),
    )


def describe(df: DataFrame, columns: Sequence[str], decimals: int = 6,
             quantile_method: str = "nearest") -> DataFrame:
    """Count, nulls, mean, std, min, quartiles, max per column; one row per column.

    Quartiles are order statistics at rank ``round((n-1) q)`` (``quantile_method="nearest"``,
    what a dataframe ``describe()`` reports); ``"linear"`` interpolates as numpy does.
    Moments come from one aggregate; quartiles from the distributed exact quantile operator
    (no single task holds all values of a column).
    """
    columns = list(columns)
    long = _stack(df, columns)
    moments = long.groupBy("column_name").agg(
        F.count("value").alias("count"),
        F.sum(F.when(F.col("value").isNull(), 1).otherwise(0)).cast("bigint").alias("null_count"),
        (F.sum(F.col("value").cast("decimal(38,9)")).cast("double") / F.count("value")).alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    q = exact_quantiles(long.where(F.col("value").isNotNull()), "value", [0.25, 0.5, 0.75],
                        group_cols=["column_name"], method=quantile_method)
    quart = q.groupBy("column_name").pivot("fraction", [0.25, 0.5, 0.75]).agg(F.first("quantile"))
    quart = quart.select("column_name", F.col("`0.25`").alias("q25"), F.col("`0.5`").alias("q50"),
                         F.col("`0.75`").alias("q75"))
    out = moments.join(quart, "column_name", "left")
    # The mean comes from an exact decimal sum and is rounded as a decimal; quartiles of
    # few-decimal data interpolate to one or two extra digits, hence 8 places for them.
    return out.select(
        "column_name", F.col("count").cast("bigint").alias("count"), "null_count",
        F.round(F.col("mean").cast("decimal(38,9)"), decimals).cast("double").alias("mean"),
        *[F.bround(c, decimals).alias(c) for c in ("std", "min")],
        *[F.bround(c, decimals + 2).alias(c) for c in ("q25", "q50", "q75")],
        F.bround("max", decimals).alias("max"),
    )


def _stack(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Wide -> long ``(column_name, value double)`` with a generator (no join, no shuffle)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value"))
                      for c in columns])
    return df.select(F.inline(pairs))


def correlation_matrix(df: DataFrame, columns: Sequence[str], decimals: int = 6) -> DataFrame:
    """Pearson correlation of every pair, one aggregate pass, long format (col_a, col_b, corr)."""
    columns = list(columns)
    exprs, keys = [], []
    for i, a in enumerate(columns):
        for b in columns[i:]:
            name = f"{i}_{columns.index(b)}"
            exprs.append(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(name))
            keys.append((a, b, name))
    row = df.agg(*exprs)
    pairs = []
    for a, b, name in keys:
        pairs.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(name).alias("corr")))
        if a != b:
            pairs.append(F.struct(F.lit(b).alias("col_a"), F.lit(a).alias("col_b"), F.col(name).alias("corr")))
    return row.select(F.inline(F.array(*pairs))).select(
        "col_a", "col_b", F.bround("corr", decimals).alias("corr"))


def histogram(df: DataFrame, continuous: Sequence[str], discrete: Sequence[str] = (),
              bins: int = 40) -> DataFrame:
    """Equal-width bins over [min, max] for continuous columns, value counts for discrete.

    Output ``(feature, bin, bin_lo, bin_hi, count)``; for discrete columns ``bin`` is the value.
    The max lands in the last bin (numpy's closed last edge).
    """
    parts = []
    if continuous:
        long = _stack(df, continuous).where(F.col("value").isNotNull())
        rng = long.groupBy("column_name").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
        width = F.col("hi") - F.col("lo")
        raw = F.floor((F.col("value") - F.col("lo")) / width * F.lit(float(bins)))
        b = F.when(width <= 0, F.lit(0)).otherwise(F.least(raw, F.lit(bins - 1))).cast("bigint")
        # rng has one row per column: broadcasting it is bounded by the number of columns.
        binned = long.join(F.broadcast(rng), "column_name").withColumn("bin", b)
        counted = binned.groupBy("column_name", "bin", "lo", "hi").agg(F.count(F.lit(1)).alias("count"))
        step = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
        parts.append(counted.select(
            F.col("column_name").alias("feature"), "bin",
            F.bround(F.col("lo") + step * F.col("bin"), 6).alias("bin_lo"),
            F.bround(F.col("lo") + step * (F.col("bin") + 1), 6).alias("bin_hi"),
            "count"))
    for c in discrete:
        counted = df.groupBy(F.col(c).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
        parts.append(counted.select(
            F.lit(c).alias("feature"), "bin",
            F.col("bin").cast("double").alias("bin_lo"), F.col("bin").cast("double").alias("bin_hi"),
            "count"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
