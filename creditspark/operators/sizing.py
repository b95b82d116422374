"""Risk-based limit sizing (P20, F3, A4, O6): one projection and one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditspark.operators.sweep import MONEY, money_sum

AMOUNT_POLICY_COLUMNS = [
    "total_applications", "approved_count", "approval_rate", "requested_exposure",
    "allocated_exposure", "expected_pnl", "expected_loss", "return_on_exposure",
]


def sized_amount(risk_sensitivity: float = 1.5, min_approval_amount: float = 500.0) -> Column:
    """P20: ``amount * clip(1 - pd/be, 0, 1) ** s`` (be = 1 when be <= 0); 0 unless EV > 0 and the
    sized amount reaches the minimum (the floor rejects, it does not clamp)."""
    be = F.col("breakeven_pd")
    safe_be = F.when(be > 0, be).otherwise(F.lit(1.0))
    ratio = F.lit(1.0) - F.col("pd") / safe_be
    scale = F.pow(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio)), F.lit(float(risk_sensitivity)))
    sized = F.col("loan_amount") * scale
    ok = (F.col("expected_value") > 0) & (sized >= F.lit(float(min_approval_amount)))
    return F.when(ok, sized).otherwise(F.lit(0.0))


def with_sized_amount(enriched: DataFrame, risk_sensitivity: float = 1.5,
                      min_approval_amount: float = 500.0) -> DataFrame:
    return enriched.withColumn("approved_amount", sized_amount(risk_sensitivity, min_approval_amount))


def amount_policy(enriched: DataFrame, risk_sensitivity: float = 1.5,
                  min_approval_amount: float = 500.0) -> DataFrame:
    """Sized-limit portfolio outcome in one aggregate over the enriched portfolio."""
    sized = with_sized_amount(enriched, risk_sensitivity, min_approval_amount)
    years = F.col("loan_term_months") / F.lit(12.0)
    amt = F.col("approved_amount")
    gain = amt * ((F.col("interest_rate") - F.col("cost_of_funds")) * years)
    loss = amt * (F.col("lgd") + F.col("cost_of_funds") * years)
    pd = F.col("pd")
    approved = amt > 0
    agg = sized.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(approved, F.lit(1))).alias("k"),
        money_sum("loan_amount").alias("req"),
        money_sum(F.when(approved, amt)).alias("alloc"),
        money_sum(F.when(approved, (F.lit(1.0) - pd) * gain - pd * loss)).alias("pnl"),
        money_sum(F.when(approved, pd * loss)).alias("loss"),
    )
    zero = F.lit(0).cast(MONEY)
    some = (F.col("k") > 0) & (F.coalesce(F.col("alloc"), zero) != 0)
    return agg.select(
        F.col("n").cast("bigint").alias("total_applications"),
        F.when(some, F.col("k")).otherwise(F.lit(0)).cast("bigint").alias("approved_count"),
        F.when(some & (F.col("n") > 0), F.col("k") / F.col("n")).otherwise(F.lit(0.0)).alias("approval_rate"),
        F.coalesce(F.col("req"), zero).alias("requested_exposure"),
        F.when(some, F.col("alloc")).otherwise(zero).alias("allocated_exposure"),
        F.when(some, F.col("pnl")).otherwise(zero).alias("expected_pnl"),
        F.when(some, F.col("loss")).otherwise(zero).alias("expected_loss"),
        F.when(some, F.col("pnl").cast("double") / F.col("alloc").cast("double")).otherwise(F.lit(0.0))
        .alias("return_on_exposure"),
    )
