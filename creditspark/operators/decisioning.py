"""Batch decisioning (O14): score -> economics -> decision -> explanation in one projection.

No shuffle, no state: the plan is a single select over the applications, so it runs the
same way over a parquet table or a Structured Streaming source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditspark.functions import decision as dz
from creditspark.functions.economics import breakeven_pd, net_gain, net_loss
from creditspark.functions.validation import applicant_rules, split_valid, with_applicant_defaults
from creditspark.operators.sweep import round_money

DECISION_COLUMNS = ["application_id", "decision", "calibrated_pd", "expected_value", "breakeven_pd",
                    "decision_threshold", "net_gain_performing", "net_loss_default"]


def decision_frame(applicants: DataFrame, pd_col: str = "pd", with_factors: bool = True,
                   factor_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Decision record per application (V3 defaults filled for absent fields).

    ``policy_threshold`` (nullable) overrides the breakeven rule row by row. ``carry`` columns are
    kept at the end.
    """
    df = with_applicant_defaults(applicants)
    pd = F.col(pd_col).cast("double")
    amount, rate, cof = F.col("loan_amount"), F.col("interest_rate"), F.col("cost_of_funds")
    term, lgd, thr = F.col("loan_term_months").cast("double"), F.col("lgd"), F.col("policy_threshold")
    gain = net_gain(amount, rate, cof, term)
    loss = net_loss(amount, lgd, cof, term)
    staged = df.select("*", gain.alias("_gain"), loss.alias("_loss"), pd.alias("_pd"),
                       breakeven_pd(rate, cof, lgd, term).alias("_be"))
    ev = (F.lit(1.0) - F.col("_pd")) * F.col("_gain") - F.col("_pd") * F.col("_loss")
    staged = staged.withColumn("_ev", ev)
    approved = dz.approve(F.col("_pd"), F.col("_ev"), F.col("_be"), thr)
    cols: list[Column] = [
        F.col("application_id"),
        dz.decision_label(approved).alias("decision"),
        F.bround("_pd", 6).alias("calibrated_pd"),
        round_money("_ev").alias("expected_value"),
        F.bround("_be", 6).alias("breakeven_pd"),
        F.bround(dz.effective_threshold(F.col("_be"), thr), 6).alias("decision_threshold"),
        round_money("_gain").alias("net_gain_performing"),
        round_money("_loss").alias("net_loss_default"),
    ]
    if with_factors:
        cols.append(dz.decision_factors(
            F.col("debt_to_income"), F.col("historical_delinquencies"), F.col("revolving_utilization"),
            amount, F.col("monthly_income"), rate, cof, F.col("_pd"), F.col("_ev"), F.col("_be"),
            with_text=factor_text,
        ).alias("key_factors"))
    return staged.select(*cols, *carry)


def exploded_factors(decisions: DataFrame) -> DataFrame:
    """P16 flattened: one row per (application, factor), description kept apart."""
    return decisions.select("application_id", F.inline("key_factors")).select(
        "application_id", F.col("name").alias("factor"), "value", "impact", "description")


def decide(applicants: DataFrame, pd_col: str = "pd", with_factors: bool = True,
           factor_text: bool = True) -> tuple[DataFrame, DataFrame]:
    """O14 behind V3: decisions for the valid requests, and the rejected rows with their
    ``violations`` (nothing is dropped)."""
    valid, rejected = split_valid(with_applicant_defaults(applicants), applicant_rules())
    return decision_frame(valid, pd_col, with_factors, factor_text), rejected
