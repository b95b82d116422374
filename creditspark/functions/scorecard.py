"""Logistic scorecard PD, risk-based pricing and application-id formatting (Column functions)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


# Scorecard coefficients of the portfolio model (logit scale).
@dataclass(frozen=True)
class ScorecardCoefficients:
    intercept: float = -3.95
    beta_debt_to_income: float = 1.80
    beta_utilization: float = 1.50
    beta_delinquencies: float = 0.55
    beta_log_income: float = 0.50
    beta_loan_to_income: float = 0.12


BASE_SCORECARD = ScorecardCoefficients()
# Full applicant funnel (prime to subprime): same slopes, higher intercept.
FUNNEL_SCORECARD = ScorecardCoefficients(intercept=-2.8)


def scorecard_logit(income: Column, dti: Column, util: Column, delinq: Column, amount: Column,
                    coef: ScorecardCoefficients = BASE_SCORECARD) -> Column:
    """Linear risk index; terms are added left to right so every engine gets the same double."""
    return (
        F.lit(coef.intercept)
        + F.lit(coef.beta_debt_to_income) * dti
        + F.lit(coef.beta_utilization) * util
        + F.lit(coef.beta_delinquencies) * delinq
        - F.lit(coef.beta_log_income) * F.ln(income / F.lit(1e3))
        + F.lit(coef.beta_loan_to_income) * (amount / income)
    )


def scorecard_pd(income: Column, dti: Column, util: Column, delinq: Column, amount: Column,
                 coef: ScorecardCoefficients = BASE_SCORECARD, decimals: int = 5) -> Column:
    """``round(sigmoid(logit), 5)``."""
    logit = scorecard_logit(income, dti, util, delinq, amount, coef)
    return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-logit)), decimals)


# Pricing rule bounds.
PRICING_PD_LOADING = 0.35
RATE_FLOOR = 0.075
RATE_CAP = 0.32


def risk_based_rate(cost_of_funds: Column, pd: Column, margin: Column) -> Column:
    """``clip(round(cof + round(0.35*pd + margin, 4), 4), 0.075, 0.32)``.

    ``margin`` is a column here (the reference draws it at random). The tiny 1e-7 nudge keeps
    the 4-dp rounding of the PD loading identical across engines at exact binary ties.
    """
    loading = F.round(pd * F.lit(PRICING_PD_LOADING) + F.lit(1e-7), 4)
    rate = F.round(cost_of_funds + loading + margin, 4)
    return F.greatest(F.lit(RATE_FLOOR), F.least(F.lit(RATE_CAP), rate))


def application_ref(seed: int, row_id: Column) -> Column:
    """``APP_{seed}_{i:06d}``."""
    return F.format_string(f"APP_{int(seed)}_%06d", row_id)
