"""Record validation as data (V1-V3, V5): rule tables evaluated as Column expressions.

A rule is ``(name, ok)``: ``ok`` is a boolean Column that must be true. A null field fails
its rule (required fields are strict). Rows are never dropped silently: ``validate`` adds a
``violations`` array and ``split_valid`` returns the valid and the rejected rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditspark.functions.economics import (
    DEFAULT_COST_OF_FUNDS,
    DEFAULT_INTEREST_RATE,
    DEFAULT_LGD,
    DEFAULT_TERM_MONTHS,
)

Rule = tuple[str, Column]


def _between(c: str, lo: float, hi: float, lo_open: bool = False, hi_open: bool = False) -> Column:
    col = F.col(c)
    left = col > lo if lo_open else col >= lo
    right = col < hi if hi_open else col <= hi
    return left & right


def application_rules() -> list[Rule]:
    """V1: income > 0; DTI 0..2; delinquencies >= 0; utilisation 0..2; amount > 0; term > 0;
    rate (0, 1]; cost of funds (0, 1]."""
    return [
        ("monthly_income_gt_0", F.col("monthly_income") > 0),
        ("debt_to_income_0_2", _between("debt_to_income", 0.0, 2.0)),
        ("historical_delinquencies_ge_0", F.col("historical_delinquencies") >= 0),
        ("revolving_utilization_0_2", _between("revolving_utilization", 0.0, 2.0)),
        ("loan_amount_gt_0", F.col("loan_amount") > 0),
        ("loan_term_months_gt_0", F.col("loan_term_months") > 0),
        ("interest_rate_0_1", _between("interest_rate", 0.0, 1.0, lo_open=True)),
        ("cost_of_funds_0_1", _between("cost_of_funds", 0.0, 1.0, lo_open=True)),
    ]


def scored_application_rules() -> list[Rule]:
    """V2: V1 plus PD in [0, 1] and a 0/1 default flag."""
    return application_rules() + [
        ("pd_0_1", _between("pd", 0.0, 1.0)),
        ("default_flag_0_1", F.col("default_flag").isin(0, 1)),
    ]


def applicant_rules(has_threshold: bool = True) -> list[Rule]:
    """V3: decision requests: as V1 but cost of funds may be 0; LGD 0..1; optional cutoff 0..1."""
    rules = [r for r in application_rules() if r[0] != "cost_of_funds_0_1"]
    rules += [
        ("cost_of_funds_ge_0_le_1", _between("cost_of_funds", 0.0, 1.0)),
        ("lgd_0_1", _between("lgd", 0.0, 1.0)),
    ]
    if has_threshold:
        t = F.col("policy_threshold")
        rules.append(("policy_threshold_0_1", t.isNull() | _between("policy_threshold", 0.0, 1.0)))
    return rules


# Field defaults of a decision request (used only when the field is absent).
APPLICANT_DEFAULTS = {
    "loan_term_months": DEFAULT_TERM_MONTHS,
    "interest_rate": DEFAULT_INTEREST_RATE,
    "cost_of_funds": DEFAULT_COST_OF_FUNDS,
    "lgd": DEFAULT_LGD,
}


def with_applicant_defaults(df: DataFrame) -> DataFrame:
    """V3 defaults for absent optional fields: a column that isn't there, or a null in one."""
    missing = {k: F.coalesce(F.col(k), F.lit(v)) if k in df.columns else F.lit(v) for k, v in APPLICANT_DEFAULTS.items()}
    if "policy_threshold" not in df.columns:
        missing["policy_threshold"] = F.lit(None).cast("double")
    return df.withColumns(missing) if missing else df


def violations(rules: Sequence[Rule]) -> Column:
    """``array<string>`` of failed rule names, in rule order (empty when valid)."""
    return F.array_compact(F.array(*[
        F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]))


def validate(df: DataFrame, rules: Sequence[Rule], column: str = "violations") -> DataFrame:
    return df.withColumn(column, violations(rules)).withColumn("is_valid", F.size(column) == 0)


def split_valid(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    checked = validate(df, rules)
    return checked.where("is_valid").drop("violations", "is_valid"), checked.where("NOT is_valid")


def check_closed_schema(df: DataFrame, allowed: Sequence[str], required: Sequence[str] = (),
                        types: dict[str, str] | None = None) -> None:
    """V5: unknown columns are rejected (closed schema); required columns must be present, and
    columns named in ``types`` must have exactly that type (no coercion of text or booleans)."""
    extra = [c for c in df.columns if c not in set(allowed)]
    if extra:
        raise ValueError(f"unknown fields: {extra}")
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required fields: {missing}")
    found = dict(df.dtypes)
    wrong = {c: found[c] for c, t in (types or {}).items() if c in found and found[c] != t}
    if wrong:
        raise TypeError(f"fields of another type than declared: {wrong}")
