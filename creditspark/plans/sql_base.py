"""Shared text for the DuckDB oracle queries.

The oracle is written independently of the Spark plans: brute force where the Spark plan is
clever (cutoff x portfolio conditional sums instead of the one-pass sweep), plain SQL
aggregates where the Spark plan uses windows or sufficient statistics.
"""

from __future__ import annotations

# Portfolio derived from orders / customer / lineitem (same rules as sources/portfolio.py).
PORTFOLIO_CTE = """
li AS (SELECT l_orderkey, CAST(SUM(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS BIGINT) AS n_r,
              AVG(ABS(l_discount)) AS disc, AVG(l_quantity) AS qty FROM lineitem GROUP BY l_orderkey),
b AS (SELECT o_orderkey AS application_id, c_mktsegment AS segment, o_orderdate AS application_ts,
  ROUND(GREATEST(1e3, LEAST(35e3, 1e3 + GREATEST(c_acctbal, 0e0))), 2) AS monthly_income,
  ROUND(GREATEST(5e-2, LEAST(7e-1, 5e-2 + 6e-1*COALESCE(qty,0e0)/50e0)), 4) AS debt_to_income,
  CAST(CASE WHEN n_r IS NULL OR n_r < 2 THEN 0 ELSE n_r - 1 END AS BIGINT) AS historical_delinquencies,
  ROUND(GREATEST(1e-2, LEAST(99e-2, COALESCE(disc,0e0)*8e0)), 4) AS revolving_utilization,
  GREATEST(15e2, LEAST(50e3, ROUND(o_totalprice/20e0/1e2,0)*1e2)) AS loan_amount,
  CAST(12*(1+(o_orderkey % 5)) AS BIGINT) AS loan_term_months,
  ROUND(45e-3 + 2e-3*(o_custkey % 11), 4) AS cost_of_funds,
  ((o_orderkey*7919+104729) % 1000003)/1000003e0 AS u,
  ROUND(2e-2 + 3e-2*(((o_orderkey*104729+7919) % 1000003)/1000003e0), 4) AS margin
 FROM orders JOIN customer ON o_custkey=c_custkey LEFT JOIN li ON l_orderkey=o_orderkey),
s AS (SELECT *, ROUND(1e0/(1e0+EXP(-(-395e-2+18e-1*debt_to_income+15e-1*revolving_utilization+55e-2*historical_delinquencies-5e-1*LN(monthly_income/1e3)+12e-2*(loan_amount/monthly_income)))),5) AS pd FROM b),
portfolio AS (SELECT application_id, segment, application_ts, monthly_income, debt_to_income, historical_delinquencies, revolving_utilization, loan_amount, loan_term_months,
  GREATEST(75e-3, LEAST(32e-2, ROUND(cost_of_funds + ROUND(pd*35e-2 + 1e-7,4) + margin, 4))) AS interest_rate, cost_of_funds, pd, CAST(CASE WHEN u < pd THEN 1 ELSE 0 END AS BIGINT) AS default_flag FROM s)
"""


def lit(x: float) -> str:
    """A DOUBLE literal with the exact value of ``x`` (plain decimals are DECIMAL in DuckDB)."""
    r = repr(float(x))
    return r if ("e" in r or "inf" in r or "nan" in r) else r + "e0"


def values_table(name: str, column: str, values) -> str:
    """``name(column)`` as a VALUES list of exact doubles."""
    body = ", ".join(f"({lit(v)})" for v in values)
    return f"{name} AS (SELECT * FROM (VALUES {body}) AS t({column}))"


def enriched_cte(mode: str = "default", rate: float = 0.18, cof: float = 0.05, lgd: float = 0.45,
                 term: int = 12, pd_expr: str = "pd", source: str = "portfolio", name: str = "e",
                 extra: str = "") -> str:
    """P1-P7 in SQL: default mode keeps the row's rate/CoF/term; override replaces all four."""
    if mode == "override":
        r, c, t = lit(rate), lit(cof), lit(float(term))
    else:
        r, c, t = "interest_rate", "cost_of_funds", "CAST(loan_term_months AS DOUBLE)"
    l_ = lit(lgd)
    return f"""{name}0 AS (SELECT *{extra}, CAST({pd_expr} AS DOUBLE) AS pd_, loan_amount AS amt_, {r} AS rate_, {c} AS cof_,
      {t} AS term_, {l_} AS lgd_ FROM {source}),
{name} AS (SELECT *, amt_*(rate_-cof_)*(term_/12e0) AS gain_, amt_*(lgd_+cof_*(term_/12e0)) AS loss_,
      (1e0-pd_)*(amt_*(rate_-cof_)*(term_/12e0)) - pd_*(amt_*(lgd_+cof_*(term_/12e0))) AS ev_,
      CASE WHEN (rate_-cof_)*(term_/12e0) <= 0 THEN 0e0
           WHEN (rate_-cof_)*(term_/12e0) + (lgd_+cof_*(term_/12e0)) <= 0 THEN 0e0
           ELSE LEAST(1e0, GREATEST(0e0, ((rate_-cof_)*(term_/12e0)) / (((rate_-cof_)*(term_/12e0)) + (lgd_+cof_*(term_/12e0))))) END AS be_
      FROM {name}0)"""


def policy_select(cut: str = "c", src: str = "e", threshold: str = "threshold",
                  group: str = "", rounding: bool = True) -> str:
    """Brute-force policy record per cutoff: ``FROM cutoffs CROSS JOIN portfolio``."""
    g = f"{group}, " if group else ""
    ok = f"{src}.pd_ <= {cut}.{threshold}"
    n = f"CAST(SUM(CASE WHEN {ok} THEN 1 ELSE 0 END) AS BIGINT)"
    tot = "CAST(COUNT(*) AS BIGINT)"
    expo = f"SUM(CASE WHEN {ok} THEN {dec(src + '.amt_')} ELSE 0 END)"
    margin = f"SUM(CASE WHEN {ok} THEN {dec(f'(1e0-{src}.pd_)*{src}.gain_')} ELSE 0 END)"
    loss = f"SUM(CASE WHEN {ok} THEN {dec(f'{src}.pd_*{src}.loss_')} ELSE 0 END)"
    pnl = f"SUM(CASE WHEN {ok} THEN {dec(src + '.ev_')} ELSE 0 END)"
    pds = f"CAST(SUM(CASE WHEN {ok} THEN {dec(src + '.pd_')} ELSE 0 END) AS DOUBLE)"
    return f"""SELECT {g}{cut}.{threshold} AS threshold, {tot} AS total_applications, {n} AS approved_count,
      CASE WHEN COUNT(*) > 0 THEN {n} / CAST(COUNT(*) AS DOUBLE) ELSE 0e0 END AS approval_rate,
      CASE WHEN {n} > 0 THEN {expo} ELSE 0 END AS total_exposure,
      CASE WHEN {n} > 0 THEN {margin} ELSE 0 END AS gross_margin,
      CASE WHEN {n} > 0 THEN {loss} ELSE 0 END AS expected_loss,
      CASE WHEN {n} > 0 THEN {pnl} ELSE 0 END AS expected_pnl,
      CASE WHEN {n} > 0 THEN {pds} / {n} ELSE 0e0 END AS expected_default_rate,
      CASE WHEN {n} > 0 AND {expo} > 0 THEN CAST({pnl} AS DOUBLE) / CAST({expo} AS DOUBLE) ELSE 0e0 END AS return_on_exposure
    FROM {cut} CROSS JOIN {src} GROUP BY {g}{cut}.{threshold}"""


def dec(expr: str) -> str:
    """Per-row money value as the exact DECIMAL(38, 9) the Spark plans sum."""
    return f"CAST({expr} AS DECIMAL(38,9))"


def money(expr: str, dp: int = 2) -> str:
    """Round an exact decimal money value (half away from zero) and return a DOUBLE."""
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(38,9)), {dp}) AS DOUBLE)"


def rounded_policy(src: str, threshold_dp: int = 4, money_dp: int = 2, rate_dp: int = 4,
                   extra: str = "") -> str:
    """P25 rounding (half-even, as Python's round) over a policy relation."""
    e = f"{extra}, " if extra else ""
    return f"""SELECT {e}ROUND_EVEN(threshold, {threshold_dp}) AS threshold, total_applications, approved_count,
      ROUND_EVEN(approval_rate, {rate_dp}) AS approval_rate, {money('total_exposure', money_dp)} AS total_exposure,
      {money('gross_margin', money_dp)} AS gross_margin, {money('expected_loss', money_dp)} AS expected_loss,
      {money('expected_pnl', money_dp)} AS expected_pnl, ROUND_EVEN(expected_default_rate, {rate_dp}) AS expected_default_rate,
      ROUND_EVEN(return_on_exposure, {rate_dp}) AS return_on_exposure FROM {src}"""
