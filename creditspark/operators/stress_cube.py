"""The stress cube: every scenario's policy sweep from one aggregate of the unstressed portfolio.

A scenario turns a PD ``p`` into ``clip(p m, lo, hi)``, which never falls as ``p`` grows. "The stressed PD
is at most the cutoff" is therefore "``p`` is at most a breakpoint": the greatest double whose
product with ``m`` rounds to at most the cutoff. The clip points give two more breakpoints. The union
of all scenarios' breakpoints cuts the PDs into cells in which every scenario approves all rows or none
and clips all or none, so per cell a few exact sums are enough: counts, PDs, amounts and amounts times
the row's own terms, and their products with the PD. Everything else is linear in them:

    sum of stressed PD * x  =  m * (sum of p x, unclipped)  +  lo * (sum of x below)  +  hi * (sum of x above)

One scan with map-side partial aggregation to a row per cell and task; the cube has as many rows as there
are cutoffs and scenarios, whatever the portfolio's size, and the portfolio is never multiplied by the
scenarios. Cutoffs with the same approved rows have the same sums, thus tie exactly.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditspark.operators import sweep as sw


@dataclass(frozen=True)
class CubeScenario:
    """A stressed PD, the economic terms that hold where the portfolio's own don't, and the cutoffs to sweep."""

    key: int
    multiplier: float
    interest_rate: float
    cost_of_funds: float
    lgd: float
    term_months: float
    cutoffs: Sequence[float] = field(default_factory=tuple)
    bounds: tuple[float, float] | None = None  # of the stressed PD; None: the PD as it is, NaN never approved

    def __post_init__(self):
        if not self.multiplier > 0.0 or math.isinf(self.multiplier):
            raise ValueError(f"a PD multiplier must be positive and finite, got {self.multiplier}")
        if self.bounds and not self.bounds[0] <= self.bounds[1]:
            raise ValueError(f"PD bounds must be in order, got {self.bounds}")
        if self.bounds is None and self.multiplier != 1.0:
            raise ValueError("a multiplied PD needs bounds")


def greatest_within(multiplier: float, limit: float) -> float:
    """The greatest double ``x`` for which ``x * multiplier``, rounded, is at most ``limit``."""
    x = limit / multiplier
    while x * multiplier > limit:
        x = math.nextafter(x, -math.inf)
    while (up := math.nextafter(x, math.inf)) * multiplier <= limit:
        x = up
    return x


def clip_points(s: CubeScenario) -> tuple[float, float]:
    """The greatest PD that is raised to the lower bound, and the greatest that stays below the upper one."""
    if s.bounds is None:
        return -math.inf, math.inf
    lo, hi = s.bounds
    return greatest_within(s.multiplier, lo), greatest_within(s.multiplier, math.nextafter(hi, -math.inf))


def breakpoint_of(s: CubeScenario, cutoff: float) -> float:
    """The greatest PD that the scenario approves at ``cutoff``; -inf for none, +inf for all."""
    if s.bounds is not None and cutoff >= s.bounds[1]:
        return math.inf
    if s.bounds is not None and cutoff < s.bounds[0]:
        return -math.inf
    return greatest_within(s.multiplier, cutoff)


def _basis(columns: Sequence[str], mode: str) -> dict[str, tuple[str, Column]]:
    """What the gain, the funding cost and the loss are proportional to: name of the sum and row expression.

    Terms of the portfolio's own are part of the product; a scenario's terms are factors of the sum.
    """
    amount = F.col("loan_amount").cast("double")
    own = {c: mode == "default" and c in columns for c in ("interest_rate", "cost_of_funds", "lgd", "loan_term_months")}
    years = F.col("loan_term_months").cast("double") / F.lit(12.0) if own["loan_term_months"] else None
    found = {}
    for part, term in (("gain", "interest_rate"), ("funds", "cost_of_funds"), ("loss", "lgd")):
        name, value = "amount", amount
        if years is not None and part != "loss":
            name, value = f"{name}_years", value * years
        if own[term]:
            name, value = f"{name}_{term}", value * F.col(term).cast("double")
        found[part] = (name, value)
    return found


def _factor(s: CubeScenario, part: str, columns: Sequence[str], mode: str) -> float:
    term = {"gain": "interest_rate", "funds": "cost_of_funds", "loss": "lgd"}[part]
    own = lambda c: mode == "default" and c in columns
    years = 1.0 if part == "loss" or own("loan_term_months") else s.term_months / 12.0
    return (1.0 if own(term) else float(getattr(s, term))) * years


def scenario_sweeps(portfolio: DataFrame, scenarios: Sequence[CubeScenario], mode: str = "default") -> DataFrame:
    """``(scenario, policy columns)``: a row for each scenario's key and cutoff, unrounded.

    ``default``: the scenario's terms fill columns that the portfolio lacks; ``override``: they replace them.
    Rows without a PD are counted, never approved; a NaN PD counts as the upper bound.
    """
    if mode not in ("default", "override"):
        raise ValueError(f"mode must be 'default' or 'override', got {mode!r}")
    if len({s.key for s in scenarios}) < len(scenarios):
        raise ValueError("scenario keys must differ")
    spark, columns = portfolio.sparkSession, portfolio.columns
    cutoffs = {s.key: sw.validate_cutoffs(s.cutoffs) for s in scenarios}
    points = {s.key: [breakpoint_of(s, t) for t in cutoffs[s.key]] for s in scenarios}
    edges = sorted({x for s in scenarios for x in (*points[s.key], *clip_points(s)) if math.isfinite(x)}) or [0.0]
    last = len(edges)  # the cell above all edges; NaN has one more

    def cell(x: float) -> int:
        return last + 1 if x == math.inf else bisect.bisect_left(edges, x) if x > -math.inf else -1

    basis = _basis(columns, mode)
    sums = dict(basis.values())
    sums["amount"] = F.col("loan_amount").cast("double")
    pd = F.col("pd").cast("double")
    used = [c for c in ("pd", "loan_amount", "interest_rate", "cost_of_funds", "lgd", "loan_term_months") if c in columns]
    indexed = sw.edge_index(portfolio.select(*used), edges, "pd", "_cell")
    cube = indexed.groupBy(F.when(F.col("_cell") == -1, F.lit(last + 1)).otherwise(F.col("_cell")).alias("_cell")).agg(
        F.count(F.lit(1)).alias("_n"), sw.money_sum(F.when(~F.isnan(pd), pd)).alias("_p"),
        *[sw.money_sum(x).alias(f"_x_{name}") for name, x in sums.items()],
        *[sw.money_sum(F.when(~F.isnan(pd), pd * x)).alias(f"_px_{name}") for name, x in sums.items()])

    def literal(s: CubeScenario) -> Column:
        low, high = clip_points(s)
        lo, hi = s.bounds or (0.0, 0.0)
        values = {"scenario": s.key, "_low": cell(low), "_high": cell(high), "_m": float(s.multiplier), "_lo": float(lo), "_hi": float(hi)}
        values |= {f"_f_{part}": _factor(s, part, columns, mode) for part in basis}
        return F.struct(*[F.lit(v).alias(k) for k, v in values.items()])

    terms = F.array(*[literal(s) for s in scenarios])
    below, above = F.col("_cell") <= F.col("_low"), F.col("_cell") > F.col("_high")
    known = F.col("_cell").isNotNull()
    pieces = {"n": F.col("_n"), "n_lo": F.when(below, F.col("_n")), "n_hi": F.when(above, F.col("_n")), "p": F.when(~below & ~above, F.col("_p"))}
    for name in sums:
        pieces |= {f"x_{name}": F.col(f"_x_{name}"), f"lo_{name}": F.when(below, F.col(f"_x_{name}")), f"hi_{name}": F.when(above, F.col(f"_x_{name}")),
                   f"px_{name}": F.when(~below & ~above, F.col(f"_px_{name}"))}
    # The cube's rows, once per scenario, and among them a row for each cutoff where the running sums are read.
    cells = cube.select("*", F.inline(terms)).select("scenario", "_cell", F.lit(None).cast("double").alias("threshold"), F.col("_n").alias("_all"),
                                                     *[F.when(known, v).alias(k) for k, v in pieces.items()])
    asked = spark.createDataFrame([(s.key, cell(x), t) for s in scenarios for t, x in zip(cutoffs[s.key], points[s.key])],
                                  "scenario int, _cell int, threshold double")
    rows = cells.unionByName(asked, allowMissingColumns=True)
    part = Window.partitionBy("scenario")
    running = part.orderBy("_cell", F.col("threshold").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = rows.select("scenario", "threshold", F.coalesce(F.sum("_all").over(part), F.lit(0)).alias("_total"),
                       *[F.sum(k).over(running).alias(k) for k in pieces]).where("threshold is not null")
    factors = spark.createDataFrame([(s.key, float(s.multiplier), *map(float, s.bounds or (0.0, 0.0)), *[_factor(s, part_, columns, mode) for part_ in basis])
                                     for s in scenarios], "scenario int, _m double, _lo double, _hi double, " + ", ".join(f"_f_{p} double" for p in basis))
    upto = upto.join(F.broadcast(factors), "scenario")  # a row per scenario

    def num(c: str) -> Column:
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0))

    def stressed(name: str) -> Column:  # sum of stressed PD times x
        return F.col("_m") * num(f"px_{name}") + F.col("_lo") * num(f"lo_{name}") + F.col("_hi") * num(f"hi_{name}")

    plain = {p: num(f"x_{name}") * F.col(f"_f_{p}") for p, (name, _) in basis.items()}
    risky = {p: stressed(name) * F.col(f"_f_{p}") for p, (name, _) in basis.items()}
    margin = (plain["gain"] - plain["funds"]) - (risky["gain"] - risky["funds"])
    loss = risky["loss"] + risky["funds"]
    pd_sum = F.col("_m") * num("p") + F.col("_lo") * num("n_lo") + F.col("_hi") * num("n_hi")
    return upto.select("scenario", *sw.policy_metric_columns(
        F.col("threshold"), F.col("_total"), F.col("n"), F.col("x_amount"), margin, loss, margin - loss, pd_sum))
