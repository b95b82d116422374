"""Exact quantiles (linear as numpy's default, or nearest rank) by bracketed selection.

Built-in ``percentile`` keeps every distinct value of a group in one task's map and scans it
once per requested fraction; a continuous column at scale does not fit that, and neither does
shuffling all its distinct values. Instead two scans:

1. a mergeable quantile sketch per group (``percentile_approx``, whose rank error is at most
   ``n / accuracy``) gives edges a fixed share of the rows apart. By that bound each wanted rank
   lies between two known edges: its bracket. Overlapping brackets are joined; a few doubles
   per fraction reach the driver.
2. the second scan counts the rows between brackets by gap, and inside brackets by value
   (partial aggregation; gaps collapse to one row per task). Only values inside brackets are
   shuffled, a few percent of the rows by construction, however many distinct values there are.

Counts of gaps and brackets give each bracket's first rank; a window inside each bracket ranks
its values; each wanted rank is then matched to one value. The result is exact: ranks come from
counts, the sketch only says where to look, and a rank outside its bracket (which the sketch's
bound excludes) raises. ``order_statistics`` gives the values around the ranks, ``exact_quantiles``
interpolates ``a + (b-a) t`` (``b - (b-a)(1-t)`` for ``t >= 0.5``, as numpy does).

``method="nearest"`` picks the single order statistic at ``(n-1) q`` rounded half away from
zero (the rule of a dataframe ``describe()`` with nearest interpolation); no interpolation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditspark.operators.cumulative import count_up_to, with_coarse

CELLS_PER_FRACTION = 50  # sketch cells; a bracket takes about three of them
LEAST_CELLS = 1000
ACCURACY_PER_CELL = 4  # the sketch's rank error is a quarter of a cell


@dataclass(frozen=True)
class RankSketch:
    """Per group: how many rows, how many of them not NaN (``m``), and ``cells + 1`` edges of these, edge i
    about ``i m / cells`` ranks above the least value."""

    cells: int
    groups: dict[tuple, tuple[int, int, list[float]]]

    def count(self, group: tuple = ()) -> int:
        return self.groups[group][0] if group in self.groups else 0

    def bracket(self, group: tuple, low: int, high: int) -> tuple[float, float]:
        """Values between which the 0-based ranks ``low`` and ``high`` lie, by the sketch's bound."""
        _, m, edges = self.groups[group]
        if not m:
            return -math.inf, math.nan
        slack = m / (ACCURACY_PER_CELL * self.cells) + 2.0
        below = min(self.cells, math.floor((low - slack) / m * self.cells))
        above = math.ceil((high + 1 + slack) / m * self.cells)
        while below > 0 and not math.isfinite(edges[below]):  # brackets begin at finite values, or have no beginning
            below -= 1
        start = edges[below] if below > 0 else -math.inf
        return start, (edges[above] if above < self.cells else math.nan)


def rank_sketch(df: DataFrame, col: str, fractions: int, group_cols: Sequence[str] = (),
                cells: int | None = None) -> RankSketch:
    """One scan: the sketch of ``col`` for so many fractions (groups x cells doubles reach the driver).

    ``cells`` sets the number of cells; fewer make brackets wider, never results other.
    """
    cells = max(1, int(cells)) if cells else max(LEAST_CELLS, CELLS_PER_FRACTION * fractions)
    value = F.col(col).cast("double")
    number = F.when(~F.isnan(value), value)
    points = F.lit([i / cells for i in range(cells + 1)])
    rows = df.where(value.isNotNull()).groupBy(*group_cols).agg(
        F.count(value).alias("n"), F.count(number).alias("m"), F.percentile_approx(number, points, ACCURACY_PER_CELL * cells).alias("edges")).collect()
    return RankSketch(cells, {tuple(r[g] for g in group_cols): (int(r["n"]), int(r["m"]), list(r["edges"] or ())) for r in rows if r["n"]})


def exact_quantiles(df: DataFrame, col: str, fractions: Sequence[float],
                    group_cols: Sequence[str] = (), n_ranges: int | None = None,
                    method: str = "linear", sketch: RankSketch | None = None) -> DataFrame:
    """``(group..., fraction, quantile)`` for every requested fraction; nulls are ignored."""
    a, b, t = F.col("lower"), F.col("upper"), F.col("weight")
    diff = b - a
    q = F.when(t >= 0.5, b - diff * (F.lit(1.0) - t)).otherwise(a + diff * t)
    found = order_statistics(df, col, fractions, group_cols, n_ranges, method, sketch)
    return found.select(*group_cols, "fraction", F.when(diff == 0, a).otherwise(q).alias("quantile"))


def column_quantiles(df: DataFrame, columns: Sequence[str], fractions: Sequence[float],
                     cells: int | None = None) -> dict[str, tuple[int, dict[float, float]]]:
    """Per column: how many of its values are null, and its quantiles as ``exact_quantiles`` gives them.

    The columns share their scans and rows aren't stacked: all sketches are one aggregate, the rows below
    each bracket are counted by comparisons, and only values inside brackets are shuffled. A few numbers
    per column and fraction reach the driver.
    """
    columns, fractions = list(columns), [float(f) for f in fractions]
    cells = max(1, int(cells)) if cells else max(LEAST_CELLS, CELLS_PER_FRACTION * len(fractions))
    points = F.lit([i / cells for i in range(cells + 1)])
    values = [F.col(c).cast("double") for c in columns]
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, v in enumerate(values):
        number = F.when(~F.isnan(v), v)
        aggregates += [F.count(v).alias(f"n{i}"), F.count(number).alias(f"m{i}"), F.percentile_approx(number, points, ACCURACY_PER_CELL * cells).alias(f"e{i}")]
    made = df.agg(*aggregates).first()
    sketch = RankSketch(cells, {(i,): (int(made[f"n{i}"]), int(made[f"m{i}"]), list(made[f"e{i}"] or ())) for i in range(len(columns)) if made[f"n{i}"]})
    targets = {i: {f: target_ranks(n, f, "linear") for f in fractions} for (i,), (n, _, _) in sketch.groups.items()}
    brackets = {i: list(zip(*_joined([sketch.bracket((i,), low, high) for low, high, _ in t.values()]))) for i, t in targets.items()}
    below = [F.count(F.when(values[i] < F.lit(start), F.lit(1))).alias(f"b{i}_{j}") for i, own in brackets.items() for j, (start, _) in enumerate(own)]
    firsts = df.agg(*below).first() if below else None

    wanted = []
    for i, t in targets.items():
        first = [int(firsts[f"b{i}_{j}"]) for j in range(len(brackets[i]))]
        for rank in sorted({r for low, high, _ in t.values() for r in (low, high)}):
            j = max((k for k, n in enumerate(first) if n <= rank), default=0)
            wanted.append((i, j, rank, rank - first[j]))
    found: dict[tuple[int, int], float] = {}
    if wanted:
        held = []
        for i, own in brackets.items():
            place = F.lit(None).cast("int")
            for j, (start, stop) in enumerate(own):
                place = F.when((values[i] >= F.lit(start)) & (values[i] <= F.lit(stop)), F.lit(j)).otherwise(place)
            held.append(F.struct(F.lit(i).alias("_c"), place.alias("_j"), values[i].alias("_v")))
        any_held = F.coalesce(*[h["_j"] for h in held]).isNotNull()
        inside = df.where(any_held).select(F.inline(F.array(*held))).where(F.col("_j").isNotNull())
        counted = inside.groupBy("_c", "_j", "_v").agg(F.count(F.lit(1)).alias("_w"))
        upto = F.sum("_w").over(Window.partitionBy("_c", "_j").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        ranks = df.sparkSession.createDataFrame(wanted, "_c int, _j int, _rank long, _at long")  # columns x fractions x 2 rows at most
        hit = (counted.withColumn("_upto", upto).join(F.broadcast(ranks), ["_c", "_j"])
               .where("_upto - _w <= _at and _at < _upto").select("_c", "_rank", "_v"))
        found = {(r["_c"], r["_rank"]): r["_v"] for r in hit.collect()}
        if any((i, rank) not in found for i, _, rank, _ in wanted):
            raise RuntimeError("a rank lies outside its bracket")
    return {c: (int(made["rows"] - made[f"n{i}"]), {f: interpolate(found[i, low], found[i, high], w) for f, (low, high, w) in targets.get(i, {}).items()})
            for i, c in enumerate(columns)}


def interpolate(lower: float, upper: float, weight: float) -> float:
    """The quantile between two order statistics, by the same operations as the Column version."""
    diff = upper - lower
    if diff == 0:
        return lower
    return upper - diff * (1.0 - weight) if weight >= 0.5 else lower + diff * weight


def target_ranks(n: int, fraction: float, method: str) -> tuple[int, int, float]:
    """The 0-based ranks around ``(n - 1) fraction`` and the weight of the upper one."""
    h = (n - 1) * fraction
    if method == "nearest":
        near = math.floor(h + 0.5)
        return near, near, 0.0
    return math.floor(h), math.ceil(h), h - math.floor(h)


def order_statistics(df: DataFrame, col: str, fractions: Sequence[float],
                     group_cols: Sequence[str] = (), n_ranges: int | None = None,
                     method: str = "linear", sketch: RankSketch | None = None) -> DataFrame:
    """``(group..., fraction, lower, upper, weight)``: the order statistics around each fraction's
    rank, and the weight of the upper one. A monotone map of the column maps them one by one.

    The sketch (given, or taken by one job with ``n_ranges`` cells) fixes the brackets; the rest is lazy.
    """
    if method not in ("linear", "nearest"):
        raise ValueError(f"method must be 'linear' or 'nearest', got {method!r}")
    group_cols = list(group_cols)
    fractions = [float(f) for f in fractions]
    for f in fractions:
        if not 0.0 <= f <= 1.0:
            raise ValueError(f"fraction must be in [0, 1], got {f}")
    sketch = sketch or rank_sketch(df, col, len(fractions), group_cols, n_ranges)
    spark, kinds = df.sparkSession, [df.schema[g] for g in group_cols]
    wanted, brackets = [], []
    for group in sketch.groups:
        targets = [(f, *target_ranks(sketch.count(group), f, method)) for f in fractions]
        wanted += [(*group, *t) for t in targets]
        brackets.append((*group, *_joined([sketch.bracket(group, low, high) for _, low, high, _ in targets])))
    schema = lambda *own: T.StructType([T.StructField(k.name, k.dataType) for k in kinds] + [T.StructField(n, t) for n, t in own])
    doubles = T.ArrayType(T.DoubleType())
    # Both tables have groups x fractions entries at most: bounded broadcasts.
    targets = spark.createDataFrame(wanted, schema(("fraction", T.DoubleType()), ("_lo", T.LongType()), ("_hi", T.LongType()), ("weight", T.DoubleType())))
    bounds = spark.createDataFrame(brackets, schema(("_from", doubles), ("_to", doubles)))

    values = df.where(F.col(col).isNotNull()).select(*group_cols, F.col(col).cast("double").alias("_v"))
    tagged = _tagged(values, bounds, brackets, group_cols)
    counted = tagged.groupBy(*group_cols, "_j", "_in").agg(F.count(F.lit(1)).alias("_w"))
    totals = counted.groupBy(*group_cols, "_j", F.col("_in").isNull().alias("_gap")).agg(F.sum("_w").alias("_n"))
    before = Window.partitionBy(*group_cols).orderBy("_j", "_gap").rowsBetween(Window.unboundedPreceding, -1)
    places = totals.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    # Wanted ranks in their brackets (two small tables), then matched to the bracket's values.
    ends = targets.select(*group_cols, F.explode(F.array_distinct(F.array("_lo", "_hi"))).alias("_rank")).distinct()
    held = ends.alias("e").join(F.broadcast(places.alias("p")), _same("e", "p", group_cols) & (F.col("p._first") <= F.col("e._rank"))
                                & (F.col("e._rank") < F.col("p._first") + F.col("p._n"))).select(
        *[F.col(f"e.{g}").alias(g) for g in group_cols], "e._rank", "p._first",
        F.when(F.col("p._gap"), F.raise_error(F.lit("a rank lies outside its bracket")).cast("int")).otherwise(F.col("p._j")).alias("_j"))
    inside = Window.partitionBy(*group_cols, "_j").orderBy("_in").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.where(F.col("_in").isNotNull()).withColumn("_upto", F.sum("_w").over(inside))
    rank = F.col("e._rank") - F.col("e._first")
    hit = ranked.alias("r").join(F.broadcast(held.alias("e")), _same("r", "e", [*group_cols, "_j"])
                                 & (F.col("r._upto") - F.col("r._w") <= rank) & (rank < F.col("r._upto"))).select(
        *[F.col(f"e.{g}").alias(g) for g in group_cols], F.col("e._rank").alias("_rank"), F.col("r._in").alias("_value"))
    # A value for each wanted rank: groups x fractions x 2 rows.
    low, high = hit.alias("l"), hit.alias("h")
    found = targets.alias("t").join(F.broadcast(low), _same("t", "l", group_cols) & (F.col("t._lo") == F.col("l._rank")))
    found = found.join(F.broadcast(high), _same("t", "h", group_cols) & (F.col("t._hi") == F.col("h._rank")))
    return found.select(*[F.col(f"t.{g}").alias(g) for g in group_cols], F.col("t.fraction").alias("fraction"),
                        F.col("l._value").alias("lower"), F.col("h._value").alias("upper"), F.col("t.weight").alias("weight"))


def _joined(brackets: list[tuple[float, float]]) -> tuple[list[float], list[float]]:
    """Disjoint brackets that cover the given ones: their lower ends, and their upper ends (NaN: no end)."""
    starts, stops = [], []
    for low, high in sorted(brackets, key=lambda b: b[0]):
        if starts and (math.isnan(stops[-1]) or low <= stops[-1]):
            stops[-1] = math.nan if math.isnan(stops[-1]) or math.isnan(high) else max(stops[-1], high)
        else:
            starts.append(low)
            stops.append(high)
    return starts, stops


def _tagged(values: DataFrame, bounds: DataFrame, brackets: list[tuple], group_cols: list[str]) -> DataFrame:
    """Adds ``_j``, how many brackets begin at or below the value, and ``_in``, the value where the last of
    them holds it (NaN, the greatest double, is in a bracket without end)."""
    v = F.col("_v")
    if group_cols:
        longest = max((len(b[-1]) for b in brackets), default=0)
        tagged = values.join(F.broadcast(with_coarse(bounds, "_from", longest)), group_cols)
        tagged = count_up_to(tagged, "_from", v, longest, "_j")
        stop: Column = F.expr("element_at(_to, _j)")
    else:
        starts, stops = brackets[0] if brackets else ([], [])
        open_ = int(bool(starts) and starts[0] == -math.inf)
        tagged = values.withColumn("_j", F.lit(open_))
        if len(starts) > open_:
            splits = [-math.inf, *starts[open_:], math.inf]
            tagged = Bucketizer(splits=splits, inputCol="_v", outputCol="_bucket", handleInvalid="keep").transform(values)
            tagged = tagged.withColumn("_j", F.least(F.col("_bucket").cast("int") + open_, F.lit(len(starts))))
        stop = F.element_at(F.lit(stops).cast("array<double>"), F.col("_j"))
    return tagged.select(*group_cols, "_j", F.when((F.col("_j") > 0) & (v <= F.when(F.col("_j") > 0, stop)), v).alias("_in"))


def _same(a: str, b: str, cols: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out
