"""Exact running sums over an ordered column without a single-partition window.

``Window.orderBy(x)`` with no partition key moves every row to one task. For a running sum
over a large table (ROC/KS over distinct scores, ranks for exact quantiles, stratified
splits), rows are instead cut into ~B value ranges per group using approximate quantiles of
the order column: each range is summed (B rows per group), the small table of range totals
gets an exclusive running sum (the offsets), and the final running sum is a window
partitioned by (group, range) plus that offset. Every task holds one value range; equal
order values always share a range, so a RANGE frame gives exact "sum of rows with
order <= current" semantics.

``group_cols`` are meant for a few large groups (score columns, labels, scenarios); the
per-group range edges are broadcast, bounded by groups x B doubles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_RANGES = 64


def _num_ranges(df: DataFrame, n_ranges: int | None) -> int:
    if n_ranges:
        return max(int(n_ranges), 1)
    try:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    except Exception:  # pragma: no cover - conf always present in practice
        parts = DEFAULT_RANGES
    return max(parts, 1)


def with_ranges(df: DataFrame, order_col: str, group_cols: Sequence[str] = (),
                n_ranges: int | None = None, range_col: str = "_range") -> DataFrame:
    """Adds ``range_col``: index of the approximate-quantile value range of ``order_col``."""
    group_cols = list(group_cols)
    b = _num_ranges(df, n_ranges)
    fracs = [i / b for i in range(1, b)]
    if not fracs:
        return df.withColumn(range_col, F.lit(0))
    key = F.col(order_col).cast("double")
    edges = df.groupBy(*group_cols).agg(
        F.array_sort(F.array_distinct(F.percentile_approx(key, F.array(*[F.lit(f) for f in fracs]), 10000)))
        .alias("_edges"))
    edges = with_coarse(edges, "_edges", b)
    if group_cols:
        tagged = df.join(F.broadcast(edges), group_cols, "left")
    else:
        both = edges.select(F.struct("_edges", "_edges_coarse").alias("b")).scalar()
        tagged = df.withColumn("_b", both).withColumns({c: F.col(f"_b.{c}") for c in ("_edges", "_edges_coarse")}).drop("_b")
    return count_up_to(tagged, "_edges", key, b, range_col, equal=False).drop("_edges", "_edges_coarse")


def _step(most: int) -> int:
    return max(1, round(most ** 0.5))


def with_coarse(edges: DataFrame, edges_col: str, most: int) -> DataFrame:
    """Adds ``<edges_col>_coarse``, every so many-th edge, for ``count_up_to``."""
    step = _step(most)
    return edges.withColumn(f"{edges_col}_coarse", F.filter(edges_col, lambda e, i: (i + 1) % step == 0))


def count_up_to(df: DataFrame, edges_col: str, key: Column, most: int, out_col: str, equal: bool = True) -> DataFrame:
    """Adds ``out_col``: how many of the row's sorted edges (``most`` at most) lie up to ``key``, or below it.

    In two steps of about sqrt(most) comparisons: the coarse edges (``with_coarse``), then those behind the last such.
    A null list has no edges.
    """
    step, none = _step(most), F.array().cast("array<double>")
    up_to = (lambda e: e <= key) if equal else (lambda e: e < key)
    skipped = df.withColumn("_skipped", F.size(F.filter(F.coalesce(f"{edges_col}_coarse", none), up_to)) * step)
    rest = F.coalesce(F.expr(f"slice({edges_col}, _skipped + 1, {step})"), none)
    return skipped.withColumn(out_col, F.col("_skipped") + F.size(F.filter(rest, up_to))).drop("_skipped")


def prefix_sums(df: DataFrame, order_col: str, value_cols: Sequence[str],
                group_cols: Sequence[str] = (), n_ranges: int | None = None,
                suffix: str = "_cum", descending: bool = False,
                tiebreak: Sequence[str] = (), keep_range: bool = False) -> DataFrame:
    """Adds ``<v><suffix>`` = sum of ``v`` over rows of the group with order <= current order.

    With ``descending`` the order is reversed (sum over rows with order >= current). With
    ``tiebreak`` columns the order is ``(order_col, *tiebreak)`` and assumed unique, so the
    sum runs row by row (a rank when ``v`` is 1). ``keep_range`` keeps the value-range index
    ``_range`` (ranges ascend with the order, so callers can key joins on it).
    """
    return prefix_sums_and_ranges(df, order_col, value_cols, group_cols, n_ranges, suffix,
                                  descending, tiebreak, keep_range)[0]


def prefix_sums_and_ranges(df: DataFrame, order_col: str, value_cols: Sequence[str],
                           group_cols: Sequence[str] = (), n_ranges: int | None = None,
                           suffix: str = "_cum", descending: bool = False,
                           tiebreak: Sequence[str] = (), keep_range: bool = False) -> tuple[DataFrame, DataFrame]:
    """``prefix_sums`` plus its range table ``(group..., _range, _t_<v>, _o_<v>)``: per value
    range the total of ``v`` and the exclusive running total before it (groups x ranges rows),
    so callers get group sizes and range spans without another pass over the data."""
    group_cols = list(group_cols)
    value_cols = list(value_cols)
    work = df
    order = order_col
    if descending:
        order = f"_neg_{order_col}"
        work = work.withColumn(order, -F.col(order_col).cast("double"))
    ranged = with_ranges(work, order, group_cols, n_ranges)
    totals = ranged.groupBy(*group_cols, "_range").agg(*[F.sum(v).alias(f"_t_{v}") for v in value_cols])
    before = (Window.partitionBy(*group_cols).orderBy("_range")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*group_cols, "_range", *[f"_t_{v}" for v in value_cols], *[
        F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in value_cols])
    # offsets has groups x ranges rows: a bounded broadcast.
    joined = ranged.join(F.broadcast(offsets), [*group_cols, "_range"], "left")
    w = Window.partitionBy(*group_cols, "_range").orderBy(F.col(order).asc(), *[F.col(c).asc() for c in tiebreak])
    running = (w.rowsBetween(Window.unboundedPreceding, Window.currentRow) if tiebreak
               else w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    out = joined.select("*", *[
        (F.col(f"_o_{v}") + F.sum(v).over(running)).alias(f"{v}{suffix}") for v in value_cols])
    drop = ([] if keep_range else ["_range"]) + [f"_o_{v}" for v in value_cols] + [f"_t_{v}" for v in value_cols] \
        + ([order] if descending else [])
    return out.drop(*drop), offsets
