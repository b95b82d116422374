"""V8: output invariants checked while results are written.

Counts, exposures and losses are never negative, rates lie in [0, 1], nothing approves more than it
got. The conditions are part of the pass that writes or streams the result, so they cost no second
one: ``guarded`` rows raise where they are computed, and ``write_checked`` then takes the broken output away;
streams carry counts in their progress (``observed``), and ``InvariantListener`` stops one that shows a broken
row. (``Observation`` objects aren't used: a session that holds one can't run ML stages that keep the session.)
"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from creditspark.sources.storage import remove_path

NOT_NEGATIVE = ["total_applications", "approved_count", "total_exposure", "requested_exposure", "allocated_exposure", "expected_loss", "net_loss_default", "count"]
RATES = ["threshold", "approval_rate", "expected_default_rate", "breakeven_pd", "calibrated_pd", "decision_threshold", "optimal_threshold"]
AT_MOST = [("approved_count", "total_applications"), ("allocated_exposure", "requested_exposure")]
PREFIX = "broken_"
_MARK = "rows break output invariants: "


class InvariantError(ValueError):
    """A result breaks an output invariant."""


def invariants(columns: list[str]) -> dict[str, Column]:
    """The conditions that a result with these columns must meet, by name; a null meets all of them."""
    rules = {f"{c}_ge_0": F.col(c) >= 0 for c in NOT_NEGATIVE if c in columns}
    rules |= {f"{c}_0_1": F.col(c).between(0, 1) for c in RATES if c in columns}
    rules |= {f"{a}_le_{b}": F.col(a) <= F.col(b) for a, b in AT_MOST if a in columns and b in columns}
    # NaN is the greatest double in Spark's order: "not negative" alone would let it pass.
    return {name: ok & ~F.isnan(F.col(name.removesuffix("_ge_0")).cast("double")) if name.endswith("_ge_0") else ok for name, ok in rules.items()}


def invariant_counts(columns: list[str]) -> list[Column]:
    """Aggregates: rows seen, and how many break each invariant."""
    rules = invariants(columns)
    return [F.count(F.lit(1)).alias("checked"), *[F.count(F.when(~ok, F.lit(1))).alias(PREFIX + name) for name, ok in rules.items()]]


def broken(metrics: dict) -> dict[str, int]:
    """The invariants that some rows break, with their number."""
    return {k.removeprefix(PREFIX): int(n) for k, n in metrics.items() if k.startswith(PREFIX) and n}


def guarded(df: DataFrame) -> DataFrame:
    """The same rows; computing the first column of one that breaks an invariant raises an error that names it.

    The check is part of a column: a filter would be moved below the projections, and there all that it reads,
    a model's score for one, would be computed once more for each mention.
    """
    rules = invariants(df.columns)
    if not rules:
        return df
    names = F.array_join(F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()])), ", ")
    first = df.schema[0]
    error = F.raise_error(F.concat(F.lit(_MARK), names)).cast(first.dataType)
    return df.withColumn(first.name, F.when(names == "", df[first.name]).otherwise(error))


def write_checked(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Write a result as parquet, replacing what is there.

    A row that breaks an invariant raises ``InvariantError`` and leaves no output.
    """
    writer = guarded(df).write.mode("overwrite")
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    except PySparkException as error:
        if _MARK not in str(error):
            raise
        remove_path(df.sparkSession, path)
        raise InvariantError(_MARK + str(error).split(_MARK, 1)[1].split("\n")[0]) from None


def observed(df: DataFrame, name: str = "invariants") -> DataFrame:
    """A streaming result whose progress carries the counts, for ``InvariantListener``."""
    return df.observe(name, *invariant_counts(df.columns))


class InvariantListener(StreamingQueryListener):
    """Collects broken invariants from streams that are ``observed`` and stops those streams."""

    def __init__(self, spark, name: str = "invariants"):
        self.spark, self.name = spark, name
        self.found: dict[str, dict[str, int]] = {}
        self.rows = 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is None:
            return
        metrics = row.asDict()
        self.rows += int(metrics["checked"])
        if found := broken(metrics):
            self.found[str(event.progress.id)] = found
            query = self.spark.streams.get(str(event.progress.id))
            if query is not None:
                query.stop()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def check(self) -> None:
        """Raise if any stream showed a broken row."""
        if self.found:
            raise InvariantError(f"rows break output invariants: {self.found}")
