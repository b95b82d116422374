"""creditspark: lending-decision analytics expressed as Spark DataFrame plans.

Sub-packages
------------
sources    read/derive/write portfolio tables, model artifacts
functions  Column -> Column building blocks (economics, scorecard, decisions, rules, features)
operators  DataFrame -> DataFrame operators (one-pass cutoff sweep, optimisation, stress,
           sizing, profiling, fairness, score metrics, scalable prefix sums / exact quantiles)
ml         Spark ML pipelines, calibration and persistence
streaming  the stateless decision plan on a Structured Streaming source
plans      the registered query catalogue and its DuckDB oracle SQL
"""

__version__ = "0.1.0"
