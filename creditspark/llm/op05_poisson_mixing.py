"""Operator 5: mixing sources to target weights by Poisson replication.

A source's rate is its target share of the mixed characters over its own characters; a document's
number of copies inverts the Poisson distribution of that mean at a uniform value hashed from the
seed, doc_id and text. Copies are exploded and put into one global random order by a hash of
seed, document and copy number. Per-source sums and probabilities are written tables, so Spark
knows their size: small ones are broadcast, larger ones joined with the hot source split. The only
wide shuffle otherwise is the global one, whose keys are hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditspark.llm.scratch import Scratch, free_name

SEED = "mix-1"


def uniform_hash(*parts: F.Column) -> F.Column:
    """Uniform double in [0, 1): the first 52 bits of an MD5 over the parts."""
    text = F.concat_ws("|", *parts)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(2.0**52)


_ADDED = ("rate", "copies", "copy", "mix_key")


def source_rates(docs: DataFrame, *, epochs: float = 1.0, power: float = 0.7, weights: dict[str, float] | None = None) -> DataFrame:
    """(source, n_docs, chars, rate): mean copies per document of each source.

    Targets are ``weights`` (sources without one get 0), or shares in proportion to a source's
    characters to the ``power``. The mix has ``epochs`` times the input's characters on average.
    A null source is a source; one without characters has rate 0.
    """
    sums = Scratch(docs.sparkSession, "mixing").table(docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)).alias("chars")), "sums")
    if weights is None:
        target = F.when(F.col("chars") > 0, F.pow(F.col("chars").cast("double"), F.lit(power))).otherwise(0.0)
    else:
        target = F.lit(0.0)
        for name, value in weights.items():
            target = F.when(F.col("source") == name, F.lit(float(value))).otherwise(target)
        target = F.when(F.col("chars") > 0, F.coalesce(target, F.lit(0.0))).otherwise(0.0)
    sums = sums.withColumn("_target", target)
    totals = sums.agg(F.sum("chars").alias("_all"), F.sum("_target").alias("_targets"))  # one row
    rate = F.coalesce(F.try_divide(F.col("_target") * F.lit(float(epochs)) * F.col("_all"), F.col("_targets") * F.col("chars")), F.lit(0.0))
    return sums.crossJoin(F.broadcast(totals)).select("source", "n_docs", "chars", rate.alias("rate"))


def poisson_steps(rate: F.Column) -> F.Column:
    """Cumulative Poisson probabilities 0..K, K far in the tail: a table per source, not per row."""
    most = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    terms = F.transform(F.sequence(F.lit(1), most), lambda k: F.log(rate) - F.log(k.cast("double")))
    start = F.struct((-rate).alias("log_p"), F.exp(-rate).alias("total"), F.array(F.exp(-rate)).alias("steps"))
    built = F.aggregate(
        terms, start,
        lambda acc, t: F.struct((acc["log_p"] + t).alias("log_p"), (acc["total"] + F.exp(acc["log_p"] + t)).alias("total"),
                                F.concat(acc["steps"], F.array(acc["total"] + F.exp(acc["log_p"] + t))).alias("steps")),
        lambda acc: acc["steps"])
    return F.when(rate > 0, built).otherwise(F.array(F.lit(1.0)))


def poisson_copies(docs: DataFrame, rates: DataFrame, *, seed: str = SEED) -> DataFrame:
    """``docs`` with ``rate``, ``copies`` (how often each is drawn) and ``copy`` (1..copies), one row
    per copy; documents drawn 0 times give none. Order is not global yet."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in _ADDED])
    names = {n: free_name(docs.columns, n) for n in ("_source", "_steps", "_u")}
    steps = rates.select(F.col("source").alias(names["_source"]), "rate", poisson_steps(F.col("rate")).alias(names["_steps"]))
    steps = Scratch(docs.sparkSession, "mixing").table(steps, "steps")  # written, so that its true size decides the join
    joined = docs.join(steps, docs["source"].eqNullSafe(steps[names["_source"]]))
    u = uniform_hash(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    drawn = joined.withColumn(names["_u"], u).withColumn("copies", F.expr(f"size(filter({names['_steps']}, p -> p <= {names['_u']}))"))
    return drawn.where("copies > 0").withColumn("copy", F.explode(F.expr("sequence(1, copies)"))).drop(*names.values())


def mix_sources(docs: DataFrame, *, epochs: float = 1.0, power: float = 0.7, weights: dict[str, float] | None = None, seed: str = SEED) -> DataFrame:
    """The mixed table: columns of ``docs`` with rate, copies, copy and ``mix_key``, globally shuffled.

    ``mix_key`` is a uniform hash of seed, doc_id, text and copy; partitions are ranges of it and
    sorted, so rows in partition order are a global shuffle. Null texts have no characters and
    draw by their source's rate; rows equal in doc_id and text are drawn alike; an empty table
    stays empty. Columns of those four names, in any letter case, are replaced; others may have any name.
    """
    own = [f"`{c}`" for c in docs.columns if c.lower() not in _ADDED]
    rates = source_rates(docs, epochs=epochs, power=power, weights=weights)
    rows = poisson_copies(docs.select(*own), rates, seed=seed)
    key = uniform_hash(F.lit(seed + "-order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                       F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")), F.col("copy").cast("string"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("mix_key", key).select(*own, "rate", "copies", "copy", "mix_key")
    slice_ = F.least((F.col("mix_key") * n).cast("int"), F.lit(n - 1))
    return rows.repartitionById(n, slice_).sortWithinPartitions("mix_key", "doc_id")
