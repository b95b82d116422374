"""Operator 9: embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

Rotations are learned on a bounded sample (PCA to the code's bits, then alternating sign codes and
the orthogonal Procrustes rotation); every vector gets a balanced binary code per rotation. Each
code is cut into substrings, one hash table per substring; vectors of a label that share a key are
candidates, reranked by the cosine of the original vectors in double precision. A bucket is
verified in blocks, so a cluster with a third of all vectors is many tasks; a pair that meets in
several tables counts in the first only. Each vector length has its own rotations and buckets. Keys
grow with log2 of the largest label's vectors, so a bucket's chance members stay few at any size, and
there are as many tables as the wanted recall takes with such keys. Tasks emit link counts and a
spanning forest, no pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditspark.llm.components import connected_components
from creditspark.llm.scratch import Scratch

SAMPLE_VECTORS = 20_000  # vectors that the rotations of a length are learned on, by hash of vec_id
CODE_BITS = 64
SPARE_BITS = 2  # key bits beyond log2 of the vectors: chance members of a bucket, a quarter of a vector
LEAST_BITS = 8
RECALL = 0.995  # share of the pairs at the threshold that some table is to find
PRIOR = 256  # vectors at the origin that a sample's mean is drawn towards
ITERATIONS = 30
BLOCK = 512  # vectors of one side of a block


def table_plan(vectors: int, bits: int, cosine: float, recall: float = RECALL) -> tuple[int, int, int]:
    """(key width, substrings of a code, rotations) for the largest number of vectors of one label.

    Two vectors at angle a agree in a bit with probability 1 - a / pi, in a key with that to the width.
    """
    width = min(bits, max(LEAST_BITS, math.ceil(math.log2(max(2, vectors))) + SPARE_BITS))
    meet = (1 - math.acos(min(1.0, max(-1.0, cosine))) / math.pi) ** width
    tables = max(1, math.ceil(math.log(1 - recall) / math.log1p(-meet))) if meet < 1 else 1
    parts = max(1, bits // width)
    return width, parts, max(2, -(-tables // parts))


def learn_rotations(sample: np.ndarray, bits: int, rotations: int, iterations: int = ITERATIONS):
    """(mean, [projection]) with ``bits`` columns each: PCA, then iterative quantisation per seed.

    The mean is drawn to the origin by ``PRIOR``: centred on their own mean, a few vectors that lie
    close together would get opposite codes.
    """
    mean = sample.sum(axis=0) / (len(sample) + PRIOR)
    centred = sample - mean
    _, vectors = np.linalg.eigh(centred.T @ centred)
    basis = vectors[:, ::-1][:, :bits]
    reduced = centred @ basis
    out = []
    for seed in range(rotations):
        turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(basis.shape[1], basis.shape[1])))
        for _ in range(iterations):
            codes = np.where(reduced @ turn >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(codes.T @ reduced)
            turn = right.T @ left.T
        out.append(basis @ turn)
    return mean, out


def pack_codes(vectors: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Sign codes as unsigned 64-bit integers (fewer bits leave the upper ones 0)."""
    signs = (vectors - mean) @ projection >= 0
    return (signs.astype(np.uint64) << np.arange(signs.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def table_keys(codes: np.ndarray, width: int, parts: int) -> np.ndarray:
    """(n, rotations * parts) keys of ``width`` bits of (n, rotations) codes."""
    low = np.uint64((1 << width) - 1)
    keys = [codes[:, [r]] >> np.uint64(t * width) & low for r in range(codes.shape[1]) for t in range(parts)]
    return np.hstack(keys).astype(np.int64)


def near_vectors(vectors: DataFrame, *, cosine: float = 0.98, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for a table with ``vec_id``, ``embedding``, ``label``.

    Vectors link when their labels are equal and not null and their cosine is at least ``cosine``,
    if a table brings them together. Null, zero or non-finite vectors (or with null components)
    link with nothing; vectors of different lengths don't link with each other. ``kept`` is true for a
    component's smallest vec_id. Rows that repeat a vec_id count as one vector (the usable one that is
    least by label, then embedding) and each gets the result; null vec_ids link with nothing. Empty
    tables give empty results; other columns are ignored. ``recall`` is the share of pairs just at
    ``cosine`` that the tables are laid out to find; closer pairs are found more often, equal ones always.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neardup")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    usable = rows.where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
        & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0))
    usable = usable.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v")).select("vec_id", "v.label", "v.embedding")
    usable = usable.withColumn("dims", F.size("embedding"))
    sizes = {r["dims"]: r["most"] for r in usable.groupBy("dims", "label").count().groupBy("dims").agg(F.max("count").alias("most")).where("most > 1").collect()}
    if not sizes:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    models = {}
    for dims, most in sorted(sizes.items()):
        taken = usable.where(F.col("dims") == dims).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_VECTORS).select("embedding").toPandas()
        width, parts, rotations = table_plan(most, min(CODE_BITS, dims), cosine, recall)
        models[dims] = width, parts, *learn_rotations(_unit(np.stack(taken["embedding"].to_list())), min(CODE_BITS, dims), rotations)
        del taken
    model = spark.sparkContext.broadcast(models)

    def encode(batches):
        for batch in batches:
            widths = batch.column("dims").to_numpy()
            unit, keys = [None] * len(batch), [None] * len(batch)
            for dims in np.unique(widths).tolist():
                at = np.flatnonzero(widths == dims)
                x = _unit(batch.take(pa.array(at)).column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(len(at), dims))
                width, parts, mean, projections = model.value[dims]
                key = table_keys(np.column_stack([pack_codes(x, mean, p) for p in projections]), width, parts)
                for i, u, k in zip(at.tolist(), x, key):
                    unit[i], keys[i] = u, k
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("vec_id", "label", "dims")), pa.array(unit, pa.list_(pa.float64())), pa.array(keys, pa.list_(pa.int64()))],
                ["vec_id", "label", "dims", "unit", "keys"])

    coded = scratch.table(usable.where(F.col("dims").isin(*sizes)).mapInArrow(encode, "vec_id long, label long, dims int, unit array<double>, keys array<long>"), "coded")
    met = coded.select("vec_id", "label", "dims", F.posexplode("keys").alias("t", "key"))
    buckets = met.groupBy("label", "dims", "t", "key").agg(F.count("*").alias("m")).where("m > 1")
    members = met.join(buckets, ["label", "dims", "t", "key"])
    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    members = members.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("vec_id", "t"), F.col("parts")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    members = members.select("vec_id", "t", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"),
                             F.col("label"), F.col("dims"), F.col("key"))

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["vec_id"].to_numpy()
        unit = np.stack(pdf["unit"].to_list())
        keys = np.stack(pdf["keys"].to_list())
        part, t = pdf["part"].to_numpy(), int(pdf["t"].iloc[0])
        lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
        left, right = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
        links = np.zeros(len(ids), np.int64)
        if not len(left) or not len(right):
            return pd.DataFrame({"vec_id": [], "n": [], "to": []}, dtype="int64")
        near = unit[left] @ unit[right].T >= cosine
        if lo == hi:
            near &= ~np.eye(len(left), dtype=bool)
        at = np.argwhere(near)
        a, b = left[at[:, 0]], right[at[:, 1]]
        if len(a) and t:
            first = ~(keys[a, :t] == keys[b, :t]).any(axis=1)
            a, b = a[first], b[first]
        np.add.at(links, a, 1)
        if lo != hi:
            np.add.at(links, b, 1)
        to = _local_roots(a, b, ids)
        keep = (links > 0) | (to != ids)
        return pd.DataFrame({"vec_id": ids[keep], "n": links[keep], "to": to[keep]})

    found = (members.join(coded.select("vec_id", "unit", "keys"), "vec_id").groupBy("label", "dims", "t", "key", "lo", "hi")
             .applyInPandas(verify, "vec_id long, n long, to long"))
    found = scratch.table(found, "found")
    roots = connected_components(scratch, found.select(F.col("vec_id").alias("u"), F.col("to").alias("v")), "links")
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    result = (rows.select("vec_id").join(counts, "vec_id", "left").join(roots, F.col("vec_id") == roots.node, "left")
              .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id")))
    scratch.drop("coded")
    return result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, scaled by their largest component first so that squares stay finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _local_roots(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id of each row's component within the block."""
    root = ids.copy()
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        if (root == before).all():
            break
    return root
