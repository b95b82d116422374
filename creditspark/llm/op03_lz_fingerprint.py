"""Operator 3: Lempel-Ziv phrase fingerprints.

A text is parsed into LZ78 dictionary phrases (each the shortest string that isn't a phrase yet);
its fingerprint is a one-permutation minimum-hash signature of the phrase set. The share of equal
signature places estimates the phrase sets' Jaccard similarity, which is high for texts that would
compress well together.

``edited_fingerprints`` also fingerprints every text with its tail replaced by the head of the
next document, and compares neighbours. Documents move once, to buckets of consecutive ids; the
first document of a bucket also goes to the bucket before it, so every task streams its rows in
order with one text of look-ahead. What the driver sees is bounded by the number of buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACES = 128  # minimum hashes of a signature, 32 bits each
_EMPTY = np.uint32(0xFFFFFFFF)


class PhraseParse:
    """LZ78 phrases of a text; ``mark`` remembers the state at one position of it."""

    def __init__(self, text: str, mark: int):
        self.phrases: set[str] = set()
        start = self._run(text, 0, 0, mark, self.phrases)
        self.tail: set[str] = set()
        self._mark_start = start
        self.head = _hashes(self.phrases)
        self._run(text, start, mark, len(text), self.tail)
        self.signature = _signature(np.concatenate((self.head, _hashes(self.tail))))
        self._mark = mark

    def _run(self, text: str, start: int, at: int, end: int, new: set[str]) -> int:
        """Parse ``text[at:end]`` with the open phrase at ``start``; the next open phrase's start."""
        old, add = self.phrases, new.add
        for stop in range(at + 1, end + 1):
            phrase = text[start:stop]
            if phrase not in old and phrase not in new:
                add(phrase)
                start = stop
        return start

    def edited(self, text: str) -> np.ndarray:
        """Signature of ``text``, which equals the parsed one up to the mark."""
        tail: set[str] = set()
        self._run(text, self._mark_start, self._mark, len(text), tail)
        return _signature(np.concatenate((self.head, _hashes(tail))))


def _hashes(phrases: set[str]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(p) for p in phrases), np.uint64, len(phrases))


def _signature(hashes: np.ndarray) -> np.ndarray:
    out = np.full(PLACES, _EMPTY, np.uint32)
    value = np.minimum((hashes >> np.uint64(32)).astype(np.uint32), _EMPTY - np.uint32(1))
    np.minimum.at(out, (hashes % np.uint64(PLACES)).astype(np.int64), value)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of two phrase sets; 1 for two empty ones."""
    used = (a != _EMPTY) | (b != _EMPTY)
    return float((a == b)[used].mean()) if used.any() else 1.0


def _hex(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Documents are ordered by (doc_id, text), null ids last, null texts as empty ones; after the
    last comes the first, and a single row is its own next. The edited text replaces the last
    ``n_chars div 4`` code points by the first as many (or all) of the next text. Every row, also
    a repeated one, gives one row; other columns are ignored; an empty table gives none.
    """
    spark = docs.sparkSession
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    last = (1 << 63) - 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("_key", F.coalesce("doc_id", F.lit(last))).withColumn("_at", F.col("_key").cast("double"))
    cuts = sorted(set(rows.select("_at").approxQuantile("_at", [i / buckets for i in range(1, buckets)], 0.1 / buckets))) if buckets > 1 else []
    placed = rows.withColumn("bucket", F.lit(0))
    if cuts:
        splits = [-float("inf"), *cuts, float("inf")]
        placed = Bucketizer(splits=splits, inputCol="_at", outputCol="_bucket").transform(rows)
        placed = placed.withColumn("bucket", F.col("_bucket").cast("int"))
    firsts = sorted((r["bucket"], r["first"]) for r in placed.groupBy("bucket").agg(F.min("_key").alias("first")).collect())
    ahead = spark.createDataFrame([(key, firsts[i - 1][0]) for i, (_, key) in enumerate(firsts)], "_first long, _before int")
    placed = placed.join(F.broadcast(ahead), placed._key == ahead._first, "left")
    placed = placed.withColumn("_to", F.explode(F.when(F.col("_before").isNull(), F.array(F.struct(F.col("bucket"), F.lit(False).alias("ahead"))))
                                                .otherwise(F.array(F.struct(F.col("bucket"), F.lit(False).alias("ahead")), F.struct(F.col("_before").alias("bucket"), F.lit(True).alias("ahead"))))))
    placed = placed.select("_to.bucket", "_to.ahead", "_key", "doc_id", "text")
    placed = placed.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "ahead", "_key", "text")
    return placed.select("bucket", "ahead", "doc_id", "text").mapInArrow(
        _stream, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held = None  # (doc_id, text, parse) that waits for its next document
    rows: list[list] = [[] for _ in names]
    for batch in batches:
        for ahead, doc_id, text in zip(batch.column("ahead"), batch.column("doc_id"), batch.column("text")):
            ahead, doc_id, text = ahead.as_py(), doc_id.as_py(), text.as_py()
            if ahead and held is None:
                continue  # further copies of the look-ahead row
            parse = PhraseParse(text, len(text) - len(text) // 4)
            if held is not None:
                own_id, own, own_parse = held
                keep = len(own) - len(own) // 4
                edited = own[:keep] + text[:len(own) - keep]
                signature = own_parse.edited(edited)
                values = (own_id, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), _hex(own_parse.signature),
                          _hex(signature), likeness(own_parse.signature, signature), likeness(own_parse.signature, parse.signature))
                for col, value in zip(rows, values):
                    col.append(value)
            held = None if ahead else (doc_id, text, parse)
            if len(rows[0]) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names)
                rows = [[] for _ in names]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names)
