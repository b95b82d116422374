"""Operator 7: toxicity by nearest labelled examples under exact TF-IDF cosine.

1. A bounded sample of labelled training rows (``EXAMPLES_PER_CLASS`` each, by hash of doc_id)
   spans the vector space: every word of every example is a term, none is left out. (Words of no
   example can't be shared with one and have no weight.)
2. One pass over all documents writes each one's terms with counts; document frequencies for the
   IDF are counted over all of them.
3. A term weighs ``(1 + ln tf) * idf * relevance``. The relevance is ``FLOOR`` plus what the z-score of
   the term's log odds between the classes exceeds 2, so telling words weigh more; without it the
   random words of long documents decide who is near (README has figures).
4. The examples' unit vectors form an inverted index whose postings are grouped in blocks of
   examples with the block's largest weight per term. A query sums those maxima into a bound per
   block, scores blocks from the largest bound down and stops when no block can beat its k-th
   neighbour: exact results.
5. Neighbours vote with weight ``1 / (distance + 0.05)``. The votes become probabilities by isotonic
   regression, weighted to the classes' true shares. The votes it learns from are cross-fitted: each
   half of the examples is searched for its own neighbours under a relevance that the other half
   gave, so no label has a say in its own vote. Documents that share no term with an example get the
   share of such examples.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditspark.llm.scratch import Scratch
from creditspark.llm.shingles import text_slices

EXAMPLES_PER_CLASS = 2500  # labelled rows of each class to learn from
NEIGHBOURS = 10
BLOCK = 5120  # examples in a block of the index, at most; smaller ones seldom spare a document a block (README)
FREQUENT = 16  # terms of at least one in so many examples are scored densely
TOGETHER = 128  # documents whose frequent terms are scored at once
SLICE_BYTES, SLICE_ROWS = 1_000_000, 1_000  # of texts, of term lists, that a worker holds as Python objects at once
FLOOR = 0.1  # relevance of a term that both classes use alike
_WORDS = re.compile(r"\w+")
_ASCII_WORDS = bytes(ord(chr(c).lower()) if c < 128 and re.match(r"\w", chr(c)) else 32 for c in range(256))


def words_of(text: str | None) -> list[str]:
    """The words of the text in lower case, in order; an ASCII text is translated byte by byte, which finds the same."""
    if not text:
        return []
    return text.encode().translate(_ASCII_WORDS).decode().split() if text.isascii() else _WORDS.findall(text.lower())


def relevance(vectors: list, toxic: np.ndarray, n_terms: int) -> np.ndarray:
    """``FLOOR`` plus the excess over 2 of each term's absolute z-score (log odds of its document shares)."""
    found = [np.full(n_terms, 0.5) for _ in (0, 1)]
    for (terms, _), y in zip(vectors, toxic):
        if y in (0, 1):
            np.add.at(found[y], np.asarray(terms, np.int64), 1)
    size = [float((toxic == side).sum()) + 1 for side in (0, 1)]
    z = np.log(found[1] / size[1] * size[0] / found[0]) / np.sqrt(1 / found[1] + 1 / found[0])
    return FLOOR + np.maximum(0, np.abs(z) - 2)


def is_held_out(doc_id) -> F.col:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _end_to_end(vectors: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """All terms, all weights; four bytes hold a term of a bounded sample."""
    lengths = [len(t) for t, _ in vectors]
    term, weight, at = np.empty(sum(lengths), np.int32), np.empty(sum(lengths)), 0
    for (t, w), n in zip(vectors, lengths):
        term[at:at + n], weight[at:at + n] = t, w
        at += n
    return term, weight


class BlockMaxIndex:
    """Exact top-k cosine over sparse unit vectors of a bounded set of examples.

    Terms that at least one in ``FREQUENT`` examples has are kept as dense rows, whose part of the
    cosines is found for many queries at once; a block's bound is the best of that part in the
    block plus the largest weights of the other terms.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        self.size = len(vectors)
        self.width = max(1, min(BLOCK, self.size))
        self.blocks = max(1, -(-self.size // self.width))
        term, weight = _end_to_end(vectors)
        row = np.repeat(np.arange(self.size, dtype=np.int32), [len(t) for t, _ in vectors])
        many = np.bincount(term, minlength=n_terms) * FREQUENT >= max(1, self.size)
        self.place = np.where(many, np.cumsum(many) - 1, -1)  # a frequent term's dense row
        self.dense = np.zeros((int(many.sum()), self.blocks * self.width))
        of = many[term]
        self.dense[self.place[term[of]], row[of]] = weight[of]
        rare = np.flatnonzero(~of)
        order = rare[np.argsort(term[rare], kind="stable")]  # rows rise already
        del of, rare
        self.row, self.weight = row[order], weight[order]
        cell = term[order].astype(np.int64) * self.blocks + self.row // self.width
        del term, weight, row, order
        self.start = np.searchsorted(cell, np.arange(n_terms * self.blocks + 1))
        self.peak = np.zeros(n_terms * self.blocks)
        np.maximum.at(self.peak, cell, self.weight)
        self.peak = self.peak.reshape(n_terms, self.blocks)

    def frequent_part(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """(queries, examples): what the frequent terms add to the cosines."""
        q = np.zeros((len(queries), len(self.dense)))
        for i, (terms, weights) in enumerate(queries):
            place = self.place[terms]
            q[i, place[place >= 0]] = weights[place >= 0]
        return q @ self.dense

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1, frequent: np.ndarray | None = None) -> list[tuple[float, int]]:
        """(cosine, example) of the k nearest with a cosine above 0; ties to the lower number.
        ``frequent`` is the query's row of ``frequent_part``, if the caller has it."""
        if frequent is None:
            frequent = self.frequent_part([(terms, weights)])[0]
        rare = self.place[terms] < 0
        terms, weights = terms[rare], weights[rare]
        base = frequent.reshape(self.blocks, self.width)
        bound = weights @ self.peak[terms] + base.max(axis=1)
        best, at = np.empty(0), np.empty(0, np.int64)  # cosines and examples, nearest first
        cells = terms.astype(np.int64) * self.blocks
        for block in np.argsort(-bound, kind="stable").tolist():
            if bound[block] <= 0 or len(best) == k and bound[block] < best[-1] - 1e-9:
                break
            first = block * self.width
            if len(best) == k and bound[block] <= best[-1] + 1e-9 and first > at[-1]:
                continue
            begin = self.start[cells + block]
            n = self.start[cells + block + 1] - begin
            end = n.cumsum()
            posting = (begin - end + n).repeat(n)
            posting += np.arange(len(posting))
            added = weights.repeat(n)
            added *= self.weight.take(posting)
            row = self.row.take(posting)
            score = base[block] + np.bincount(row - first if first else row, added, minlength=self.width)
            if first <= skip < first + self.width:
                score[skip - first] = 0
            if len(best) < k and self.width > 2 * k:  # what can't be among this block's own k first needn't be sorted
                least = max(0.0, np.partition(score, -k)[-k] - 1e-9)
            else:
                least = best[-1] - 1e-9 if len(best) == k else 0
            found = (score > least).nonzero()[0]
            if not len(found):
                continue
            best, at = np.concatenate((best, np.round(score[found], 12))), np.concatenate((at, first + found))
            keep = np.lexsort((at, -best))[:k]
            best, at = best[keep], at[keep]
        return list(zip(best.tolist(), at.tolist()))


class ToxicityModel:
    """Term weights, index and calibration; plain arrays, broadcast to the tasks."""

    def __init__(self, ids: list, toxic: np.ndarray, vectors: list, idf: np.ndarray, class_weight: dict[int, float]):
        weight = np.array([class_weight.get(int(y), 0.0) for y in toxic])
        base = (weight[toxic == 1].sum() + 0.5) / (weight.sum() + 1.0)
        half = np.arange(len(toxic)) % 2
        votes = np.full(len(toxic), np.nan)
        for side in (0, 1):
            other = np.flatnonzero(half != side)
            self._span(np.flatnonzero(half == side), toxic, vectors, idf * relevance([vectors[i] for i in other], toxic[other], len(idf)))
            for at, (i, unit) in enumerate(self.members):
                vote = self._vote(self.index.nearest(*unit, NEIGHBOURS, skip=at))
                votes[i] = np.nan if vote is None else vote
        known = ~np.isnan(votes)
        self.knots = _isotonic(votes[known], toxic[known], weight[known], base)
        self._span(np.arange(len(toxic)), toxic, vectors, idf * relevance(vectors, toxic, len(idf)))
        used = [i for i, _ in self.members]
        rest = np.ones(len(toxic), bool)
        rest[used] = False
        self.ids = [ids[i] for i in used]
        self.alone = float((weight[rest & (toxic == 1)].sum() + base) / (weight[rest].sum() + 1.0))
        del self.members

    def _span(self, rows: np.ndarray, toxic: np.ndarray, vectors: list, scale: np.ndarray) -> None:
        """Index the given examples under term weights ``scale``; those without a weighing term stay out."""
        self.scale, self.index, self.members = scale, None, []  # one index at a time: the driver has little memory
        for i in rows.tolist():
            terms, weights = self.unit(*vectors[i])
            if len(terms):
                self.members.append((i, (terms.astype(np.int32), weights)))
        self.toxic = toxic[[i for i, _ in self.members]]
        self.index = BlockMaxIndex([u for _, u in self.members], len(scale))

    def unit(self, terms, counts) -> tuple[np.ndarray, np.ndarray]:
        terms = np.asarray(terms, np.int64)
        weight = (1 + np.log(np.asarray(counts, float))) * self.scale[terms] if len(terms) else np.empty(0)
        length = math.sqrt(float(weight @ weight))
        return (terms, weight / length) if length > 0 else (terms[:0], weight[:0])

    def _vote(self, near: list[tuple[float, int]]) -> float | None:
        if not near:
            return None
        weight = np.array([1 / (1.05 - s) for s, _ in near])
        return float(weight @ self.toxic[[i for _, i in near]] / weight.sum())

    def scores(self, counted: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[float, list[tuple[float, int]]]]:
        """(score, nearest examples) of each (terms, counts)."""
        for i in range(0, len(counted), TOGETHER):
            units = [self.unit(terms, counts) for terms, counts in counted[i:i + TOGETHER]]
            for unit, frequent in zip(units, self.index.frequent_part(units)):
                near = self.index.nearest(*unit, NEIGHBOURS, frequent=frequent)
                vote = self._vote(near)
                yield (self.alone if vote is None else float(np.interp(vote, *self.knots))), near


def _isotonic(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray, base: float) -> tuple[np.ndarray, np.ndarray]:
    """Knots (vote, probability) of a rising fit: votes in 20 bins, pooled, a little prior each."""
    cell = np.minimum((votes * 20).astype(int), 19) if len(votes) else np.empty(0, int)
    pools: list[list[float]] = []  # [votes, hits, weight, rows]
    for c in np.unique(cell):
        at = cell == c
        mass = weights[at].sum()
        pools.append([votes[at].mean() * at.sum(), (weights[at] * labels[at]).sum() + base * 0.5, mass + 0.5, at.sum()])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top)]
    if not pools:
        return np.array([0.0, 1.0]), np.array([base, base])
    return np.array([p[0] / p[3] for p in pools]), np.array([min(1.0, max(0.0, p[1] / p[2])) for p in pools])


def term_lists(batches: Iterator[pa.RecordBatch], place: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """The batches with terms and counts in place of ``text``, a slice of the texts at a time."""
    for whole in batches:
        for batch in text_slices([whole], whole.schema.get_field_index("text"), SLICE_BYTES):
            words = [words_of(text) for text in batch.column("text").to_pylist()]
            many = np.fromiter(map(len, words), np.int64, len(words))
            known = map(place.get, chain.from_iterable(words), repeat(-1))
            term = np.fromiter(known, np.int64, int(many.sum()))
            of = np.arange(len(words)).repeat(many)[term >= 0]
            cell, counts = np.unique(of * max(1, len(place)) + term[term >= 0], return_counts=True)  # by row, then term
            row, term = np.divmod(cell, max(1, len(place)))
            offsets = pa.array(np.searchsorted(row, np.arange(len(words) + 1)), pa.int32())
            rest = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            lists = [pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32())) for values in (term, counts)]
            yield pa.RecordBatch.from_arrays([*rest, *lists], [*names, "terms", "counts"])


def list_pairs(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """(terms, counts) of each row, as views of the table's own memory."""
    pairs = []
    for batch in table.to_batches():
        lists = [batch.column(name) for name in ("terms", "counts")]
        flat, offsets = [x.values.to_numpy() for x in lists], [x.offsets.to_numpy() for x in lists]
        pairs += [tuple(f[o[i]:o[i + 1]] for f, o in zip(flat, offsets)) for i in range(batch.num_rows)]
    return pairs


def row_slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def toxicity_scores(docs: DataFrame, labels: DataFrame, key: str | None = None, *, examples_per_class: int = EXAMPLES_PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted, neighbours) for every row of ``docs``.

    ``docs``: doc_id, text; ``labels``: doc_id, toxic (0/1; null rows are ignored, a doc_id labelled
    both ways is toxic, one without a document doesn't count; a repeated doc_id's first text in order
    is the example). At most ``examples_per_class`` rows of each class are examples. Labels are learned only from rows
    that aren't held out (crc32 of the id's digits, mod 5). ``neighbours`` is the evidence: the
    nearest examples' doc_id, label and cosine. Null or empty texts, or such without a word of any
    example, get the score of examples without terms; with no labels at all every score is 0.5.
    Repeated rows are scored alike; other columns are ignored; no documents give no rows. With
    ``key``, a long column of ``docs`` by which the caller knows its rows, the result has it too.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    spark = docs.sparkSession
    rows = docs.select((F.col(key) if key else F.lit(None)).cast("long").alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~is_held_out("doc_id"))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    known = scratch.table(known, "known")
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    sample = None
    for value in (0, 1):
        part = known.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples_per_class)
        sample = part if sample is None else sample.unionByName(part)
    sample = scratch.table(sample, "sample")  # at most 2 * examples_per_class rows, so it may be broadcast
    chosen = rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))
    chosen = scratch.table(chosen, "examples")
    terms = scratch.table(chosen.select("text").mapInArrow(_distinct_words, "term string").distinct(), "terms")
    vocabulary = sorted(terms.toArrow().column("term").to_pylist())  # the words of the sample
    n_terms = len(vocabulary)
    number = spark.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})
    del vocabulary

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return term_lists(batches, number.value)

    table = scratch.table(rows.mapInArrow(vectors, "row_key long, doc_id long, terms array<int>, counts array<int>"), "vectors")
    total = table.count()
    df = np.zeros(n_terms)
    counted = table.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()  # a row per word of the sample
    df[counted.column("t").to_numpy()] = counted.column("count").to_numpy()
    idf = np.log((1 + total) / (1 + df)) + 1e-6
    del counted, df
    seen = chosen.mapInArrow(vectors, "doc_id long, toxic int, terms array<int>, counts array<int>").orderBy("doc_id").toArrow()
    ids, toxic = seen.column("doc_id").to_pylist(), seen.column("toxic").to_numpy().astype(int)
    had = Counter(toxic.tolist())
    weight = {y: totals[y] / had[y] for y in had}
    model = ToxicityModel(ids, toxic, list_pairs(seen), idf, weight)
    scratch.drop("known", "examples", "terms")
    shared = spark.sparkContext.broadcast(model)
    del seen, model  # the workers have it; the driver's Python needn't hold it while they score

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, memory = shared.value, {}
        near_type = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))
        for batch in row_slices(batches):
            if len(memory) > 5_000:
                memory.clear()
            asked, new = [], {}
            for terms, counts in zip(batch.column("terms"), batch.column("counts")):
                terms, counts = terms.values.to_numpy(zero_copy_only=False), counts.values.to_numpy(zero_copy_only=False)
                asked.append(hashlib.blake2b(terms.tobytes() + counts.tobytes(), digest_size=16).digest())
                if asked[-1] not in memory:
                    new[asked[-1]] = terms, counts
            for name, (value, near) in zip(new, m.scores(list(new.values()))):
                memory[name] = value, [{"doc_id": m.ids[i], "toxic": int(m.toxic[i]), "cosine": s} for s, i in near]
            scores, evidence = [memory[name][0] for name in asked], [memory[name][1] for name in asked]
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(evidence, near_type)], ["row_key", "doc_id", "score", "neighbours"])

    result = table.mapInArrow(scored, "row_key long, doc_id long, score double, neighbours array<struct<doc_id: long, toxic: int, cosine: double>>")
    result = scratch.table(result, "scores")
    shared.destroy()  # each executor keeps a file of it
    number.destroy()
    scratch.drop("vectors", "sample")
    return result.select(*([F.col("row_key").alias(key)] if key else []), "doc_id", is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours")


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = {w for text in batch.column("text") for w in words_of(text.as_py())}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(words), pa.string())], ["term"])
