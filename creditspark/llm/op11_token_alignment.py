"""Operator 11: alignment of two tokenizers' tokens by merge-path partitioning.

Both tokenizers give every byte of ``space + text`` to one token. The byte offsets where tokens of
both end cut the tokens into groups; the tokens of a group are linked with each other.

The ends of the A tokens and of the B tokens are two sorted lists. A binary search along each of a
number of diagonals of their merge finds where equal shares of the merge begin, so pieces of equal work
are merged on their own, whatever lengths the texts have. A piece numbers its tokens by the common
ends before them; the group that is open at its end goes on in the next piece, so the pieces' numbers
are stitched into groups by adding the common ends of the pieces before.

Neither vocabulary has a token across white space that follows other characters, but for carriage
returns (checked when loading), so texts are cut there into parts. Parts recur: each worker aligns a new part once and
remembers it. The tables that follow are made of batches of documents:

* a document is a list of the batch's distinct parts; a batch lists its distinct id pairs and how many of
  its documents hold each, so that what is shuffled grows with distinct pairs of batches, not with links;
* pairs are counted over all batches, and the counts go back to the batches that asked for them;
* a batch and its counts meet in one task, which gives the documents' sums. A batch has a bounded size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditspark.llm.op13_prefix_bpe import parts, shared_encoder, sliced, spread
from creditspark.llm.scratch import Scratch

WORK = 1 << 16  # ends that a piece of the merge has
_REMEMBERED = 100_000  # parts that a worker may remember when it begins a batch
_LEARN_BYTES, _BATCH_BYTES, _BATCH_ROWS = 2_000_000, 6_000_000, 20_000  # text looked up together; text and rows of a batch
_COMMON = 1 << 16  # parts of a batch that take two bytes in its documents' lists
_SMALL_GROUP = 4096  # links of a group that are written out before they are counted
_SPACE = "▁"  # what stands for a space in the pieces
_ACROSS = re.compile(r"\S[^\S\r]")  # no piece may have this; pieces with a carriage return after other characters exist
_CUT = re.compile(r"(?<=\S)(?=[ \t\n\x0b\x0c])")
_ALIGNERS: dict[int, "Aligner"] = {}


def cut_text(text: str) -> list[str]:
    """Space + text in parts whose borders no token of either vocabulary crosses; no text has no parts."""
    if not text:
        return []
    return _CUT.split(f" {text}") if "\r" in text else parts(f" {text}")


def merge_path(ends_a: np.ndarray, ends_b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces of about ``work`` ends of the merge of two sorted lists begin: places in A and in B.

    On the diagonal i + j = d the cut is the largest i for which A's first i ends come before (or are equal
    to) B's ends from j on. Equal ends stay in one piece.
    """
    n_a, n_b = len(ends_a), len(ends_b)
    diagonal = np.append(np.arange(0, n_a + n_b, work), n_a + n_b)
    low, high = np.maximum(0, diagonal - n_b), np.minimum(diagonal, n_a)
    while (low < high).any():
        middle = (low + high) // 2
        inside = low < high
        # The end after `middle` ends of A belongs before the cut if it isn't above the last end of B before it.
        before = np.zeros(len(diagonal), bool)
        before[inside] = ends_a[middle[inside]] <= ends_b[diagonal[inside] - middle[inside] - 1]
        low = np.where(inside & before, middle + 1, low)
        high = np.where(inside & ~before, middle, high)
    cut_a, cut_b = low, diagonal - low
    twin = np.flatnonzero((cut_a > 0) & (cut_b < n_b))
    cut_b[twin] += ends_a[cut_a[twin] - 1] == ends_b[cut_b[twin]]
    return cut_a, cut_b


def merge_piece(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of one piece: the number of common ends before each A token's end, the same for B, and of all."""
    at = np.searchsorted(ends_b, ends_a)
    common = np.zeros(len(ends_a), bool)
    if len(ends_b):
        common = ends_b[np.minimum(at, len(ends_b) - 1)] == ends_a
    closed = np.zeros(len(ends_b), np.int64)
    closed[at[common]] = 1
    return np.cumsum(common) - common, np.cumsum(closed) - closed, int(common.sum())


def token_groups(ends_a: np.ndarray, ends_b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A token and of each B token: pieces merged on their own, then stitched."""
    cut_a, cut_b = merge_path(ends_a, ends_b, work)
    group_a, group_b, before = np.empty(len(ends_a), np.int64), np.empty(len(ends_b), np.int64), 0
    for a, a_to, b, b_to in zip(cut_a[:-1], cut_a[1:], cut_b[:-1], cut_b[1:]):
        of_a, of_b, many = merge_piece(ends_a[a:a_to], ends_b[b:b_to])
        group_a[a:a_to], group_b[b:b_to] = of_a + before, of_b + before
        before += many
    return group_a, group_b


class Parts(NamedTuple):
    """Aligned parts of texts; ``pair_from`` has one place more than there are parts."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    whole: np.ndarray  # whether both tokenizers' bytes are the part's
    pair_from: np.ndarray
    pairs: np.ndarray  # a << 32 | b, distinct within a part
    times: np.ndarray
    text: list[str]  # the groups as `a1,a2|b1;`


class Aligner:
    """Aligns byte-level BPE (A) with a SentencePiece model (B); remembers parts."""

    def __init__(self, vocabulary: str, model: bytes):
        import sentencepiece

        self.a = shared_encoder(vocabulary, special=False)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(_ACROSS.search(p.replace(_SPACE, " ")) for p in pieces):
            raise ValueError("pieces across white space can't be cut into parts")
        self.prefix = self.b.piece_to_id(_SPACE)
        if self.b.encode("\n")[:1] != [self.prefix]:
            raise ValueError("the model must put a space before texts")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.size_b = np.array([len(p) for p in self.bytes_b], np.int64)
        self.decimal_b = [str(i) for i in range(len(pieces))]
        self.index: dict[str, int] = {}
        self._chunks: list[Parts] = []

    def _encode_b(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        spaced = [p[0] == " " for p in new]  # the model puts a space before each text itself
        found = self.b.encode([p[1:] if s else p for p, s in zip(new, spaced)], num_threads=1)
        found = [(ids or [self.prefix]) if s else ids[1:] for ids, s in zip(found, spaced)]  # it leaves an empty text without one
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.int64, int(counts.sum())), counts

    def align(self, new: list[str], work: int = WORK) -> Parts:
        """Align parts (not empty, cut as by ``cut_text``), all at once."""
        a, n_a = self.a.encode_parts(new)
        a = a.astype(np.int64)
        b, n_b = self._encode_b(new)
        raw = [p.encode() for p in new]
        whole = self._same_bytes(raw, b, n_b)
        if not whole.all():  # such parts count as having no tokens
            a, b = a[np.repeat(whole, n_a)], b[np.repeat(whole, n_b)]
            n_a, n_b = n_a * whole, n_b * whole
        group_a, group_b = token_groups(np.cumsum(self.a.size[a]), np.cumsum(self.size_b[b]), work)
        total = int(group_a[-1]) + 1 if len(group_a) else 0
        of_part = np.repeat(np.arange(len(new)), n_a)
        part = np.zeros(total, np.int64)
        part[group_a] = of_part
        each_a, each_b = np.bincount(group_a, minlength=total), np.bincount(group_b, minlength=total)
        n_groups = np.bincount(part, minlength=len(new)) if total else np.zeros(len(new), np.int64)
        n_links = np.bincount(part, each_a * each_b, len(new)).astype(np.int64) if total else np.zeros(len(new), np.int64)
        pairs, times, pair_from = self._pairs(a, b, each_a, each_b, part, len(new))
        return Parts(n_a, n_b, n_groups, n_links, whole, pair_from, pairs, times, self._texts(a, b, group_a, group_b, part, len(new)))

    def _same_bytes(self, raw: list[bytes], b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """Byte-level tokens always hold a part's bytes; here, whether B's do."""
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(n_b)
        upto = np.concatenate(([0], np.cumsum(self.size_b[b])))
        joined = b"".join(map(self.bytes_b.__getitem__, b.tolist()))
        start, stop = upto[ends - n_b], upto[ends]
        same = stop - start == sizes
        if same.all() and joined == b"".join(raw):
            return same
        return np.array([joined[s:e] == r for r, s, e in zip(raw, start.tolist(), stop.tolist())], bool)

    @staticmethod
    def _pairs(a, b, each_a, each_b, part, parts_) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct id pairs of each part with how often they are linked."""
        from_a, from_b = np.cumsum(each_a) - each_a, np.cumsum(each_b) - each_b
        links = each_a * each_b
        small = np.flatnonzero(links <= _SMALL_GROUP)
        inside = spread(np.zeros(len(small), np.int64), links[small])
        of = np.repeat(small, links[small])
        code = [a[from_a[of] + inside // each_b[of]] << 32 | b[from_b[of] + inside % each_b[of]]]
        where, times = [part[of]], [np.ones(len(of), np.int64)]
        for g in np.flatnonzero(links > _SMALL_GROUP).tolist():
            ids_a, many_a = np.unique(a[from_a[g]:from_a[g] + each_a[g]], return_counts=True)
            ids_b, many_b = np.unique(b[from_b[g]:from_b[g] + each_b[g]], return_counts=True)
            code.append((ids_a[:, None] << 32 | ids_b).ravel())
            times.append((many_a[:, None] * many_b).ravel())
            where.append(np.full(len(code[-1]), part[g]))
        code, where, times = map(np.concatenate, (code, where, times))
        order = np.lexsort((code, where))
        code, where, times = code[order], where[order], times[order]
        first = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (where[1:] != where[:-1])))[:len(code)])
        times = np.add.reduceat(times, first) if len(first) else times
        counts = np.bincount(where[first], minlength=parts_)
        return code[first], times, np.concatenate(([0], np.cumsum(counts)))

    def _texts(self, a, b, group_a, group_b, part, parts_) -> list[str]:
        ids = [*map(self.a.decimal_of.__getitem__, a.tolist()), *map(self.decimal_b.__getitem__, b.tolist())]
        group, side = np.concatenate((group_a, group_b)), np.repeat([0, 1], [len(a), len(b)])
        order = np.argsort(group * 2 + side, kind="stable")
        group, side = group[order], side[order]
        same = group[1:] == group[:-1]
        between = np.where(same, np.where(side[1:] == side[:-1], 0, 1), 2)
        marks = [",|;"[k] for k in np.append(between, 2)[:len(ids)].tolist()]
        shown = [ids[k] for k in order.tolist()]
        ends = np.cumsum(np.fromiter(map(len, shown), np.int64, len(shown)) + 1)
        joined = "".join([x for pair in zip(shown, marks) for x in pair])
        last = np.bincount(part[group], minlength=parts_).cumsum() if len(group) else np.zeros(parts_, np.int64)
        upto = np.concatenate(([0], ends))[last].tolist()
        return [joined[s:e] for s, e in zip([0, *upto], upto)]

    def begin_batch(self) -> None:
        if len(self.index) > _REMEMBERED:
            self.index.clear()
            self._chunks.clear()

    def look_up(self, lists: list[list[str]]) -> list[np.ndarray]:
        """The numbers of the parts of each list, valid until the next batch begins."""
        new = set()
        for found in lists:
            new |= set(found).difference(self.index)
        if new:
            new = list(new)
            self._chunks.append(self.align(new))
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
        return [np.fromiter(map(self.index.__getitem__, found), np.int64, len(found)) for found in lists]

    def known(self) -> Parts:
        """All remembered parts, by their numbers."""
        if len(self._chunks) > 1:
            c = self._chunks
            offsets = np.cumsum([0, *(len(x.pairs) for x in c)])
            pair_from = np.concatenate([x.pair_from[:-1] + o for x, o in zip(c, offsets)] + [offsets[-1:]])
            plain = {f: np.concatenate([getattr(x, f) for x in c]) for f in ("n_a", "n_b", "n_groups", "n_links", "whole", "pairs", "times")}
            self._chunks = [Parts(**plain, pair_from=pair_from, text=[t for x in c for t in x.text])]
        return self._chunks[0] if self._chunks else self.align([])


def shared_aligner(vocabulary: str, model: bytes) -> Aligner:
    key = hash((vocabulary, model))
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(vocabulary, model)
    return _ALIGNERS[key]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _numbers(aligner: Aligner, texts: list[str]) -> list[np.ndarray]:
    """The parts of each text; of no text, and of one that the tokenizers don't give back, none."""
    found = aligner.look_up([cut_text(t) for t in texts])
    whole = aligner.known().whole
    return [n if whole[n].all() else n[:0] for n in found]


def align_documents(docs: DataFrame, vocabulary: str, model: bytes) -> DataFrame:
    """(doc_id, groups array<struct<a array<int>, b array<int>>>) of every row's whole text.

    ``vocabulary`` is A's JSON and ``model`` B's file, so workers need no files. Null and empty texts, and such
    whose A or B bytes differ from space + text, have no groups. Every row, also a repeated one or one with a null
    id, gives one row; other columns are ignored; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, model))  # two vocabularies: they don't grow with the data
    kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = shared_aligner(*shared.value)
        for batch in batches:
            for piece in sliced(batch, _BATCH_ROWS, _LEARN_BYTES):
                aligner.begin_batch()
                numbers = _numbers(aligner, piece.column(1).to_pylist())
                text = aligner.known().text
                rows = [[{"a": [int(i) for i in a.split(",")], "b": [int(i) for i in b.split(",")]}
                         for n in own.tolist() for a, b in (g.split("|") for g in text[n][:-1].split(";"))] for own in numbers]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(rows, kind)], ["doc_id", "groups"])

    return _texts(docs).mapInArrow(run, "doc_id long, groups array<struct<a array<int>, b array<int>>>")


_BATCH_SCHEMA = ("batch long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, parts binary, rare binary, "
                 "pairs binary, holders binary, part_pairs binary, pair_places binary, pair_times binary")
_BATCH_TYPES = [pa.int64()] * 6 + [pa.string()] + [pa.binary()] * 7
_BATCH_NAMES = [c.split()[0] for c in _BATCH_SCHEMA.split(", ")]


def aligned_batches(docs: DataFrame, vocabulary: str, model: bytes) -> DataFrame:
    """A row per document, and per batch one with its distinct pairs (``pairs`` isn't null there).

    ``parts`` (u2) and ``rare`` (u4) are places in the batch's list of distinct parts, common ones first; a part has the next ``part_pairs`` (u4) of
    ``pair_places`` (u4, places in ``pairs``, i8) ``pair_times`` (u4) often; ``holders`` (u4) counts documents.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = shared_aligner(*shared.value)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in sliced(batch, _BATCH_ROWS, _BATCH_BYTES):
                aligner.begin_batch()
                numbers: list[np.ndarray] = []
                for some in sliced(piece, _BATCH_ROWS, _LEARN_BYTES):
                    numbers += _numbers(aligner, some.column(1).to_pylist())
                yield _batch_rows(number, piece.column(0).to_pylist(), numbers, aligner.known())
                number += 1

    return _texts(docs).mapInArrow(run, _BATCH_SCHEMA)


def _distinct(ordered: np.ndarray) -> np.ndarray:
    return ordered[np.concatenate(([True], ordered[1:] != ordered[:-1]))[:len(ordered)]]


def _batch_rows(number: int, doc_ids: list, numbers: list[np.ndarray], known: Parts) -> pa.RecordBatch:
    sizes = np.fromiter(map(len, numbers), np.int64, len(numbers))
    used, place, often = np.unique(np.concatenate([*numbers, np.empty(0, np.int64)]), return_inverse=True, return_counts=True)
    order = np.argsort(-often, kind="stable")
    new = np.empty(len(used), np.int64)
    new[order] = np.arange(len(used))
    used = used[order]
    first, many = known.pair_from[used], np.diff(known.pair_from)[used]
    at = spread(first, many)
    pairs, pair_place = np.unique(known.pairs[at], return_inverse=True)
    held = np.repeat(np.arange(len(numbers)) * max(1, len(used)), sizes) + new[place]  # a document's parts, in order
    held.sort()
    place = held % max(1, len(used))
    # Documents that hold a pair: distinct (document, part), then distinct (document, pair).
    held = _distinct(held)
    part, doc = held % max(1, len(used)), held // max(1, len(used))
    both = np.repeat(doc * len(pairs), many[part])
    both += pair_place[spread((np.cumsum(many) - many)[part], many[part])]
    both.sort()
    holders = np.bincount(_distinct(both) % max(1, len(pairs)), minlength=len(pairs))

    rare = place >= _COMMON
    n_rare = np.concatenate(([0], np.cumsum(rare)))[np.concatenate(([0], np.cumsum(sizes)))]
    rare_borders, borders = (4 * n_rare).tolist(), (2 * (np.concatenate(([0], np.cumsum(sizes))) - n_rare)).tolist()
    places, rare_places = place[~rare].astype("<u2").tobytes(), place[rare].astype("<u4").tobytes()
    sums = lambda c: [int(c[n].sum()) for n in numbers]
    text = known.text
    digests = [hashlib.sha256("".join(map(text.__getitem__, n.tolist()))[:-1].encode()).hexdigest() if len(n) else "" for n in numbers]
    of_batch = [pairs.astype("<i8"), holders.astype("<u4"), many.astype("<u4"), pair_place.astype("<u4"), known.times[at].astype("<u4")]
    rows = len(numbers)
    columns = [[number] * (rows + 1), doc_ids + [None], *(sums(c) + [None] for c in (known.n_a, known.n_b, known.n_groups, known.n_links)),
               digests + [None], [places[a:b] for a, b in zip(borders, borders[1:])] + [None],
               [rare_places[a:b] for a, b in zip(rare_borders, rare_borders[1:])] + [None], *([None] * rows + [x.tobytes()] for x in of_batch)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _BATCH_TYPES)], _BATCH_NAMES)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, pairs, holders in zip(*(batch.column(k).to_pylist() for k in range(3))):
            code = np.frombuffer(pairs, "<i8")
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(code), number)), pa.array(code >> 32, pa.int32()), pa.array(code & 0xFFFFFFFF, pa.int32()),
                 pa.array(np.frombuffer(holders, "<u4").astype(np.int64))], ["batch", "a", "b", "holders"])


def batch_pairs(batches: DataFrame) -> DataFrame:
    """(batch, a, b, holders): each batch's distinct pairs and how many of its documents hold them."""
    return batches.where("pairs is not null").select("batch", "pairs", "holders").mapInArrow(_unpacked, "batch long, a int, b int, holders long")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, n, best): how many documents hold the pair linked, and whether no pair of that A id has more.

    The best counts are one row for each id of A's vocabulary at most, so they may be broadcast.
    """
    counts = pairs.groupBy("a", "b").agg(F.sum("holders").alias("n"))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _sum_up(documents: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of a batch with the sums over their links."""
    row = next(r for r in documents.select(_BATCH_NAMES[9:]).to_pylist() if r["pairs"] is not None)
    pairs, _, many, place, times = (np.frombuffer(row[c], t) for c, t in zip(_BATCH_NAMES[9:], ("<i8", *["<u4"] * 4)))
    code = counts.column("a").to_numpy().astype(np.int64) << 32 | counts.column("b").to_numpy()
    order = np.argsort(code)
    if len(order) != len(pairs) or (code[order] != pairs).any():
        raise ValueError("a batch needs the counts of all its pairs, once each")
    upto = np.concatenate(([0], np.cumsum(many, dtype=np.int64)))
    own = {}
    for name, column in (("count_sum", "n"), ("n_best", "best")):
        each = counts.column(column).to_numpy(zero_copy_only=False).astype(np.int64)[order][place] * times
        own[name] = np.diff(np.concatenate(([0], np.cumsum(each)))[upto])
    documents = documents.filter(pa.compute.is_valid(documents.column("parts")))
    held = [np.concatenate((np.frombuffer(p, "<u2"), np.frombuffer(r, "<u4")))
            for p, r in zip(documents.column("parts").to_pylist(), documents.column("rare").to_pylist())]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    sums = {k: pa.array([int(v[h].sum()) for h in held], pa.int64()) for k, v in own.items()}
    return pa.table({**{n: documents.column(n) for n in names}, **sums, "groups_sha256": documents.column("groups_sha256")})


def alignment_digests(docs: DataFrame, vocabulary: str, model: bytes) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    ``n_best`` counts a document's links whose pair has its A id's highest count (``pair_counts``),
    ``count_sum`` adds up the counts of all its links. Rows are treated as in ``align_documents``; of a document
    without tokens all numbers are 0 and the digest is ''.
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    batches = scratch.table(aligned_batches(docs, vocabulary, model), "batches")
    pairs = batch_pairs(batches)
    counts = scratch.table(pair_counts(pairs), "counts")
    asked = pairs.select("batch", "a", "b").join(counts, ["a", "b"]).select("batch", "a", "b", "n", "best")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, count_sum long, n_best long, groups_sha256 string"
    found = batches.groupBy("batch").cogroup(asked.groupBy("batch")).applyInArrow(_sum_up, schema)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
