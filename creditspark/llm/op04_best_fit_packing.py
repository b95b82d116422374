"""Operator 4: best-fit packing planned over the histogram of piece lengths.

Texts become token ids plus an end id; only longer ones are cut, into pieces of the capacity. The
plan is made over counts: lengths from long to short, each count poured into the groups of equal
open sequences with the smallest sufficient room, else into new sequences. Plan rows depend on the
number of distinct lengths (at most the capacity), not on documents. Pieces then take planned
slots by joining on their rank within their length; ranks come from salted counts, so a length
that a third of all pieces share is spread over many tasks.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditspark.llm.scratch import Scratch

CAPACITY, END_ID = 4096, 1
_CACHE_WORDS = 300_000  # chunks whose ids a worker remembers; more start the memory anew
_BATCH_CHARS = 1_500_000  # texts encoded together
_RUN_CUT = r"(?:\A|[^\p{L}\p{N}])[,.][ \n]"  # a stop that does not follow a letter or digit
_LETTERS = re.compile("[a-zß-öø-ÿ]+").fullmatch
_ROWS_PER_SALT, _MOST_SALTS = 5_000, 4096  # rows of a salt where few salts suffice; more rows share the most salts
_ENCODERS: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Token ids of texts, equal to encoding each whole, with a memory of chunks.

    For tokenizers that split at white space, drop it, lower-case, and part letters and digits
    from runs of other marks. A text of Latin-1 characters is then its lower-cased white-space
    chunks, and a comma or full stop after a letter or digit may stand apart; Arrow finds a
    batch's distinct chunks, and only those not met before are encoded. Chunks of small Latin
    letters skip the tokenizer's normal form; the others are encoded with a mark of its own id
    between them. Other texts, and such that may hold special tokens, are encoded whole.
    """

    mark = "\x01"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        special = "".join(f"|{re.escape(t.content)}" for t in self.tokenizer.get_added_tokens_decoder().values())
        self.odd = r"[^\x00-\x{FF}]|[\x01\x1c-\x1f\x{85}\x{A0}]" + special
        self.light = Tokenizer(self.tokenizer.model)  # without normalizer or added tokens; both share one model in memory
        self.light.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        suffix = self.tokenizer.model.end_of_word_suffix
        self.last[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.mark_id = self._ids(self.tokenizer, self.mark)
        if len(self.mark_id) != 1 or not self.last.any():
            raise ValueError("the tokenizer needs word ends and a single id for U+0001")
        self.known: dict[str, bytes] = {"": b""}

    @staticmethod
    def _ids(tokenizer, text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of new chunks, remembered from now on."""
        plain = [w for w in words if _LETTERS(w)]
        others = set(words).difference(plain)
        learned = dict(self._cut(plain, ids := self._ids(self.light, " ".join(plain)), np.flatnonzero(self.last[ids]) + 1, 0))
        ids = self._ids(self.tokenizer, f" {self.mark} ".join(others))
        learned.update(self._cut(others, ids, np.append(np.flatnonzero(ids == self.mark_id[0]), len(ids)), 1))
        if len(self.known) + len(learned) > _CACHE_WORDS:
            self.known = {"": b""}
        self.known.update(learned)
        return [learned[w] for w in words]

    @staticmethod
    def _cut(words, ids: np.ndarray, ends: np.ndarray, between: int) -> Iterator[tuple[str, bytes]]:
        raw, ends = ids.tobytes(), (4 * ends).tolist()
        starts = [0, *(e + 4 * between for e in ends[:-1])]
        return zip(words, (raw[a:b] for a, b in zip(starts, ends)))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        low = pc.utf8_lower(pc.if_else(pa.array(odd), "", texts))
        apart = low
        for stop in (", ", ". ", ".\n", ",\n"):
            apart = pc.replace_substring(apart, stop, f" {stop}")
        chunks = pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(low, _RUN_CUT), low, apart))
        found = chunks.flatten().dictionary_encode()
        words = found.dictionary.to_pylist()
        ids = list(map(self.known.get, words))
        fresh = [i for i, b in enumerate(ids) if b is None]
        if fresh:
            for i, b in zip(fresh, self._learn([words[i] for i in fresh])):
                ids[i] = b
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(sizes) - sizes
        at = found.indices.to_numpy()
        lengths = sizes[at]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        flat = np.frombuffer(b"".join(ids), "<u4")[np.repeat(starts[at] - ends[:-1], lengths) + np.arange(ends[-1])] if len(at) else np.empty(0, "<u4")
        offsets = np.asarray(chunks.offsets)
        bounds = ends[offsets - offsets[0]]
        out = [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        for i in np.flatnonzero(odd).tolist():
            out[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4")
        return out


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, end_id: int = END_ID,
                 with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document's tokens and end id.

    A null text counts as empty (one piece, the end id); a null doc_id stays null; every row of a
    repeated doc_id gives its own pieces. ``tokenizer_path`` must exist on every worker.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            weight = np.cumsum(pc.binary_length(texts).to_numpy())
            first = 0
            while first < len(texts):
                done = weight[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(weight, done + _BATCH_CHARS, "right")))
                rows: list[list] = [[] for _ in names]
                doc_ids = batch.column(0).slice(first, last - first).to_pylist()
                for doc_id, ids in zip(doc_ids, encoder.encode(texts.slice(first, last - first))):
                    ids = np.append(ids, np.array([end_id], "<u4"))
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start:start + capacity]
                        values = [doc_id, piece, start, len(part), zlib.crc32(part.tobytes())]
                        if with_ids:
                            values.append(part.astype(np.int32))
                        for col, value in zip(rows, values):
                            col.append(value)
                yield _piece_batch(rows, names)
                first = last

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pieces, schema)


def _piece_batch(rows: list[list], names: list[str]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names)


def plan_slots(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a length histogram.

    Rows (length, rank_from, sequences, each, first_sequence, offset): the pieces of that length
    with ranks from ``rank_from`` fill ``sequences`` consecutive sequences, ``each`` of them per
    sequence, one after the other from ``offset``. Lengths outside 1..capacity are an error.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> [(first sequence, how many)]
    rooms: list[int] = []  # sorted keys of room
    plan, used = [], 0

    def open_(left: int, first: int, many: int) -> None:
        if many and left:
            if left not in room:
                bisect.insort(rooms, left)
            room.setdefault(left, []).append((first, many))

    for length in sorted(counts, reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit {capacity}")
        rank, rest = 0, counts[length]
        while rest:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                left = rooms[at]
                first, many = room[left].pop()
                if not room[left]:
                    del room[left], rooms[at]
            else:
                left, first, many = capacity, used, -(-rest // (capacity // length))
                used += many
            each = left // length
            full = min(many, rest // each)
            if full:
                plan.append((length, rank, full, each, first, capacity - left))
                open_(left - each * length, first, full)
                rank, rest = rank + full * each, rest - full * each
            if full < many and rest:  # fewer than `each` are left: one sequence takes them
                plan.append((length, rank, 1, rest, first + full, capacity - left))
                open_(left - rest * length, first + full, 1)
                full, rank, rest = full + 1, rank + rest, 0
            open_(left, first + full, many - full)
    return plan


def place_pieces(scratch: Scratch, pieces: DataFrame, *, capacity: int = CAPACITY, ties: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """``pieces`` (a written table with ``length``) with ``sequence_id`` and ``offset``.

    ``ties`` are columns that tell apart rows of one length; rows equal in all of them may swap
    places. Other columns pass through under any names, but for ``sequence_id`` and ``offset``, which are
    replaced. An empty table gives an empty one.
    """
    spark = pieces.sparkSession
    total = pieces.count()
    salts = min(_MOST_SALTS, max(1, -(-total // _ROWS_PER_SALT)))
    own = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    # Rows travel as one struct, so their columns may have any names.
    salted = pieces.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), "length", F.pmod(F.xxhash64(*ties), F.lit(salts)).alias("salt"))
    counts = scratch.table(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_slots(histogram, capacity)
    block = max(1024, total >> 20)  # ranks that meet a plan row by one key
    slots = spark.createDataFrame(plan, "length long, rank_from long, sequences long, each long, first_sequence long, at long")
    slots = slots.withColumn("rank_to", F.expr("rank_from + sequences * each"))
    slots = slots.withColumn("block", F.explode(F.expr(f"sequence(rank_from div {block}, (rank_to - 1) div {block})")))

    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "salt").orderBy(*[F.col("row").getField(t) for t in ties])
    ranked = salted.withColumn("rank", F.row_number().over(inside) - 1).join(starts, ["length", "salt"])
    ranked = ranked.select("row", "length", (F.col("before") + F.col("rank")).alias("rank")).withColumn("block", F.expr(f"rank div {block}"))
    placed = ranked.join(slots, ["length", "block"]).where("rank >= rank_from and rank < rank_to")
    return placed.select(*[F.col("row").getField(c).alias(c) for c in own],
                         F.expr("first_sequence + (rank - rank_from) div each").alias("sequence_id"),
                         F.expr("at + (rank - rank_from) % each * length").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY) -> DataFrame:
    """Placed pieces of all documents: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.table(token_pieces(docs, tokenizer_path, capacity=capacity, with_ids=False), "pieces")
    return place_pieces(scratch, pieces, capacity=capacity)


def packed_sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, lengths): the sequences themselves, from pieces with ``ids``.

    A group holds at most the capacity's tokens. (doc_id, piece) must identify a piece.
    """
    slots = placed.select("doc_id", "piece", "sequence_id", "offset")
    rows = pieces.join(slots, ["doc_id", "piece"]).select("sequence_id", F.struct("offset", "doc_id", "length", "ids").alias("p"))
    packed = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return packed.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"))
