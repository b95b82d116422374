"""Operator 13: exact BPE ids by dynamic programming over prefixes, and their decoding.

For a trained merge list every string has one encoding, and every prefix of it has one last token:
the only token that ends there and is compatible with the last token of the prefix before it. An
Aho-Corasick automaton gives the tokens that end at each place (its suffix links, longest first);
the pair test undoes the two tokens' merges in the order in which they were made and asks whether
another merge across their border would have come earlier. Back-pointers then give the ids. The work is
linear in the text, whatever the merges are.

Texts are cut where no token can lie across: before white space that follows other characters. Each
worker remembers the ids of the parts it has met, up to a number of them; a part that isn't
remembered is computed again, so the memory changes no result. Long texts go through in blocks.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MEMORY, _REMEMBERED = 400_000, 64  # parts that a worker remembers (more start the memory anew), characters of such a part
_PAIR_BITS, _MIX = 20, np.int64(-7046029254386353131)  # memory of tested pairs, its hash
_NEVER = np.int64(1 << 62)
_BLOCK = 1_000_000  # characters of a text that are in work at a time
_ROWS, _BATCH_BYTES = 2000, 8_000_000  # rows and bytes of text that are looked up together
# Fixed value: the split of byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACES = " \t\n\x0b\x0c\r\x85\xa0  -     　"
_PARTS = re.compile(r"\s*\S+|\s+")
_SAFE_PARTS = re.compile(f"[{_SPACES}]*[^{_SPACES}]+|[{_SPACES}]+")  # for texts with separators that only Python calls white space
_ODD = re.compile("[\x1c-\x1f]")
_BLANKS = frozenset(" \t\n\x0b\x0c\r")
_CUT = re.compile(r"(?<=\S)(?=[ \t\n\x0b\x0c\r])")
_ENCODERS: dict[int, "PrefixEncoder"] = {}


def blocks(text: str, size: int = _BLOCK) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters, cut where parts are cut."""
    at = 0
    while len(text) - at > size and (found := _CUT.search(text, at + size)):
        yield text[at:found.start()]
        at = found.start()
    yield text[at:]


def parts(text: str) -> list[str]:
    """White space with what follows it; no token of a byte-level vocabulary crosses their borders."""
    return (_SAFE_PARTS if _ODD.search(text) else _PARTS).findall(text)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixEncoder:
    """Encoder and decoder of a byte-level BPE vocabulary in the tokenizers library's JSON.

    Needs merges in training order (a part is made before what it is merged into); other settings
    (normal form, prefix space, dropout, stripping special tokens) raise ``ValueError``.
    """

    def __init__(self, spec: str, *, special: bool = True):
        spec = json.loads(spec)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        if (model["type"] != "BPE" or spec["normalizer"] or split.get("type") != "ByteLevel" or split["add_prefix_space"]
                or not split.get("use_regex", True) or model.get("dropout") or model.get("ignore_merges")
                or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")):
            raise ValueError("not a plain byte-level BPE vocabulary")
        letters = byte_letters()
        vocabulary = model["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("special tokens must be plain strings")
        bytes_of: dict[int, bytes] = {i: t.encode() for t, i in added.items()}
        bytes_of.update((i, bytes(map(letters.__getitem__, t))) for t, i in vocabulary.items() if t not in added)
        top = max(bytes_of) + 1
        self.bytes_of = [bytes_of.get(i, b"") for i in range(top)]
        self.decimal_of = [str(i) for i in range(top)]
        self.size = np.array([len(b) for b in self.bytes_of], np.int64)
        self.rank, self.left, self.right = np.full(top, -1, np.int64), np.arange(top), np.arange(top)
        pair_rank = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            a, b, whole = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if self.rank[whole] >= 0 or max(self.rank[a], self.rank[b]) >= rank:
                raise ValueError("merges aren't in training order")
            self.rank[whole], self.left[whole], self.right[whole] = rank, a, b
            pair_rank[a << 32 | b] = rank
        self._pair_keys = np.array(sorted(pair_rank), np.int64)
        self._pair_ranks = np.array([pair_rank[k] for k in self._pair_keys.tolist()] + [_NEVER], np.int64)
        self._automaton([i for t, i in vocabulary.items() if self.rank[i] >= 0 or len(t) == 1])
        self.split = regex.compile(SPLIT)
        self.special = added if special else {}
        self._special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if self.special else None
        self._met = np.full(1 << _PAIR_BITS, -1, np.int64)  # pairs tested last, by hash
        self._fits = np.zeros(1 << _PAIR_BITS, bool)
        self._known: dict[str, bytes] = {}

    def _automaton(self, tokens: list[int]) -> None:
        """Aho-Corasick automaton: ``_step[state, byte]``, a state's longest token, the next shorter one of a token."""
        children: list[dict[int, int]] = [{}]
        depth, parent, letter, own = [0], [0], [0], {}
        for token in tokens:
            at = 0
            for byte in self.bytes_of[token]:
                down = children[at].get(byte)
                if down is None:
                    down = children[at][byte] = len(children)
                    children.append({})
                    depth.append(depth[at] + 1)
                    parent.append(at)
                    letter.append(byte)
                at = down
            own[at] = token
        depth, parent, letter = map(np.array, (depth, parent, letter))
        self._step = np.zeros((len(children), 256), np.int32)
        self._longest = np.full(len(children), -1, np.int64)
        self._shorter = np.full(len(self.bytes_of), -1, np.int64)
        has = np.full(len(children), -1, np.int64)
        has[list(own)] = list(own.values())
        for level in range(1, depth.max() + 1):
            nodes = np.flatnonzero(depth == level)
            # A parent's row still leads where its longest proper suffix does: there is the node's own one.
            suffix = self._step[parent[nodes], letter[nodes]] if level > 1 else np.zeros(len(nodes), np.int32)
            self._step[parent[nodes], letter[nodes]] = nodes
            self._step[nodes] = self._step[suffix]
            ends = has[nodes] >= 0
            self._longest[nodes] = np.where(ends, has[nodes], self._longest[suffix])
            self._shorter[has[nodes[ends]]] = self._longest[suffix[ends]]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether their joined bytes are encoded as just these two.

        The pair's merges are undone, latest first; the pair is broken if tokens that meet at the
        border could have been merged before the merge that parted them.
        """
        fits = np.ones(len(a), bool)
        todo, before = np.arange(len(a)), np.full(len(a), _NEVER)
        while len(todo):
            key = a << 32 | b
            at = np.searchsorted(self._pair_keys, key)
            met = self._pair_keys[np.minimum(at, len(self._pair_keys) - 1)] == key
            broken = np.where(met, self._pair_ranks[at], _NEVER) < before
            fits[todo[broken]] = False
            of_a, of_b = self.rank[a], self.rank[b]
            undo_a = of_a > of_b  # of equal merges the left one comes first, so the right one is undone first
            before = np.where(undo_a, of_a, of_b + 1)
            going = ~broken & (np.maximum(of_a, of_b) >= 0)
            a, b = np.where(undo_a, self.right[a], a)[going], np.where(undo_a, b, self.left[b])[going]
            todo, before = todo[going], before[going]
        return fits

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``compatible`` with a memory of pairs."""
        key = a << 32 | b
        slot = (key * _MIX >> np.int64(64 - _PAIR_BITS)) & np.int64((1 << _PAIR_BITS) - 1)
        fits = self._fits[slot]
        new = np.flatnonzero(self._met[slot] != key)
        if len(new):
            keys, back = np.unique(key[new], return_inverse=True)
            found = self.compatible(keys >> 32, keys & 0xFFFFFFFF)
            fits[new] = found[back]
            self._met[slot[new]], self._fits[slot[new]] = key[new], fits[new]  # equal slots: the last one stays in both
        return fits

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of stretches of the split, one after the other, and how many each has.

        All words take their k-th byte together; shorter words are done sooner.
        """
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        begin, sorted_sizes = starts[order], sizes[order]
        last = np.full(len(flat), -1, np.int64)
        state = np.zeros(len(raw), np.int64)
        for k in range(int(sizes.max(initial=0))):
            many = int(np.searchsorted(-sorted_sizes, -k, "left"))  # words with more than k bytes
            at = begin[:many] + k
            state = self._step[state[:many], flat[at]]
            token, left = self._longest[state], np.arange(many)
            while len(left):
                before = k - self.size[token]  # last place of the prefix that the token follows
                fits = before < 0
                inner = np.flatnonzero(~fits)
                fits[inner] = self._fit(last[begin[left[inner]] + before[inner]], token[inner])
                last[at[left[fits]]] = token[fits]
                left, token = left[~fits], self._shorter[token[~fits]]
        ends = np.zeros(len(flat), bool)
        place, first = starts + sizes - 1, starts
        alive = np.flatnonzero(sizes > 0)
        place, first = place[alive], first[alive]
        while len(place):
            ends[place] = True
            place = place - self.size[last[place]]
            inside = place >= first
            place, first = place[inside], first[inside]
        done = np.concatenate(([0], np.cumsum(ends)))
        return last[ends].astype("<u4"), done[starts + sizes] - done[starts]

    def encode_parts(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts (see ``parts``), one after the other, and how many each has."""
        joined = [i for i, p in enumerate(found) if p[0] in _BLANKS and not p[-1].isspace()]  # may stand one after the other
        words: list[str] = self.split.findall("".join(found[i] for i in joined))
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        borders = np.cumsum(np.fromiter((len(found[i]) for i in joined), np.int64, len(joined)))
        counts = np.zeros(len(found), np.int64)
        upto = np.searchsorted(ends, borders, "right")
        counts[joined] = np.diff(upto, prepend=0)
        others = sorted(set(range(len(found))).difference(joined))
        for i in others:
            own = self.split.findall(found[i])
            counts[i] = len(own)
            words += own
        place = np.empty(len(found), np.int64)  # each part's first word
        order = np.array(joined + others, np.int64)
        place[order] = np.cumsum(counts[order]) - counts[order]
        distinct = {w: k for k, w in enumerate(dict.fromkeys(words))}
        ids, many = self.encode_words(list(distinct))
        starts = np.cumsum(many) - many
        index = np.fromiter(map(distinct.__getitem__, words), np.int64, len(words))
        index = index[spread(place, counts)]
        each = many[index]
        word_ends = np.concatenate(([0], np.cumsum(each)))
        part_ends = np.cumsum(counts)
        return ids[spread(starts[index], each)], word_ends[part_ends] - word_ends[part_ends - counts]

    def learn(self, lists: list[list[str]]) -> dict[str, bytes]:
        """The memory of parts, after all parts of these lists have been encoded at once."""
        known, new = self._known, set()
        for found in lists:
            new |= set(found).difference(known)
        if len(known) + len(new) > _MEMORY:
            known = self._known = {p: known[p] for found in lists for p in found if p in known}
        if new:
            new = list(new)
            ids, counts = self.encode_parts(new)
            raw, ends = ids.tobytes(), np.cumsum(4 * counts).tolist()
            known.update(zip(new, (raw[a:b] for a, b in zip([0, *ends], ends))))
        self._long = [p for p in new if len(p) > _REMEMBERED]
        return known

    def _ordinary(self, texts: list[str]) -> list[np.ndarray]:
        lists = [parts(t) for t in texts]
        known = self.learn(lists)
        ids = [np.frombuffer(b"".join(map(known.__getitem__, found)), "<u4") for found in lists]
        for part in self._long:
            known.pop(part, None)
        return ids

    def encode_blocks(self, text: str) -> Iterator[np.ndarray]:
        """The ids of ``text``, block by block."""
        at = 0
        for found in self._special.finditer(text) if self._special else ():
            for block in blocks(text[at:found.start()]):
                yield from self._ordinary([block])
            yield np.array([self.special[found[0]]], "<u4")
            at = found.end()
        for block in blocks(text[at:] if at else text):
            yield from self._ordinary([block])

    def encode_batch(self, texts: list[str]) -> Iterator[Iterator[np.ndarray]]:
        """For each text its ids, block by block; short texts are looked up together."""
        short = [len(t) <= _BLOCK and not (self._special and self._special.search(t)) for t in texts]
        together = iter(self._ordinary([t for t, s in zip(texts, short) if s]))
        for text, is_short in zip(texts, short):
            yield iter((next(together),)) if is_short else self.encode_blocks(text)

    def encode(self, text: str) -> np.ndarray:
        return np.concatenate([*self.encode_blocks(text), np.empty(0, "<u4")])

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``; bytes that aren't UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decimal(self, ids: np.ndarray) -> str:
        return ",".join(map(self.decimal_of.__getitem__, ids.tolist()))


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places ``starts[i] .. starts[i] + counts[i] - 1`` of all i, one after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


def shared_encoder(spec: str, *, special: bool = True) -> PrefixEncoder:
    """This worker's encoder for a vocabulary, made once."""
    key = hash((spec, special))
    if key not in _ENCODERS:
        _ENCODERS[key] = PrefixEncoder(spec, special=special)
    return _ENCODERS[key]


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every row's whole text.

    ``vocabulary`` is the JSON itself, so workers need no file. A null text counts as empty: no ids
    and an empty decoded text. Every row, also a repeated one or one with a null id, gives one row;
    other columns are ignored; an empty table gives none.
    """
    def rows(encoder: PrefixEncoder, ids_of: Iterator[np.ndarray]) -> tuple:
        ids = np.concatenate([*ids_of, np.empty(0, "<u4")])
        return ids.astype(np.int32), encoder.decode(ids)

    return _mapped(docs, vocabulary, rows, {"ids": pa.list_(pa.int32()), "decoded": pa.string()}, "ids array<int>, decoded string")


def encoding_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), as ``encode_documents`` but block by block."""
    def rows(encoder: PrefixEncoder, ids_of: Iterator[np.ndarray]) -> tuple:
        n, ids_hash, text_hash, held = 0, hashlib.sha256(), hashlib.sha256(), b""
        for ids in ids_of:
            if len(ids):
                ids_hash.update(((("," if n else "") + encoder.decimal(ids))).encode())
                n += len(ids)
                held += encoder.decode_bytes(ids)
                whole = len(held) - _open_bytes(held)
                text_hash.update(held[:whole].decode("utf-8", "replace").encode())
                held = held[whole:]
        text_hash.update(held.decode("utf-8", "replace").encode())
        return n, ids_hash.hexdigest(), text_hash.hexdigest()

    return _mapped(docs, vocabulary, rows, {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()},
                   "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _open_bytes(data: bytes) -> int:
    """How many bytes at the end begin a letter that isn't complete."""
    for back in range(1, min(4, len(data) + 1)):
        byte = data[-back]
        if byte >= 0xC0:
            return back if back < (2 if byte < 0xE0 else 3 if byte < 0xF0 else 4) else 0
        if byte < 0x80:
            return 0
    return 0


def sliced(batch: pa.RecordBatch, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of so many rows at most, and of about ``size`` bytes of its second column, the text."""
    upto = np.concatenate(([0], np.cumsum(pc.binary_length(batch.column(1)).to_numpy())))
    first = 0
    while first < batch.num_rows:
        last = int(np.clip(np.searchsorted(upto, upto[first] + size, "right") - 1, first + 1, first + rows))
        yield batch.slice(first, last - first)
        first = last


def _mapped(docs: DataFrame, vocabulary: str, row, types: dict, schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # one vocabulary: its size doesn't grow with the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(shared.value)
        names, kinds = ["doc_id", *types], [pa.int64(), *types.values()]
        for batch in batches:
            for piece in sliced(batch, _ROWS, _BATCH_BYTES):
                ids, texts = piece.column(0).to_pylist(), piece.column(1).to_pylist()
                found = [(i, *row(encoder, ids_of)) for i, ids_of in zip(ids, encoder.encode_batch(texts))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {schema}")
