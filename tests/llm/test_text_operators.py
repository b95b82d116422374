"""Operators on documents against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from creditspark.llm import op06_jaccard_join as op06
from creditspark.llm import op07_toxicity as op07
from creditspark.llm.op03_lz_fingerprint import PhraseParse, edited_fingerprints
from creditspark.llm.op04_best_fit_packing import WordEncoder, pack_documents, packed_sequences, plan_slots, token_pieces
from creditspark.llm.op05_poisson_mixing import mix_sources, source_rates
from creditspark.llm.op06_jaccard_join import jaccard_components
from creditspark.llm.op07_toxicity import BlockMaxIndex, is_held_out, toxicity_scores
from creditspark.llm.queries import tokenizer_path
from creditspark.llm.scratch import Scratch
from creditspark.llm.shingles import shingle_sets

DOC = "doc_id long, text string, lang string, source string, n_chars long, list string, sig long, token string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 7, "y") for i, t, s in rows], DOC)


def odd_rows():
    long = " ".join(f"w{i % 997}x{i % 13}" for i in range(60_000))
    return [(1, "", "a"), (2, None, "a"), (None, "some words without an id here", None), (3, "  \t\n ", "b"),
            (4, "one two", "b"), (5, "one two", "b"), (5, "one two", "b"), (6, long, "a"), (7, long + " tail", "a"), (8, "É é <|endoftext|> x\x1cy", "a")]


# ------------------------------------------------------------------ operator 3

def brute_phrases(text):
    seen, start = set(), 0
    for stop in range(1, len(text) + 1):
        if text[start:stop] not in seen:
            seen.add(text[start:stop])
            start = stop
    return seen


def test_phrase_parse_matches_the_plain_parse():
    rng = random.Random(3)
    for _ in range(40):
        text = "".join(rng.choice("abcé ") for _ in range(rng.randrange(0, 300)))
        other = "".join(rng.choice("abd ") for _ in range(300))
        keep = len(text) - len(text) // 4
        parse = PhraseParse(text, keep)
        edited = text[:keep] + other[:len(text) - keep]
        assert (parse.signature == PhraseParse(text, 0).signature).all()
        assert (parse.edited(edited) == PhraseParse(edited, len(edited)).signature).all()
        assert len(parse.phrases) + len(parse.tail) == len(brute_phrases(text))


def test_edited_texts_and_order(spark):
    rows = [(i * 3, "".join(random.Random(i).choice("ab cd") for _ in range(i * 7)), "s") for i in range(40)]
    got = {r.doc_id: r for r in edited_fingerprints(frame(spark, rows[::-1])).collect()}
    assert len(got) == 40
    for (i, text, _), (_, following, _) in zip(rows, rows[1:] + rows[:1]):
        k = len(text) // 4
        edited = text[:len(text) - k] + following[:k]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[39 * 3].near_edited > got[39 * 3].near_next


def test_fingerprint_edge_cases(spark):
    got = edited_fingerprints(frame(spark, odd_rows())).collect()
    assert len(got) == len(odd_rows())
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].fingerprint == by[2][0].fingerprint and by[1][0].near_edited == 1.0
    assert by[4][0].fingerprint == by[5][0].fingerprint == by[5][1].fingerprint
    assert by[6][0].near_next > 0.9
    assert edited_fingerprints(frame(spark, [])).count() == 0
    one = edited_fingerprints(frame(spark, [(9, "abcdefgh", "s")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()


# ------------------------------------------------------------------ operator 4

def test_word_encoder_equals_whole_encoding():
    enc = WordEncoder(tokenizer_path())
    texts = [" a b ", " , . x", "ÀÉ. Ö, ß. µ, ª. º, ².\n ¼, _. a_. b\xa0c\x85d", "J̌ ǰ J", "", "Ça va  ÉTÉ é ́x don't I'll 123 ab12 <|endoftext|> x", "a\x1cb", "\n\t ", "x_, y), z?. w., 1. 2, it's, ok.\n", "\x01 a",
             " x y​z ΑΣ İ ﬁ ẞ", "a. . , b", "no.\n\nYes, sir. ½, 一. ٣. ﷺ, é, f́. g"]
    for text, ids in zip(texts, enc.encode(pa.array(texts))):
        assert ids.tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_plan_fills_every_length_without_overlap():
    rng = random.Random(1)
    counts = {}
    for _ in range(5000):
        n = min(512, int(rng.expovariate(1 / 90)) + 1)
        counts[n] = counts.get(n, 0) + 1
    plan = plan_slots(counts, 512)
    used, at = {}, {}
    for length, rank, sequences, each, first, offset in plan:
        assert rank == at.get(length, 0)
        at[length] = rank + sequences * each
        for s in range(first, first + sequences):
            used.setdefault(s, []).extend((offset + i * length, length) for i in range(each))
    assert at == counts
    for slots in used.values():
        end = 0
        for offset, length in sorted(slots):
            assert offset == end
            end += length
        assert end <= 512
    total = sum(n * c for n, c in counts.items())
    assert len(used) <= 1.02 * total / 512 + 1
    with pytest.raises(ValueError):
        plan_slots({513: 1}, 512)
    assert plan_slots({}, 512) == []


def test_packing_round_trip(spark):
    rows = odd_rows()
    docs = frame(spark, rows)
    placed = pack_documents(docs, tokenizer_path()).collect()
    enc = WordEncoder(tokenizer_path()).tokenizer
    want = []
    for i, text, _ in rows:
        ids = np.array(enc.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(i, p, s, len(ids[s:s + 4096]), zlib.crc32(ids[s:s + 4096].tobytes())) for p, s in enumerate(range(0, len(ids), 4096))]
    order = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in placed), key=order) == sorted(want, key=order)
    ends = {}
    for r in sorted(placed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096
    assert pack_documents(frame(spark, []), tokenizer_path()).count() == 0


def test_packed_sequences_hold_the_ids(spark):
    docs = frame(spark, [(i, f"text number {i} " * (i + 1), "s") for i in range(30)])
    pieces = token_pieces(docs, tokenizer_path(), capacity=64)
    placed = pack_documents(docs, tokenizer_path(), capacity=64)
    by_piece = {(r.doc_id, r.piece): list(r.ids) for r in pieces.collect()}
    places = placed.collect()
    for seq in packed_sequences(pieces, placed).collect():
        parts = sorted((r.offset, r.doc_id, r.piece) for r in places if r.sequence_id == seq.sequence_id)
        assert list(seq.ids) == [t for _, d, p in parts for t in by_piece[d, p]]


# ------------------------------------------------------------------ operator 5

def test_mixing_rates_and_counts(spark):
    rows = [(i, "x" * (10 + i % 7), "big" if i % 10 else "small") for i in range(4000)]
    docs = frame(spark, rows)
    rates = {r.source: r for r in source_rates(docs, weights={"big": 1.0, "small": 1.0}).collect()}
    mixed = mix_sources(docs, weights={"big": 1.0, "small": 1.0})
    got = {r.source: r.c for r in mixed.groupBy("source").agg(F.sum("n_chars").alias("c")).collect()}
    total = rates["big"].chars + rates["small"].chars
    for s in ("big", "small"):
        assert abs(got[s] - total / 2) < 0.06 * total
    counts = mixed.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copies").alias("m"), F.countDistinct("copy").alias("d")).collect()
    assert all(r.n == r.m == r.d for r in counts)
    assert mix_sources(docs).orderBy("mix_key").first() == mix_sources(docs.repartition(3)).orderBy("mix_key").first()


def test_mixing_large_rates_and_edges(spark):
    docs = frame(spark, [(1, "rare", "r")] + [(i, "common " * 40, None) for i in range(2, 200)] + [(900, "", "empty"), (901, None, "empty")])
    rates = {r.source: r.rate for r in source_rates(docs, power=0.0).collect()}
    assert rates["r"] > 1000 and rates["empty"] == 0
    mixed = mix_sources(docs, power=0.0)
    copies = mixed.where("source = 'r'").count()
    assert abs(copies - rates["r"]) < 6 * rates["r"] ** 0.5
    assert mixed.where("source is null").count() > 0 and mixed.where("source = 'empty'").count() == 0
    assert mix_sources(frame(spark, [])).count() == 0


# ------------------------------------------------------------------ operator 6

def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def brute_components(rows, percent=80):
    sets = []
    for i, t, *_ in rows:
        w = words(t)
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(((i, len(sets[k]), least.get(root(k))) for k, (i, *_) in enumerate(rows)), key=str)


def jaccard(spark, rows):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(frame(spark, rows)).collect()), key=str)


def test_jaccard_matches_brute_force_with_large_groups(spark):
    rng = random.Random(5)
    vocabulary = [f"t{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, passage = [], text(60)
    base = text(150)
    for i in range(90):  # one large group of near copies, pairwise on both sides of the threshold
        copy = list(base)
        for _ in range(rng.randrange(1, 6)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        rows.append((1000 + i, " ".join(copy), "s"))
    for i in range(60):  # a passage that many documents share
        rows.append((2000 + i, " ".join(text(rng.randrange(5, 120)) + passage + text(rng.randrange(5, 120))), "s"))
    for i in range(40):  # exact copies, short texts
        rows.append((3000 + i, "Same words in every one of these", "s"))
        rows.append((4000 + i, " ".join(text(rng.randrange(1, 7))), "s"))
    rng.shuffle(rows)
    assert jaccard(spark, rows) == brute_components(rows)


def test_jaccard_edge_cases(spark):
    rows = odd_rows()
    got = jaccard(spark, rows)
    want = brute_components(rows)
    assert [g for g in got if g[0] is not None] == [w for w in want if w[0] is not None]
    assert jaccard(spark, []) == []
    assert jaccard(spark, [(None, "a b c d e f", "s"), (9, "A b  c d\te f", "s")]) == [(9, 2, 9), (None, 2, 9)]


def test_shingle_sets_of_slices():
    texts = pa.array(["skip", "a b c d e f", None, "", "x", "a b c d e f"]).slice(1)
    sets = list(shingle_sets(texts))
    assert [len(s) for s in sets] == [2, 0, 0, 1, 2]
    assert (sets[0] == sets[4]).all()


# ------------------------------------------------------------------ operator 7

def test_block_max_index_is_exact():
    rng = np.random.default_rng(0)
    vectors = []
    for _ in range(500):
        terms = np.sort(rng.choice(60, size=rng.integers(1, 6), replace=False))
        weight = rng.random(len(terms)) + 0.1
        vectors.append((terms, weight / np.linalg.norm(weight)))
    index = BlockMaxIndex(vectors, 60)
    dense = np.zeros((500, 60))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for q in range(0, 500, 7):
        score = np.round(dense @ dense[q], 9)
        want = sorted(((-s, i) for i, s in enumerate(score) if s > 0 and i != q))[:10]
        got = index.nearest(*vectors[q], 10, skip=q)
        assert [i for _, i in got] == [i for _, i in want] or np.allclose([s for s, _ in got], [-s for s, _ in want], atol=1e-9)


def toxic_rows(n):
    rng = random.Random(2)
    bad, plain = [f"nasty{i}" for i in range(6)], [f"word{i}" for i in range(300)]
    rows = []
    for i in range(n):
        text = [rng.choice(plain) for _ in range(rng.randrange(5, 200))]
        toxic = int(i % 7 == 0)
        for _ in range(3 * toxic):
            text[rng.randrange(len(text))] = rng.choice(bad)
        rows.append((i, " ".join(text), toxic))
    return rows


def test_toxicity_held_out_accuracy(spark):
    rows = toxic_rows(1400)
    labels = spark.createDataFrame([(i, 1, t, "z") for i, _, t in rows if i % 2 == 0], "doc_id long, quality int, toxic int, text string")
    got = {r.doc_id: r for r in toxicity_scores(frame(spark, [(i, t, "s") for i, t, _ in rows]), labels).collect()}
    assert len(got) == 1400
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    unseen = [(got[i].predicted, t) for i, _, t in rows if i % 2 or got[i].held_out]
    assert sum(p == t for p, t in unseen) >= 0.97 * len(unseen)
    assert all(n.cosine > 0 for n in got[0].neighbours)


def plain_neighbours(docs, labels):
    """Ten nearest examples of each document, term weights and cosines by plain dictionaries."""
    words = {i: Counter(re.findall(r"\w+", t.lower())) for i, t in docs}
    df = Counter(w for found in words.values() for w in found)
    examples = {i: t for i, t in labels.items() if zlib.crc32(str(i).encode()) % 5}
    size = Counter(examples.values())
    had = {y: Counter(w for i, t in examples.items() if t == y for w in words[i]) for y in (0, 1)}
    scale = {}
    for w in set(had[0]) | set(had[1]):
        clean, toxic = had[0][w] + 0.5, had[1][w] + 0.5
        z = math.log(toxic / (size[1] + 1) * (size[0] + 1) / clean) / math.sqrt(1 / toxic + 1 / clean)
        scale[w] = (math.log((1 + len(docs)) / (1 + df[w])) + 1e-6) * (0.1 + max(0, abs(z) - 2))
    units = {}
    for i, found in words.items():
        weight = {w: (1 + math.log(n)) * scale[w] for w, n in found.items() if w in scale}
        length = math.sqrt(sum(v * v for v in weight.values()))
        units[i] = {w: v / length for w, v in weight.items()}
    near = {}
    for i, unit in units.items():
        cosines = {e: sum(v * units[e].get(w, 0) for w, v in unit.items()) for e in sorted(examples)}
        near[i] = sorted(((c, e) for e, c in cosines.items() if c > 0), key=lambda pair: (-round(pair[0], 9), pair[1]))[:10]
    return near, examples


def test_toxicity_neighbours_by_brute_force(spark):
    rows = toxic_rows(300)
    labels = {i: t for i, _, t in rows if i % 3}
    # a rare text of one toxic example, met again by a document without label
    rows += [(1001, "Qwzx vbnm plok jhgf", 1), (1002, "qwzx vbnm plok jhgf", 1)]
    labels[1001] = 1
    assert zlib.crc32(b"1001") % 5
    docs = [(i, t) for i, t, _ in rows]
    got = {r.doc_id: r for r in toxicity_scores(frame(spark, [(i, t, "s") for i, t in docs]), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")).collect()}
    want, examples = plain_neighbours(docs, labels)
    assert set(got) == set(want)
    for i, near in want.items():
        have = [(n.cosine, n.doc_id) for n in got[i].neighbours]
        assert np.allclose([c for c, _ in have], [c for c, _ in near], atol=1e-9)
        last = near[-1][0] if near else 0
        assert {e for c, e in have if c > last + 1e-9} == {e for c, e in near if c > last + 1e-9}
        assert all(n.toxic == examples[n.doc_id] for n in got[i].neighbours)
    assert got[1002].neighbours[0].doc_id == 1001 and abs(got[1002].neighbours[0].cosine - 1) < 1e-9
    assert got[1002].score > min(r.score for r in got.values())
    few = toxicity_scores(frame(spark, [(i, t, "s") for i, t in docs]), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"), examples_per_class=5).collect()
    assert len(few) == len(docs) and len({n.doc_id for r in few for n in r.neighbours}) <= 10


def test_toxicity_edge_cases(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (999, 1), (6, 0)], "doc_id long, toxic int")
    got = toxicity_scores(frame(spark, odd_rows()), labels).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
    assert toxicity_scores(frame(spark, []), labels).count() == 0
    none = toxicity_scores(frame(spark, odd_rows()), labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert frame(spark, [(None, "x", "s")]).select(is_held_out("doc_id").alias("h")).first().h is False


def test_mixing_and_packing_with_clashing_names(spark, tmp_path):
    """Columns named like the operators' own working columns pass through unchanged."""
    from creditspark.llm.op04_best_fit_packing import place_pieces
    from creditspark.llm.op05_poisson_mixing import mix_sources
    from creditspark.llm.scratch import Scratch

    names = ["_u", "_steps", "_source", "_target", "_SOURCE_", "a.b", "n_docs"]
    rows = [(i, f"text {i} " * 5, "st"[i % 2], *[i * 10 + k for k in range(len(names))]) for i in range(40)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "source", *names]).withColumn("Rate", F.lit(9))
    mixed = mix_sources(df)
    assert mixed.columns == ["doc_id", "text", "source", *names, "rate", "copies", "copy", "mix_key"]
    plain = mix_sources(df.select("doc_id", "text", "source"))
    assert sorted(r["doc_id"] for r in mixed.collect()) == sorted(r["doc_id"] for r in plain.collect())
    assert all(r["_u"] == r["doc_id"] * 10 and r["a.b"] == r["doc_id"] * 10 + 5 for r in mixed.collect())

    names = ["block", "_rank", "rank_from", "each", "at", "salt", "row", "Rank_To", "x.y"]
    rows = [(i, 0, 1 + i % 9, 7, *[i * 10 + k for k in range(len(names))]) for i in range(60)]
    pieces = spark.createDataFrame(rows, ["doc_id", "piece", "length", "ids_crc32", *names]).withColumn("Offset", F.lit(-1))
    placed = place_pieces(Scratch(spark, "clash"), pieces, capacity=20).collect()
    assert len(placed) == 60 and all(r["block"] == r["doc_id"] * 10 and r["x.y"] == r["doc_id"] * 10 + 8 for r in placed)
    slots = sorted((r["sequence_id"], r["offset"], r["length"]) for r in placed)
    assert all(a[0] != b[0] and b[1] == 0 or a[1] + a[2] == b[1] for a, b in zip(slots, slots[1:]))


def test_toxicity_holds_few_texts_at_once():
    texts = ["word other " * 100] * 3000 + [None, "", "x" * 2_000_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    parts = list(op07.term_lists(iter([batch]), {"word": 0, "other": 1}))
    assert [i for p in parts for i in p.column("doc_id").to_pylist()] == list(range(len(texts)))
    assert max(p.num_rows for p in parts) <= 1000
    found = [(t, n) for p in parts for t, n in zip(p.column("terms").to_pylist(), p.column("counts").to_pylist())]
    assert found == [([0, 1], [100, 100])] * 3000 + [([], [])] * 3
    assert [p.num_rows for p in op07.row_slices(iter([batch]))] == [1000, 1000, 1000, 3]


def test_shingles_are_hashed_in_small_slices(monkeypatch):
    from creditspark.llm import shingles

    texts = pa.array([f"a{i} b c d e f{i} " * 60 for i in range(3000)] + [None, "", "one two"])
    alone = [s.tolist() for i in range(0, len(texts), 101) for s in shingle_sets(texts.slice(i, 1))]
    seen, hashes = [], shingles.word_hashes
    monkeypatch.setattr(shingles, "word_hashes", lambda data, offsets: seen.append(len(data)) or hashes(data, offsets))
    assert [s.tolist() for s in shingle_sets(texts)][::101] == alone
    assert len(seen) > 1 and max(seen) <= 500_000


def test_toxicity_model_is_built_in_little_memory():
    rng = np.random.default_rng(5)
    n_terms, n = 30_000, 2_500
    vectors = [(np.sort(rng.choice(n_terms, 200, replace=False)).astype(np.int32), rng.integers(1, 4, 200, dtype=np.int32)) for _ in range(n)]
    toxic = np.arange(n) % 5 // 4
    tracemalloc.start()
    model = op07.ToxicityModel(list(range(n)), toxic, vectors, np.ones(n_terms), {0: 1.0, 1: 1.0})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.index.size == n and len(model.index.row) == 200 * n
    assert peak < 80 * 200 * n  # bytes for each term of each example; the driver builds it


def test_toxicity_words_are_the_same_by_bytes_and_by_pattern():
    text = "".join(f"Ab{chr(c)}9_" for c in range(128))
    assert text.isascii() and op07.words_of(text) == re.findall(r"\w+", text.lower())
    for other in ("Größe\u2028İI ça_va ١٢ Ǆ.x", "\x85a\xa0B", None, ""):
        assert op07.words_of(other) == re.findall(r"\w+", (other or "").lower())


def test_toxicity_terms_are_counted_for_a_slice_at_once(monkeypatch):
    texts = ["b a B c", None, "x", "", "C c. a"] * 50
    batch = pa.RecordBatch.from_arrays([pa.array(range(250)), pa.array(texts)], ["doc_id", "text"])
    calls, unique = [], np.unique
    monkeypatch.setattr(op07.np, "unique", lambda *a, **k: calls.append(1) or unique(*a, **k))
    part, = op07.term_lists(iter([batch]), {"a": 0, "b": 1, "c": 2})
    assert part.column("terms").to_pylist() == [[0, 1, 2], [], [], [], [0, 2]] * 50 and len(calls) == 1
    assert part.column("counts").to_pylist() == [[1, 2, 1], [], [], [], [1, 2]] * 50
    bare, = op07.term_lists(iter([batch]), {})
    assert bare.column("terms").to_pylist() == [[]] * 250


def test_toxicity_index_scores_all_examples_of_a_sample_at_once(monkeypatch):
    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(3000):
        weight = rng.random(6) + 0.1
        vectors.append((np.sort(rng.choice(4000, 6, replace=False)), weight / np.linalg.norm(weight)))
    whole, calls, count = BlockMaxIndex(vectors, 4000), [], np.bincount
    monkeypatch.setattr(op07.np, "bincount", lambda *a, **k: calls.append(1) or count(*a, **k))
    found = [whole.nearest(*v, 10, skip=i) for i, v in enumerate(vectors[:200])]
    assert len(calls) == 200 and sum(map(len, found)) > 200
    monkeypatch.setattr(op07, "BLOCK", 128)
    cut = BlockMaxIndex(vectors, 4000)
    assert cut.blocks == 24 and [cut.nearest(*v, 10, skip=i) for i, v in enumerate(vectors[:200])] == found


def test_jaccard_tokens_of_one_set_go_no_further(spark, monkeypatch):
    counts, table = {}, Scratch.table

    def counted(self, df, name, *rest):
        got = table(self, df, name, *rest)
        counts[name] = got.count()
        return got

    monkeypatch.setattr(Scratch, "table", counted)
    copies = [(k * 100 + i, " ".join(f"w{k}x{j}" for j in range(200)), "s") for i in range(40) for k in range(3)]
    docs = frame(spark, copies).repartition(16, "doc_id")
    assert {(r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()} == {(196, 0), (196, 100), (196, 200)}
    assert counts["postings"] == 0  # copies of a set are one set, and no two sets share a token


def test_jaccard_postings_of_a_range():
    rows = np.array([(7, 1, 5), (7, 1, 5), (9, 2, 6), (2**64 - 1, 4, 8), (2**64 - 1, -3, 9), (9, 2, 6), (2**64 - 1, -3, 9)], op06.POSTING)
    got = op06._range_postings(pd.DataFrame({"range": 0, "postings": [rows[:2].tobytes(), rows[2:].tobytes()]}))
    assert got.values.tolist() == [[-1, -3, 9], [-1, 4, 8]]
    assert op06._range_postings(pd.DataFrame({"range": [], "postings": []})).empty


def test_shuffle_files_of_finished_queries_go(spark, tmp_path):
    files = lambda: sum(f.getName().startswith("shuffle_") for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
        spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()))
    scratch = Scratch(spark, "released")
    scratch.table(spark.range(1000).repartition(37, "id"), "rows")
    before, waited = files(), 0
    assert before >= 1
    while files() >= before and waited < 20:
        scratch.release()
        time.sleep(0.5)
        waited += 1
    assert files() < before


def test_numbered_texts_are_compressed(spark):
    import pyarrow.parquet as pq

    rows, key = corpus_pipeline.numbered(frame(spark, odd_rows()), "numbered")
    assert rows.count() == len(odd_rows()) == rows.select(key).distinct().count()
    for path in rows.inputFiles():
        assert pq.ParquetFile(path.removeprefix("file://")).metadata.row_group(0).column(1).compression == "ZSTD"
