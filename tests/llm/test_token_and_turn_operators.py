"""Operators 11 to 13 against the tokenizer libraries and against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from creditspark.llm import op11_token_alignment as op11
from creditspark.llm import op12_viterbi_repair as op12
from creditspark.llm import op13_prefix_bpe as op13
from creditspark.llm.queries import QUERIES, damaged, tokenizer_path, tokenizer_text
from creditspark.llm.scratch import share_package

from conftest import SF_SMALL

LETTERS = "aabbcdehilnorst   \n\t.,'!0123éß\xa0\x1c\x85　你好🙂​\x00_-ªº²¼\r"


@pytest.fixture(scope="module", autouse=True)
def shared(spark):
    share_package(spark)


@pytest.fixture(scope="module")
def vocabulary():
    return tokenizer_text("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def model():
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


def odd_texts(seed, many):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(60))) for _ in range(many)]
    return texts + ["", " ", "   ", "\n", "\n\n x", "a " * 30, "aaaa" * 300, "x" * 70 + " " + "ab" * 300, "'ll 's'S " * 9, "tail  "]


# ------------------------------------------------------------------------------ operator 13

@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def test_ids_and_texts_equal_the_library(vocabulary, library):
    encoder = op13.PrefixEncoder(vocabulary)
    texts = odd_texts(1, 1500)
    texts += [t[:9] + "<|endoftext|>" + t[9:] for t in texts[:200]] + ["<|endoftext|><|endoftext|>", "<|endoftext"]
    for text, blocks in zip(texts, encoder.encode_batch(texts)):
        ids = np.concatenate([*blocks, np.empty(0, "<u4")])
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text
        assert encoder.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_every_token_and_every_prefix_has_its_last_token(vocabulary, library):
    """The table of last tokens is that of the prefixes' own encodings."""
    encoder = op13.PrefixEncoder(vocabulary)
    for word in ("internationalization", " unbelievable", "aaaaaaaaa", "zzyzx", "éèêë"):
        raw = word.encode()
        ids, _ = encoder.encode_words([word])
        assert ids.tolist() == library.encode(word, add_special_tokens=False).ids
        for end in range(1, len(raw) + 1):
            if (prefix := raw[:end].decode("utf-8", "ignore")).encode() == raw[:end]:
                assert encoder.encode_words([prefix])[0].tolist() == library.encode(prefix, add_special_tokens=False).ids
    tokens = [encoder.bytes_of[i].decode("utf-8", "ignore") for i in range(0, 50256, 97)]
    for token in (t for t in tokens if t.strip() and " " not in t[1:]):
        assert encoder.encode(token).tolist() == library.encode(token, add_special_tokens=False).ids


def test_small_memory_and_blocks_change_nothing(vocabulary, monkeypatch):
    texts = odd_texts(2, 10)[:14] + ["word after word, " * 60]
    want = [op13.PrefixEncoder(vocabulary).encode(t).tolist() for t in texts]
    monkeypatch.setattr(op13, "_MEMORY", 40)
    monkeypatch.setattr(op13, "_BLOCK", 64)
    encoder = op13.PrefixEncoder(vocabulary)
    monkeypatch.setattr(op13.blocks, "__defaults__", (64,))
    assert [np.concatenate([*b, np.empty(0, "<u4")]).tolist() for b in encoder.encode_batch(texts)] == want


def test_digests_and_arrays_of_odd_rows(spark, vocabulary, library):
    rows = [(1, "Hello <|endoftext|> world"), (None, "x y"), (None, "x y"), (3, None), (3, ""), (5, "naïve 你好 🙂")]
    df = spark.createDataFrame([(*r, 1, "b") for r in rows], "doc_id long, text string, n_tokens int, batch string")
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
             hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(map(tuple, op13.encoding_digests(df, vocabulary).collect())) == want
    arrays = op13.encode_documents(df, vocabulary).collect()
    assert Counter((r["doc_id"], r["decoded"]) for r in arrays) == Counter((i, t or "") for i, t in rows)
    assert op13.encoding_digests(df.limit(0), vocabulary).collect() == []


def test_unsuitable_vocabularies_raise(vocabulary):
    with pytest.raises(ValueError):
        op13.PrefixEncoder(vocabulary.replace('"add_prefix_space":false', '"add_prefix_space":true').replace('"add_prefix_space": false', '"add_prefix_space": true'))
    with pytest.raises(ValueError):
        op13.PrefixEncoder(tokenizer_text("word_bpe_49k.json"))


# ------------------------------------------------------------------------------ operator 11

def plain_alignment(rows, library, pieces):
    """One text at a time: group strings, then the corpus-wide counts."""
    letters = op13.byte_letters()
    groups_of = []
    for _, text in rows:
        full = f" {text or ''}".encode()
        a = library.encode(f" {text}", add_special_tokens=False) if text else None
        b = pieces.encode(text) if text else []
        raw_a = [bytes(letters[c] for c in t) for t in a.tokens] if text else []
        named = [pieces.id_to_piece(i) for i in b]
        raw_b = [bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, named)]
        if not text or b"".join(raw_a) != full or b"".join(raw_b) != full:
            groups_of.append([])
            continue
        ends_a, ends_b = [list(itertools.accumulate(map(len, raw))) for raw in (raw_a, raw_b)]
        cuts = sorted(set(ends_a) & set(ends_b))
        groups = [([], []) for _ in cuts]
        for ids, ends, side in ((a.ids, ends_a, 0), (b, ends_b, 1)):
            for i, end in zip(ids, ends):
                groups[sum(c < end for c in cuts) if len(cuts) < 50 else int(np.searchsorted(cuts, end))][side].append(i)
        groups_of.append(groups)
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups_of]
    holders = Counter(p for c in links for p in c)
    most = defaultdict(int)
    for (a, _), n in holders.items():
        most[a] = max(most[a], n)
    for (i, _), g, c in zip(rows, groups_of, links):
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        yield (i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()), sum(n for p, n in c.items() if holders[p] == most[p[0]]),
               sum(n * holders[p] for p, n in c.items()), hashlib.sha256(shown.encode()).hexdigest() if g else "")


@pytest.mark.parametrize("batch_bytes", [None, 700])
def test_alignment_equals_one_text_at_a_time(spark, vocabulary, model, monkeypatch, batch_bytes):
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
    rows = [(i if i % 17 else None, t) for i, t in enumerate(odd_texts(3, 150))]
    rows += [(900, None), (901, "▁"), (902, "a ▁ b"), (903, "<|endoftext|> <s> </s>"), (904, "same text"), (904, "same text")]
    rows += [(1000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(30).collect()]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, batch string, n int").repartition(3)
    if batch_bytes:  # many batches; the numbers are passed in, as workers don't see what a test sets
        spec = (vocabulary, model)
        run = op11.aligned_batches
        monkeypatch.setattr(op11, "_BATCH_BYTES", batch_bytes)
        df = df.repartition(40)
        assert run(df, *spec).where("pairs is not null").count() >= 10
    got = Counter(map(tuple, op11.alignment_digests(df, vocabulary, model).collect()))
    assert got == Counter(plain_alignment(rows, library, pieces))


def test_groups_as_arrays(spark, vocabulary, model):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (2, "")], "doc_id long, text string")
    rows = sorted(op11.align_documents(df, vocabulary, model).collect(), key=lambda r: -len(r["groups"]))
    assert [(g["a"], g["b"]) for g in rows[0]["groups"]] == [([23748], [6312, 28709]), ([995], [1526])]
    assert [list(r["groups"]) for r in rows[1:]] == [[], []]
    assert op11.align_documents(df.limit(0), vocabulary, model).collect() == [] == op11.alignment_digests(df.limit(0), vocabulary, model).collect()


@pytest.mark.parametrize("work", [1, 2, 7, 100, 1 << 16])
def test_pieces_of_the_merge_are_equal_work_and_stitch(work):
    rng = np.random.default_rng(work)
    for size in (0, 1, 5, 400):
        a, b = [np.append(np.unique(rng.integers(1, 3 * size + 2, size)), 3 * size + 3) if size else np.empty(0, np.int64) for _ in range(2)]
        cut_a, cut_b = op11.merge_path(a, b, work)
        assert (np.diff(cut_a) >= 0).all() and (np.diff(cut_b) >= 0).all() and (cut_a[-1], cut_b[-1]) == (len(a), len(b))
        assert all(x <= work + 1 for x in np.diff(cut_a) + np.diff(cut_b))
        group_a, group_b = op11.token_groups(a, b, work)
        common = np.intersect1d(a, b)
        assert (group_a == np.searchsorted(common, a)).all() and (group_b == np.searchsorted(common, b)).all()


def test_a_large_group_counts_links_without_writing_them(vocabulary, model, monkeypatch):
    aligner = op11.Aligner(vocabulary, model)
    text = " " + "ab" * 300
    plain = aligner.align([text])
    monkeypatch.setattr(op11, "_SMALL_GROUP", 0)
    counted = aligner.align([text])
    assert (plain.pairs == counted.pairs).all() and (plain.times == counted.times).all() and (plain.n_links == counted.n_links).all()


# ------------------------------------------------------------------------------ operator 12

COST = {"K": 0, "R": 1, "D": 2, "I": 5}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute_repair(rows):
    """All edits with up to two insertions in each gap."""
    fault, best = faults(rows), None
    choices = [["D"] if f in ("blank", "duplicate") else ["D", "K", "U", "A"] for f in fault]
    gaps = [[(), "u", "a", "ua", "au"]] * (len(rows) + 1)
    for edits, inserts in itertools.product(itertools.product(*choices), itertools.product(*gaps)):
        audit, turns, cost = "", [], 0
        for k, more in enumerate(inserts):
            audit += "I" * len(more)
            turns += [("user" if x == "u" else "assistant", "") for x in more]
            if k < len(rows):
                edit, (_, role, text) = edits[k], rows[k]
                audit += edit if edit in "DK" else "R"
                if edit != "D":
                    cost += 5 * (fault[k] == "truncated")
                    turns.append((role if edit == "K" else "user" if edit == "U" else "assistant", text))
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in turns)):
            found = (cost + sum(map(COST.get, audit)), audit, turns)
            best = found if best is None or found < best else best
    return best


def plain_search(rows):
    """Dynamic programming that carries whole audits; (cost, audit)."""
    wanted, legal = {0: 2, 1: 2, 2: 3, 3: 2}, {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def inserted(states):
        for _ in range(3):
            for s, (c, a) in list(states.items()):
                states[wanted[s]] = min(states.get(wanted[s], (9e9, "")), (c + 5, a + "I"))
        return states

    states = {0: (0, "")}
    for (_, role, _), fault in zip(rows, faults(rows)):
        after = {}
        for s, (c, a) in inserted(states).items():
            moves = [(s, c + 2, a + "D")]
            if fault in ("", "truncated"):
                extra = 5 * (fault == "truncated")
                moves += [(wanted[s], c + 1 + extra, a + "R")] + [(legal[k], c + extra, a + "K") for k in [(s, role[:1])] if k in legal]
            for to, cost, audit in moves:
                after[to] = min(after.get(to, (9e9, "")), (cost, audit))
        states = after
    states = inserted(states)
    return min(states[s] for s in (0, 3) if s in states)


def searched(rows):
    audit, turns = [], []

    def emit(letter, many, row):
        audit.append(letter * many)
        turns.extend([row[1:]] if letter != "D" else [])

    conversation, seen = op12.Conversation(1, emit), set()
    for turn, role, text in rows:
        conversation.add(turn, role, text, (role, text) in seen)
        seen.add((role, text))
    return conversation.repair.finish(), "".join(audit), turns, conversation


def random_turns(rng, most):
    texts = rng.choice([["", "a.", "b", "c!", " "], [f"{i}." for i in range(40)], ["x.", "y", ""] + [str(i) for i in range(9)]])
    mixed = rng.random()
    return [(i, rng.choice(["user", "assistant", "assistant", "user", "system", " ", ""]) if rng.random() < mixed else ("user", "assistant")[i % 2],
             rng.choice(texts)) for i in range(rng.randint(0, most))]


def test_repair_equals_all_edits():
    rng = random.Random(3)
    for _ in range(20):
        rows = random_turns(rng, 3)
        assert searched(rows)[:3] == tuple(brute_repair(rows)), rows


def test_long_repairs_equal_whole_audits():
    rng = random.Random(4)
    for _ in range(600):
        rows = random_turns(rng, 60)
        assert searched(rows)[:2] == plain_search(rows), rows


def test_resolved_edits_leave_the_tree():
    for rows in ([(i, ("user", "assistant")[i % 2], f"{i}.") for i in range(3000)], [(i, "user", "" if i > 3 else f"{i}.") for i in range(3000)],
                 [(i, "assistant" if i % 4 else "system", f"{i}.") for i in range(3000)], [(i, "user", f"{i}") for i in range(3000)]):
        emitted = [0]
        conversation = op12.Conversation(1, lambda letter, many, row: emitted.__setitem__(0, emitted[0] + many))
        for r in rows:
            conversation.add(*r, False)
        assert max(len(conversation.repair._edits(node)) for _, node in conversation.repair.alive.values()) < 20
        conversation.repair.finish()
        assert emitted[0] >= len(rows)


def test_query_equals_brute_force_on_damaged_turns(spark):
    found = {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op12_viterbi_repair"](spark, SF_SMALL).collect()}
    conversations = defaultdict(list)
    for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").collect():
        conversations[r["conv_id"]].append(tuple(r)[1:] if r.__fields__[0] == "conv_id" else (r["turn"], r["role"], r["text"]))
    assert set(found) == set(conversations)
    for conv_id, turns in conversations.items():
        rows = []
        for turn, role, text in turns:
            kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
            rows += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        fault = Counter(faults(rows))
        cost, audit, turns, conversation = searched(rows)
        assert (cost, audit) == plain_search(rows)
        given = [r[0] for r in rows if r[0] is not None]
        gaps = max(given) - min(given) + 1 - len(set(given)) if given else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
        assert found[conv_id] == (gaps, fault["blank"], fault["duplicate"], fault["truncated"], illegal, cost, audit, digest)


def test_odd_conversations(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (1, 2, "user", "Q?"), (1, 2, "user", "Q?"), (1, 3, "assistant", "A."), (1, None, "system", "S."),
            (2, 5, "assistant", "A."), (2, 9, "tool", "T."), (3, 1, "user", "")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, repeats int, conv string")
    got = {r["conv_id"]: r for r in op12.conversation_audits(df).collect()}
    assert {k: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["cost"], r["audit"]) for k, r in got.items()} == {
        None: (0, 1, 0, 0, 4, "DD"), 1: (0, 0, 1, 0, 2, "KKDK"), 2: (3, 0, 0, 0, 2, "RR"), 3: (0, 1, 0, 0, 2, "D")}
    assert got[3]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    turns = sorted(op12.repaired_turns(df).collect(), key=lambda r: (r["conv_id"], r["place"]))
    assert [tuple(r) for r in turns if r["conv_id"] == 1] == [(1, 0, "K", None, "system", "S."), (1, 1, "K", 2, "user", "Q?"), (1, 2, "K", 3, "assistant", "A.")]
    assert op12.conversation_audits(df.limit(0)).collect() == [] == op12.repaired_turns(df.limit(0)).collect()
    assert damaged(df.limit(0)).collect() == []
