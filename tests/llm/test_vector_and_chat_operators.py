"""Near-duplicate vectors, chat pairs and the pipeline against brute force, and edge cases."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest

from creditspark.llm.components import connected_components
from creditspark.llm.op09_itq_neardup import learn_rotations, near_vectors, pack_codes, table_plan
from creditspark.llm.op10_preference_chat import preference_pairs
from creditspark.llm.scratch import Scratch
from creditspark.llm.queries import ORACLES, QUERIES

VEC = "vec_id long, embedding array<float>, label int, unit string, keys string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y, "u", "k") for i, v, y in rows], VEC)


def test_recall_and_counts_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows, x, labels = [], [], []
    for c in range(30):
        base = rng.normal(size=64)
        for _ in range(40 if c else 700):  # one large cluster, more than a block
            x.append(base / np.linalg.norm(base) + rng.normal(size=64) * 0.0125)
            labels.append(c % 3)
    rows = [(i, v, y) for i, (v, y) in enumerate(zip(x, labels))]
    got = {r.vec_id: r for r in near_vectors(vectors(spark, rows)).collect()}
    unit = np.array([np.asarray(v, np.float32) for v in x], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & (np.array(labels)[:, None] == np.array(labels)) & ~np.eye(len(x), dtype=bool)
    n = near.sum(axis=1)
    links = np.array([got[i].n_links for i in range(len(x))])
    assert (links <= n).all() and links.sum() >= 0.9 * n.sum()
    assert all(got[i].kept == (got[i].component_id == i) for i in got)
    assert len({got[i].component_id for i in got if n[i]}) >= 1
    assert all(got[got[i].component_id].component_id == got[i].component_id for i in got)


@pytest.mark.parametrize("n, dims", [(40, 64), (500, 64), (600, 16), (4000, 64)])
def test_tables_find_planted_pairs_at_every_size(spark, n, dims):
    """Pairs just above the threshold, in tables of every size; all sizes go through the tables."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, dims)) + 0.3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, n, 4):  # the next vector at a cosine of 0.982
        side = rng.normal(size=dims)
        side -= side @ x[i] * x[i]
        x[i + 1] = 0.982 * x[i] + np.sqrt(1 - 0.982 ** 2) * side / np.linalg.norm(side)
    got = {r.vec_id: r for r in near_vectors(vectors(spark, [(i, v.tolist(), 3) for i, v in enumerate(x)])).collect()}
    near = x @ x.T >= 0.98
    np.fill_diagonal(near, False)
    assert all(got[i].n_links <= near[i].sum() for i in range(n))
    assert sum(r.n_links for r in got.values()) >= 0.95 * near.sum()


def test_a_repeated_id_takes_its_least_row(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (2, [1.0, 0.0], 2), (3, [0.0, 1.0], 1), (4, [1.0, 0.0], 2)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors(vectors(spark, rows)).collect())
    assert got == [(1, 0, 1), (2, 1, 2), (2, 1, 2), (3, 1, 2), (4, 0, 4)]


def test_keys_grow_with_the_table():
    widths = [table_plan(n, 64, 0.98)[0] for n in (10, 1000, 10_000, 10**6, 10**9)]
    assert widths == [8, 12, 16, 22, 32]
    width, parts, rotations = table_plan(10**6, 64, 0.98)
    assert width * parts <= 64 and parts * rotations > 12


def test_odd_vectors_link_with_nothing(spark):
    one = [1.0] * 8
    rows = [(1, one, 1), (2, one, 1), (3, one, 2), (4, one, None), (5, None, 1), (6, [0.0] * 8, 1), (7, [float("nan")] + one[1:], 1),
            (8, [float("inf")] + one[1:], 1), (9, [None] + one[1:], 1), (10, [1.0] * 5, 1), (11, [], 1), (None, one, 1), (2, one, 1), (12, [3e38] * 8, 1)]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(vectors(spark, rows)).collect()), key=str)
    linked = {r[0]: r for r in got}
    assert len(got) == len(rows)
    assert linked[1][1:] == (2, 1, True) and linked[2][1:] == (2, 1, False) and linked[12][1:] == (2, 1, False)
    assert all(linked[i][1:] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11))
    assert linked[None][1:] == (0, None, False)
    assert near_vectors(vectors(spark, [])).count() == 0
    assert near_vectors(vectors(spark, [(1, None, 1)])).first().component_id == 1


def test_lengths_of_a_minority_link_as_in_the_sql(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(5)
    rows = []
    for dims, clusters, n in ((8, 60, 12), (5, 4, 10), (16, 1, 2), (3, 1, 1)):  # 720 vectors, 40, 2 and 1
        for c in range(clusters):
            base = rng.normal(size=dims)
            rows += [(len(rows) + i, base / np.linalg.norm(base) + rng.normal(size=dims) * 0.002, c % 3) for i in range(n)]
    df = vectors(spark, rows)
    df.write.parquet(str(tmp_path / "v"))
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from read_parquet('{tmp_path}/v/*.parquet')")
    want = {r[0]: r for r in con.sql(ORACLES["op9_itq_neardup"]).fetchall()}
    got = {r.vec_id: tuple(r) for r in near_vectors(df).collect()}
    small = [i for i, v, _ in rows if len(v) != 8]
    assert len(got) == len(rows) and [got[i] for i in small] == [want[i] for i in small]
    assert sum(got[i][1] for i in got) >= 0.9 * sum(want[i][1] for i in want)


def test_rotation_balances_codes():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 16)) * np.linspace(0.1, 3, 16)
    mean, rotations = learn_rotations(x, 16, 2, 20)
    for r in rotations:
        bits = (x - mean) @ r >= 0
        assert abs(bits.mean(axis=0) - 0.5).max() < 0.1
    assert pack_codes(x, mean, rotations[0]).max() < 1 << 16


def test_components_of_chains_and_stars(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (300, 301), (301, 300)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.root for r in connected_components(Scratch(spark, "test"), df, "c").collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{100 + i: 100 for i in range(1, 50)}, 301: 300}
    assert connected_components(Scratch(spark, "test"), df.where("false"), "c").count() == 0


# ------------------------------------------------------------------ operator 10

TURN = "conv_id long, turn long, role string, text string, prompt string, c int"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], TURN)


def shown(role, text):
    return f"<|{role or 'user'}|>\n{text or ''}<|end|>\n"


def test_pairs_share_the_longest_prefix(spark):
    chosen = [(1, 0, "system", "s"), (1, 1, "user", "hé"), (1, 2, "assistant", "good"), (2, 0, "user", "q"), (2, 1, "assistant", "a"),
              (3, 0, "user", "only chosen"), (4, 0, "user", "x"), (4, 0, "user", "x"), (4, 1, None, None), (5, 0, "user", "a"), (5, 1, "assistant", "b")]
    rejected = [(1, 0, "system", "s"), (1, 1, "user", "hé"), (1, 2, "assistant", "bad"), (1, 3, "user", "why"), (2, 0, "user", "q"), (2, 1, "assistant", "a"),
                (4, 0, "user", "x"), (4, 1, None, None), (5, 0, "user", "a"), (None, 0, "user", "n")]
    got = {r.conv_id: r for r in preference_pairs(turns(spark, chosen), turns(spark, rejected)).collect()}
    one = got[1]
    assert (one.n_common, one.status) == (2, "pair")
    assert one.prompt == shown("system", "s") + shown("user", "hé")
    assert one.chosen == shown("assistant", "good") and one.rejected == shown("assistant", "bad") + shown("user", "why")
    spans = [(s.start, s.length, s.train) for s in one.rejected_mask]
    assert sum(n for _, n, _ in spans) == len(one.rejected)
    assert "".join(one.rejected[a:a + n] for a, n, t in spans if t) == "bad<|end|>\n"
    assert got[2].status == "identical" and got[2].chosen == "" and got[2].chosen_mask == []
    assert got[3].status == "one_sided" and got[None].status == "one_sided"
    assert got[4].n_common == 1 and got[4].chosen == shown("user", "x") + shown(None, None)
    assert got[5].status == "pair" and got[5].rejected == "" and got[5].chosen == shown("assistant", "b")
    empty = turns(spark, [])
    assert preference_pairs(empty, empty).count() == 0


def test_long_conversation(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", "word " * 50) for i in range(2000)]
    other = rows[:1500] + [(1, i, "assistant", "else") for i in range(1500, 1510)]
    r = preference_pairs(turns(spark, rows), turns(spark, other)).first()
    assert r.n_common == 1500 and len(r.chosen_mask) == 750 and sum(s.length for s in r.chosen_mask) == len(r.chosen)


# ------------------------------------------------------------------ queries and pipeline

def test_every_operator_has_a_query():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, name):
    sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
    from oracle_check import compare, duck

    folder = "/root/testdata/sf0.001"
    result = compare(name, QUERIES[name](spark, folder), duck(folder), ORACLES[name])
    assert result["status"] == "match", result


def test_pipeline_stages_match_brute_force(spark):
    import corpus_pipeline as cp
    from creditspark.llm.op07_toxicity import toxicity_scores
    from pyspark.sql import functions as F
    from test_text_operators import brute_components

    folder = "/root/testdata/sf0.001"
    scratch = Scratch(spark, "test")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    extra = docs.withColumn("score", F.lit("clash")).withColumn("component_id", F.lit(1))
    kept = extra
    for name, stage in cp.STAGES[:-1]:
        before = kept
        kept = scratch.table(stage(spark, before, folder), name)
        assert kept.columns == extra.columns
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity_scores(before, spark.read.parquet(f"{folder}/labels.parquet")).where("predicted = 1").collect()}
            assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in before.collect() if r.doc_id is None or r.doc_id not in bad)
        elif name == "jaccard_join":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            stay = {i for i, _, c in brute_components(rows) if i is not None and i == c}
            assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([*map(str, stay), "None"])
        else:
            assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in before.collect()}
    packed = cp.STAGES[-1][1](spark, kept, folder)
    ends = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("e")).collect()
    assert all(r.n == r.e <= 4096 for r in ends)
    assert packed.where("piece = 0").count() == kept.count()


def test_pipeline_filters_rows_of_repeated_and_null_ids(spark, tmp_path):
    import corpus_pipeline as cp
    from test_text_operators import toxic_rows

    rng = np.random.default_rng(3)
    text = lambda: " ".join(f"v{i}" for i in rng.integers(0, 5000, 40))
    x, y, z = text(), text(), text()
    docs = spark.createDataFrame([(3, x), (5, x), (5, y), (7, z), (None, z), (None, z), (None, z), (8, None), (8, None)], "doc_id long, text string").withColumn("row_key", cp.F.lit("clash"))
    kept = cp.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, x), (5, y), (7, z), (None, z), (8, None)], key=str)

    rows = toxic_rows(1400)
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bad, clean = next(t for _, t, y in rows if y), next(t for _, t, y in rows if not y)
    odd = [(5000, bad), (5000, clean), (None, bad), (None, bad), (None, clean)]
    docs = spark.createDataFrame([r[:2] for r in rows] + odd, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in cp.drop_toxic(spark, docs, str(tmp_path)).collect()]
    assert sorted((r for r in got if r[0] in (5000, None)), key=str) == sorted([(5000, clean), (None, clean)], key=str)


def test_pipeline_of_nothing(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, "/root/testdata/sf0.001").count() == 0
