import tracemalloc

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import leaks, neighbors

PASSAGE = "The quick brown fox jumps over a lazy dog while seven curious cats watch from the garden wall at noon"


def test_words():
    assert leaks.words("Ça va?​ He­llo—WORLD_x 12") == ["ça", "va", "hello", "world", "x", "12"]
    assert leaks.words("café") == leaks.words("CAFÉ") and leaks.words(None) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=12, max_size=12), st.lists(st.integers(1, 4), min_size=12, max_size=12))
def test_edit_distance(a, b):
    row = list(range(13))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    assert leaks.edit_distances(np.array([a]), np.array([b]))[0] == min(row[12], leaks.MAX_EDITS + 1)


def test_embedding_keeps_small_edits_near():
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (leaks.STEPS, 50)).astype(np.int64)
    near, far = [], []
    for _ in range(200):
        a = rng.integers(1, 50, 12).astype(np.int32)
        b, c = a.copy(), rng.integers(1, 50, 12).astype(np.int32)
        b[rng.integers(12)] = 0
        ea, eb, ec = (leaks.walk(x, np.array([0]), bits)[:, 0] for x in (a, b, c))
        near.append((ea != eb).mean())
        far.append((ea != ec).mean())
    assert np.mean(near) < 0.5 * np.mean(far)


def test_leaks(spark):
    w = PASSAGE.split()
    docs = [
        (1, "intro " + PASSAGE.upper() + " outro"), (2, "x " + " ".join(w[2:14]) + " y"), (3, "x " + " ".join(w[2:13]) + " y"), (4, "a\n" + "\n ".join(w[3:18]) + ", b"), (5, None), (6, ""), (7, "unrelated words only here"),
        (8, " ".join(w[:6] + ["changed"] + w[7:13])), (None, PASSAGE), (9, ("filler text " * 3000) + PASSAGE), (10, ", ".join(f"{x}​" for x in w)),
    ]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"item_id": F.lit(0), "edits": F.lit("clash")})
    items = spark.createDataFrame([(100, PASSAGE, "s"), (101, PASSAGE + " and then some more words follow here", "s"), (102, "too short", "s"), (103, None, "s"), (None, PASSAGE, "s")], "item_id bigint, text string, suite string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.exact_leaks(d, items).collect()}
    assert got == {(i, k) for i in (1, 2, 4, 9, 10) for k in (100, 101)}
    near = {(r["doc_id"], r["item_id"]): r["edits"] for r in leaks.leaks(d, items).collect()}
    assert near.get((8, 100)) == 1 and near[(1, 100)] == 0
    rep = {r["item_id"]: r["documents"] for r in leaks.report(d, items).collect()}
    assert rep == {100: 5, 101: 5}
    assert leaks.exact_leaks(d, items.where("false")).count() == 0 and leaks.exact_leaks(d.where("false"), items).count() == 0


def test_leaks_equal_brute_force_in_blocks(spark, data, monkeypatch):
    docs, items = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "eval_items"))
    grams: dict = {}
    for r in items.collect():
        x = leaks.words(r["text"])
        for i in range(len(x) - 11):
            grams.setdefault(tuple(x[i : i + 12]), set()).add(r["item_id"])
    want = set()
    for r in docs.collect():
        x = leaks.words(r["text"])
        for i in range(len(x) - 11):
            want |= {(r["doc_id"], k) for k in grams.get(tuple(x[i : i + 12]), ())}
    assert {tuple(r) for r in leaks.exact_leaks(docs, items).collect()} == want
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 3000)
    assert {tuple(r) for r in leaks.exact_leaks(docs, items).collect()} == want


@pytest.mark.parametrize("edits,shift", [(1, False), (2, False), (2, True)])
def test_recall_of_edited_passages(edits, shift):
    """Passages of 12 words with changed words, or (shift) a word deleted and one inserted."""
    rng = np.random.default_rng(edits)
    vocab = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(vocab[int(3000 * u**3)] for u in rng.random(60))) for i in range(150)]
    rows = []
    for n in range(600):
        w = items[n % 150][1].split()
        at = int(rng.integers(len(w) - 11))
        w = w[at : at + 12]
        if shift:
            del w[int(rng.integers(12))]
            w.insert(int(rng.integers(12)), vocab[int(rng.integers(3000))])
        else:
            for k in rng.choice(12, edits, replace=False):
                w[k] = "unheard"
        rows.append((n, " ".join(w)))
    met = {(d, i) for d, i, _, _ in leaks.scan(leaks.Index(items), pd.DataFrame(rows, columns=["doc_id", "text"]))}
    assert sum((n, n % 150) in met for n in range(600)) >= 0.9 * 600


def clustered(n, dim=64, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((20, dim))
    return (centres[rng.integers(20, size=n)] + 0.8 * rng.standard_normal((n, dim))).astype(np.float32)


def frame(spark, x, ids=None):
    return spark.createDataFrame([(str(i) if ids is None else ids[i], v.tolist()) for i, v in enumerate(x)], "id string, vector array<float>")


def brute(x, k=10):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return np.argsort(-s, 1)[:, :k], s


def test_recall(spark):
    x = clustered(3000)
    got: dict = {}
    for r in neighbors.neighbors(frame(spark, x)).collect():
        got.setdefault(int(r["id"]), {})[int(r["other_id"])] = r["score"]
    top, s = brute(x)
    assert all(len(got[i]) == 10 for i in range(len(x)))
    assert np.mean([len(set(top[i]) & set(got[i])) / 10 for i in range(len(x))]) >= 0.9
    assert all(abs(v - s[i, j]) < 1e-4 for i in range(0, 3000, 50) for j, v in got[i].items())


def test_hot_group_and_dirt(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "GROUP_MOST", 100)
    x = clustered(600, seed=1)
    x[:200] = x[0]
    bad = [("n", None), ("e", []), ("z", [0.0] * 64), ("s", [1.0] * 32), ("nan", [float("nan")] * 64), ("inf", [float("inf")] + [1.0] * 63), (None, [1.0] * 64)]
    df = frame(spark, x)
    df = df.union(df.limit(50)).union(spark.createDataFrame(bad, "id string, vector array<float>")).withColumns({"list": F.lit(1), "score": F.lit("clash")})
    rows = neighbors.neighbors(df).collect()
    per: dict = {}
    for r in rows:
        per.setdefault(r["id"], []).append(r)
    assert set(per) == {str(i) for i in range(600)} and all(len(v) == 10 and len({r["other_id"] for r in v}) == 10 for v in per.values())
    assert all(abs(r["score"] - 1) < 1e-5 for i in range(200) for r in per[str(i)])
    pairs = neighbors.similar_pairs(df).collect()
    assert len({(r["id_a"], r["id_b"]) for r in pairs}) == len(pairs) and all(r["id_a"] < r["id_b"] for r in pairs)


def test_products_of_a_hot_list_are_bounded():
    """Every vector is the same but for a few; the whole product of queries and candidates would take over 144 MB, its order 288 MB."""
    x = np.repeat(clustered(1), 6000, axis=0)
    x[::50] = clustered(120, seed=2)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    keys = np.arange(6500)
    both = np.concatenate([x, x[:500]])
    q, c = neighbors.Queries(x, keys[:6000], 10), neighbors.Lists(both, keys, (keys >= 6000).astype(int))
    tracemalloc.start()
    q.scan(np.arange(6000), c, *c.span[0])
    q.scan(np.arange(6000), c, *c.span[1])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250e6
    want = np.sort(x[:200] @ x.T - 2 * np.eye(200, 6000), axis=1)[:, :-11:-1]
    assert np.allclose(q.top[1:50], want[1:50], atol=1e-5) and (q.who[:200] != np.arange(200)[:, None]).all()


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_few(spark, n):
    got = neighbors.neighbors(frame(spark, clustered(max(n, 1))).limit(n)).count()
    assert got == n * (n - 1)


def test_two_levels_of_centres(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "FLAT_LISTS", 20)
    monkeypatch.setattr(neighbors, "SAMPLE", 1000)
    x = clustered(4000, seed=3)
    df = frame(spark, x).select(F.xxhash64("id").alias("h"), "vector")
    c = neighbors.fit_centres(df, 4000, neighbors.rotation(64))
    assert 40 <= len(c) <= 90 and np.allclose(np.linalg.norm(c, axis=1), 1, atol=1e-4)
