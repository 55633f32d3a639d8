import math

import pytest
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.operators import fusion, lexical


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([("py", "python is fun"), ("java", "java is verbose"), ("rust", "rust memory safety rust"), ("none", None), ("empty", "")], "id string, text string")


def test_ranking(docs):
    c = lexical.corpus(docs, "id", "text")
    got = lexical.topk(c, "rust memory").collect()
    assert got[0]["id"] == "rust" and len(got) == 1
    assert lexical.topk(c, "absent").collect() == [] and lexical.topk(c, "").collect() == []


def test_idf_formula(spark):
    c = lexical.corpus(spark.createDataFrame([("1", "foo"), ("2", "foo bar")], "id string, text string"), "id", "text")
    idf = {r["term"]: r["idf"] for r in lexical.idf_table(c).collect()}
    assert abs(idf["foo"] - math.log((2 - 2 + 0.5) / (2 + 0.5) + 1)) < 1e-9 and idf["bar"] > idf["foo"]


def test_scores_by_hand(docs):
    c = lexical.corpus(docs, "id", "text")
    n, avg = 5, (3 + 3 + 4) / 5
    idf = math.log((n - 1 + 0.5) / 1.5 + 1)
    want = idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 4 / avg))
    assert abs(lexical.scores(c, "rust").first()["bm25_score"] - want) < 1e-9
    assert abs(lexical.scores(c, "rust rust").first()["bm25_score"] - 2 * want) < 1e-9


def test_length_normalisation_off(spark):
    c = lexical.corpus(spark.createDataFrame([("1", "a b c d"), ("2", "a b c d e")], "id string, text string"), "id", "text")
    s = {r["id"]: r["bm25_score"] for r in lexical.scores(c, "a", Settings(bm25_b=0.0)).collect()}
    assert s["1"] == s["2"]


def test_update_and_duplicates(spark, docs):
    c = lexical.corpus(docs, "id", "text")
    add = lexical.corpus(spark.createDataFrame([("go", "go memory"), ("py", "changed")], "id string, text string"), "id", "text")
    gone = spark.createDataFrame([("java",), ("missing",)], "id string")
    got = {r["id"]: r["dl"] for r in lexical.update(c, add, gone).collect()}
    assert got == {"py": 1, "rust": 4, "none": 0, "empty": 0, "go": 2}
    stored = spark.createDataFrame([("a", ["x", None, ""]), ("a", ["x", None, ""]), ("b", None), (None, ["x"])], "id string, tokens array<string>")
    assert {r["id"]: r["tokens"] for r in lexical.deduplicated(stored).collect()} == {"a": ["x"], "b": []}
    got = lexical.scores(stored, "x", repeated=True).collect()
    assert [r["id"] for r in got] == ["a"] and got == lexical.scores(lexical.deduplicated(stored), "x").collect()


def test_rows_by_repetition(spark):
    from tessera.operators.repeats import by_repetition

    rows = spark.range(2000).selectExpr("if(id < 900, 7, id) AS key", "id AS value").withColumn("key", F.when(F.col("value") == 1999, None).otherwise(F.col("key").cast("string")))
    one, more = by_repetition(rows, "key")
    a, b = {r["value"] for r in one.collect()}, {r["value"] for r in more.collect()}
    assert not a & b and a | b == set(range(1999)) and set(range(900)) <= b and len(a) > 1000
    assert one.columns == ["key", "value"]


def test_fusion(spark):
    sem = spark.createDataFrame([("a", 0), ("b", 1)], "id string, sem_rank int")
    lex = spark.createDataFrame([("b", 0), ("c", 1)], "id string, bm_rank int")
    got = [(r["id"], r["fused_score"]) for r in fusion.best(fusion.fuse(sem, lex), 10).collect()]
    assert [g[0] for g in got] == ["b", "a", "c"]
    assert abs(got[0][1] - (0.7 / 62 + 0.3 / 61)) < 1e-8
    assert fusion.best(fusion.fuse(sem.where("false"), lex), 10).count() == 2
