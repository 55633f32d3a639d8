import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import splitting, terms


def test_terms(spark):
    rows = [("1", ["a", "a", "b", None, ""]), ("1", ["a", "a", "b", None, ""]), ("2", ["a"]), ("3", []), ("4", None), ("5", [None, ""]), (None, ["z"]), ("6", ["a", "é"])]
    df = spark.createDataFrame(rows, "id string, tokens array<string>").withColumns({"term": F.lit("clash"), "n": F.lit(1), "records": F.lit(2)})
    got = {r["term"]: (r["occurrences"], r["records"], r["mark"]) for r in terms.frequencies(df).collect()}
    assert got == {"a": (4, 3, "common"), "b": (1, 1, "rare"), "é": (1, 1, "rare")}
    assert terms.frequencies(df.where("false")).count() == 0
    skew = spark.range(5000).select(F.concat(F.lit("r"), "id").alias("id"), F.array(F.lit("hot"), F.concat(F.lit("t"), F.col("id") % 100)).alias("tokens"))
    out = {r["term"]: r for r in terms.frequencies(skew).collect()}
    assert out["hot"]["records"] == 5000 and out["hot"]["mark"] == "common" and out["t7"]["occurrences"] == 50 and out["t7"]["mark"] is None


def items(spark, texts, size, overlap):
    rows = [(str(i), t, size, overlap) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "k string, text string, chunk_size int, chunk_overlap int").withColumns({"piece": F.lit("clash"), "_raw": F.lit(0)})


@pytest.mark.parametrize("size,overlap", [(10, 0), (10, 4), (7, 30), (1, 1), (200, 50)])
def test_round_trip(spark, size, overlap):
    rng = random.Random(size)
    texts = [None, "", "x" * 95, "\U0001f600" * 40, *("".join(rng.choice(["ab", " ", "\n", "\n\n", ". ", "é", "漢", "\U0001f600", "\r\n\r\n"]) for _ in range(rng.randrange(1, 90))) for _ in range(60))]
    got: dict = {}
    for r in splitting.split(items(spark, texts, size, overlap).drop("piece"), ["k"]).collect():
        got.setdefault(r["k"], {})[r["chunk_index"]] = r["piece"]
    for i, t in enumerate(texts):
        pieces = [got.get(str(i), {})[j] for j in range(len(got.get(str(i), {})))]
        at = 0
        for j, p in enumerate(pieces):
            back = min(overlap, at) if j else 0
            assert p[:back] == t[at - back : at]
            raw = p[back:]
            assert 0 < len(raw) <= size and t[at : at + len(raw)] == raw
            at += len(raw)
        assert at == len(t or "")


def test_boundaries(spark):
    text = "First part here.\n\nSecond one. Third sentence goes on and on"
    got = [r["piece"] for r in splitting.split(items(spark, [text], 25, 0).drop("piece"), ["k"]).orderBy("chunk_index").collect()]
    assert got[0] == "First part here.\n\n" and got[1] == "Second one. Third "
    assert "".join(got) == text


def test_boundary_in_the_first_half(spark):
    texts = ["ab " + "x" * 9, "a.\n\nb " + "y" * 18 + " z", "aa bb " + "w" * 45 + " c"]
    got: dict = {}
    for r in splitting.split(items(spark, texts, 20, 0).withColumn("chunk_size", F.array(F.lit(10), F.lit(20), F.lit(20))[F.col("k").cast("int")]).drop("piece"), ["k"]).orderBy("k", "chunk_index").collect():
        got.setdefault(r["k"], []).append(r["piece"])
    assert got == {"0": ["ab ", "x" * 9], "1": ["a.\n\n", "b ", "y" * 18 + " z"], "2": ["aa bb ", "w" * 20, "w" * 20, "w" * 5 + " c"]}
    over = [r["piece"] for r in splitting.split(items(spark, ["aa bb " + "w" * 45], 20, 8).drop("piece"), ["k"]).orderBy("chunk_index").collect()]
    assert over == ["aa bb ", "aa bb " + "w" * 20, "w" * 28, "w" * 13]


def test_oversized(spark):
    lim = spark.createDataFrame([("code", 5, 2), (None, 3, 1)], "content_type string, chunk_size int, chunk_overlap int")
    ex = spark.createDataFrame([(1, "  abcde \n", "code", "d", "f", None), (2, "abcdef", "code", "d", "f", {"k": "v"}), (3, "abcd", None, "d", "f", None), (4, None, "code", None, None, None), (5, "abcdefgh", "other", "d", "f", None)], "file_id bigint, text string, content_type string, directory string, file_path string, meta map<string,string>")
    ch = spark.createDataFrame([("a", "abcdefg", "code"), ("b", "abcdefgh", "code"), ("b", "abcdefgh", "code"), ("c", "abcde", "plain_text")], "id string, text string, content_type string").withColumns({"directory": F.lit("d"), "file_path": F.lit("f"), "meta": F.lit(None).cast("map<string,string>")})
    got = {(r["item_kind"], r["item_id"]) for r in splitting.oversized(ex, ch, lim).select("item_kind", "item_id").collect()}
    assert got == {("file", "2"), ("file", "3"), ("chunk", "b"), ("chunk", "c")}
    out = splitting.split_oversized(ex, ch, lim)
    assert out.where("item_id = 'b'").count() == 2 and out.where("item_id = '2'").first()["meta"] == {"k": "v"}
    assert splitting.split_oversized(ex.where("false"), ch.where("false"), lim).count() == 0


def test_no_hard_cut_where_a_piece_holds_a_boundary(spark):
    """Random texts of words of any length: the pieces give the text again, keep the limits, and cut inside a word only where there is no other way."""
    rng = random.Random(8)
    bits = ["a", "word", "x" * 30, "z" * 90, " ", "\n", "\n\n", ". ", "! ", "\t", "\u3000", "。", "é"]
    texts = ["Short first sentence here.\n\n" + "x" * 3000, " ".join(["word"] * 60) + " " + "y" * 900, *("".join(rng.choice(bits) for _ in range(rng.randrange(1, 200))) for _ in range(300))]
    rows = [("file", str(i), t, None, s, o) for i, t in enumerate(texts) for s, o in [(40, 0), (25, 7), (100, 60)]]
    for size, overlap in ((40, 0), (25, 7), (100, 60)):
        df = spark.createDataFrame([r for r in rows if r[4:] == (size, overlap)], "item_kind string, item_id string, text string, content_type string, chunk_size int, chunk_overlap int")
        limits = spark.createDataFrame([(None, size, overlap)], "content_type string, chunk_size int, chunk_overlap int")
        got = splitting.rebuilt(splitting.split(df, ["item_kind", "item_id"]), limits)
        want = {r[1]: r[2] for r in rows}
        done = got.collect()
        assert len(done) == len(texts) and all(r["n_chars"] == len(want[r["item_id"]]) and r["within"] and r["lapped"] and r["natural"] for r in done)
