import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunkers as C


def texts():
    rng = random.Random(4)
    alphabet = ["a", "bb", "\n", "\n\n", " ", "\u00a0", "\x1f", "漢字", "word", "é", ". "]
    return ["", "  ", "x" * 100, *("".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 120))) for _ in range(400))]


@pytest.mark.parametrize("size,overlap", [(40, 0), (40, 10), (7, 3)])
def test_native_recursive_equals_python(spark, size, overlap):
    df = spark.createDataFrame(list(enumerate(texts())), "i int, t string")
    for r in df.select("t", C.recursive(F.col("t"), size, overlap).alias("c")).collect():
        assert r["c"] == C.py_recursive(r["t"], size, overlap)


def test_recursive_expectations():
    f = C.py_recursive
    assert f("x" * 100, 100, 10) == ["x" * 100]
    assert f("   ", 50, 10) == [] and f("", 100, 20) == []
    assert f("A" * 60 + "\n\n" + "B" * 60, 80, 0) == ["A" * 60, "B" * 60]
    got = f("X" * 250, 100, 10)
    assert len(got) == 3 and all(len(c) <= 110 for c in got)
    two = f("p" * 90 + "\n\n" + "q" * 90, 110, 20)
    assert two[1].startswith(two[0][-20:])
    assert len(f(" ".join(["word"] * 40), 50, 0)) > 1


def test_paragraph_and_csv(spark):
    df = spark.createDataFrame([("a\n\nb\n\n" + "c" * 30, "h1,h2\n" + "\n".join(f"{i},row" for i in range(9)))], "p string, c string")
    r = df.select(C.paragraph(F.col("p"), 10, 2).alias("p"), C.csv(F.col("c"), 20).alias("c"), C.csv(F.lit("only,head"), 20).alias("h"), C.csv(F.lit(None).cast("string"), 9).alias("n")).first()
    assert r["p"] == ["a\n\nb", *C.py_recursive("c" * 30, 10, 2)]
    assert all(x.startswith("h1,h2\n") for x in r["c"]) and sum(x.count("row") for x in r["c"]) == 9
    assert r["h"] == [] and r["n"] == []


def test_code():
    src = "import os\n\n@deco\ndef a():\n    return 1\n\nclass B:\n    x = 1\n"
    assert C.python_blocks(src) == ["import os\n\n@deco", "def a():\n    return 1", "class B:\n    x = 1"]
    assert C.code(src, 1000, 0, "python") == ["import os\n\n@deco\ndef a():\n    return 1\nclass B:\n    x = 1"]
    assert C.python_blocks("def (") == ["def ("]
    js = "const x = 1;\nfunction a() {\n}\nclass B {\n}"
    assert C.line_blocks(js, "javascript") == ["const x = 1;", "function a() {\n}", "class B {\n}"]
    assert C.code("some text", 100, 0, "cobol") == ["some text"]


def test_markdown():
    assert C.markdown("intro\n# One\nbody\n## Two\n\n# Three\nend", 100, 0) == [("intro", None), ("body", "One"), ("end", "Three")]
    assert C.markdown("# Lone", 100, 0) == [("# Lone", "Lone")]
    assert C.markdown("# Lone\n", 100, 0) == [("# Lone", None)]
    assert C.markdown("", 10, 0) == []


def test_json():
    assert C.json_groups('{"a": 1, "b": [2, 3]}', 1000) == ['{\n  "a": 1,\n  "b": [\n    2,\n    3\n  ]\n}']
    assert len(C.json_groups('{"a": 1111, "b": 2222}', 14)) == 2
    assert C.json_groups("{}", 100) == [] and C.json_groups("[1]", 100) == ["[1]"] and C.json_groups("{bad", 100) == ["{bad"]


def test_dispatch(spark):
    rows = [
        ("a", "def f():\n  pass", "code", {"language": "python"}), ("b", "# T\nx", "markdown", {}), ("c", "h\n1\n2", "structured_data", {"format": "csv"}),
        ("d", '{"k": 1}', "structured_data", {"format": "json"}), ("e", "p\n\nq", "document", None), ("f", "plain", None, None), ("g", None, "code", None), ("h", " ", "markdown", {}),
    ]
    df = spark.createDataFrame(rows, "k string, text string, content_type string, meta map<string,string>")
    got = {r["k"]: (r["chunk"], r["section_title"]) for r in C.chunk(df, ["k"]).collect()}
    assert got == {"a": ("def f():\n  pass", None), "b": ("x", "T"), "c": ("h\n1\n2", None), "d": ('{\n  "k": 1\n}', None), "e": ("p\n\nq", None), "f": ("plain", None)}


def test_time_is_linear_in_the_text(spark):
    """A text of the largest size allowed, with the default overlap, by every chunker that packs in the JVM."""
    prose = "".join(f"Line {i} of a long file with some words in it.\n" + ("\n" if i % 9 == 0 else "") for i in range(25_000))[: 1 << 20]
    one_line = ("word " * 210_000)[: 1 << 20]
    table = "a,b,c\n" + "".join(f"{i},value,{i * 7}\n" for i in range(60_000))
    took = {}
    for name, text, pieces in [
        ("lines", prose, lambda t: C.recursive(t, 1000, 200)), ("words", one_line, lambda t: C.recursive(t, 1000, 200)), ("paragraphs", prose, lambda t: C.paragraph(t, 1000, 200)), ("csv", table[: 1 << 20], lambda t: C.csv(t, 800)),
    ]:
        for part in (text[: len(text) // 2], text):
            df = spark.createDataFrame([(part,)], "t string").select(F.size(pieces(F.col("t"))).alias("n"))
            best = None
            for _ in range(2):
                began = time.perf_counter()
                n = df.first()["n"]
                best = min(best or 1e9, time.perf_counter() - began)
            assert n > 500
            took[name, len(part)] = best
        half, whole = (v for k, v in took.items() if k[0] == name)
        assert whole < 5 and whole < 3 * half + 0.5, took


def test_registered_chunker(spark):
    df = spark.createDataFrame([("a", "p one\n\np two", "document", {"language": "x"}), ("b", "plain", None, None)], "k string, text string, content_type string, meta map<string,string>")
    C.register("document", lambda text, meta, size, overlap: [(w, meta["language"]) for w in text.split("\n\n")])
    try:
        got = sorted((r["k"], r["chunk_index"], r["chunk"], r["section_title"]) for r in C.chunk(df, ["k"]).collect())
    finally:
        C.register("document", None)
    assert got == [("a", 0, "p one", "x"), ("a", 1, "p two", "x"), ("b", 0, "plain", None)]
    assert sorted(r["chunk"] for r in C.chunk(df, ["k"]).collect()) == ["p one\n\np two", "plain"]
