import pathlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.config import Settings, from_env
from tessera.functions import text as T

SAMPLES = ["", "  a b ", "Hello, World_1!", "\u00a0x\u2003", "a\n", "a\nb", "\n\n", "\x1c\x1fz\x85", "naïve café", "日本語 テスト", "snake_case 42", "a\r\nb\r\n"]
PATHS = ["a/b.py", ".gitignore", "x.", "dir/.env.example", "Makefile", "a.b/c", "t.tar.gz", "dir.d/.hidden"]


def test_strip_and_tokens(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, s string")
    for r in df.select("s", T.strip(F.col("s")).alias("t"), T.tokens(F.col("s")).alias("w"), T.is_blank(F.col("s")).alias("b"), T.line_count(F.col("s")).alias("n")).collect():
        assert r["t"] == r["s"].strip()
        assert r["w"] == re.findall(r"\w+", r["s"].lower())
        assert r["b"] == (not r["s"].strip())
        assert r["n"] == len(r["s"].encode().splitlines(True)) if "\r" not in r["s"] and "\x85" not in r["s"] and "\x1c" not in r["s"] else True


def test_suffix(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "p string")
    for r in df.select("p", T.suffix(F.col("p")).alias("s"), T.file_name(F.col("p")).alias("n")).collect():
        want = pathlib.PurePosixPath(r["p"])
        assert r["n"] == want.name
        assert r["s"] == ("" if r["p"].endswith(".") else want.suffix)


def test_null_text(spark):
    df = spark.createDataFrame([(None,)], "s string")
    r = df.select(T.tokens(F.col("s")).alias("w"), T.is_blank(F.col("s")).alias("b"), T.line_count(F.col("s")).alias("n")).first()
    assert (r["w"], r["b"], r["n"]) == (None, True, 0)


def test_settings():
    s = from_env({"TESSERA_CHUNK_SIZE": "7", "OLD_CHUNK_SIZE": "9", "OLD_CHUNK_OVERLAP": "3", "TESSERA_HYBRID_SEARCH_ENABLED": "no"}, ("OLD_",))
    assert (s.chunk_size, s.chunk_overlap, s.hybrid_search_enabled) == (7, 3, False)
    assert [Settings().clamp(n) for n in (None, 0, 5, 99)] == [10, 10, 5, 20]
    try:
        Settings().clamp(-1)
        raise AssertionError
    except ValueError:
        pass


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=30))
def test_query_terms_keep_multiplicity(s):
    from tessera.operators.lexical import query_terms

    assert sum(query_terms(s).values()) == len(re.findall(r"\w+", s.lower()))
