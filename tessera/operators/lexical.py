"""BM25 over a table of token arrays."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.functions.text import tokens
from tessera.operators.repeats import by_repetition


def corpus(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, tokens, dl: tokenised once. NULL texts are documents without tokens."""
    t = F.coalesce(tokens(F.col(text_col)), F.array().cast("array<string>"))
    return docs.select(F.col(id_col).alias("id"), t.alias("tokens")).withColumn("dl", F.size("tokens"))


def _valid() -> Column:
    return F.filter(F.coalesce("tokens", F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != ""))


def deduplicated(stored: DataFrame) -> DataFrame:
    """id, tokens, dl of a stored corpus: one row per id (the greatest array), without NULL and '' elements. NULL ids drop out.

    Only the rows whose id repeats are shuffled.
    """
    one, more = by_repetition(stored.select("id", "tokens"), "id")
    once = one.select("id", _valid().alias("tokens")).unionByName(more.groupBy("id").agg(F.max(_valid()).alias("tokens")))
    return once.withColumn("dl", F.size("tokens"))


def term_frequency(c: DataFrame) -> DataFrame:
    return c.select("id", F.explode("tokens").alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(c: DataFrame) -> DataFrame:
    """Distinct terms are taken inside each row, so one shuffle by term suffices."""
    return c.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def idf_table(c: DataFrame) -> DataFrame:
    n = c.agg(F.count(F.lit(1))).scalar()
    return document_frequency(c).select("term", "df", idf(n, F.col("df")).alias("idf"))


def query_terms(query: str) -> Counter:
    """Terms of a query with their multiplicity: a repeated word counts that often."""
    return Counter(re.findall(r"\w+", query.lower()))


def _equals(term: str) -> Callable[[Column], Column]:
    return lambda x: x == F.lit(term)


def counted(c: DataFrame, query: str, repeated: bool = False) -> DataFrame:
    """id, dl and _tf0, _tf1, ... : how often each distinct term of the query occurs in each document's tokens.

    The few terms are counted inside each row, before anything else, so token arrays are never shuffled. With repeated, ids may occur
    several times and elements may be NULL or ''; then the row with the most tokens counts (ties by hash), found among the counts.
    """
    tf = [F.size(F.filter("tokens", _equals(t))).alias(f"_tf{i}") for i, t in enumerate(query_terms(query))]
    if not repeated:
        return c.select("id", "dl", *tf)
    rows = c.where(F.col("id").isNotNull()).select("id", _valid().alias("tokens")).select("id", F.size("tokens").alias("dl"), F.xxhash64("tokens").alias("_h"), *tf)
    names = ["dl", "_h", *[f"_tf{i}" for i in range(len(tf))]]
    return rows.groupBy("id").agg(F.max(F.struct(*names)).alias("_r")).select("id", "_r.*").drop("_h")


def score_counts(rows: DataFrame, query: str, settings: Settings = Settings()) -> DataFrame:
    """id, bm25_score of every document of `counted` with a positive score. The corpus statistics are a scalar subquery of one row."""
    terms = query_terms(query)
    if not terms:
        return rows.select("id", F.lit(0.0).alias("bm25_score")).where("false")
    found = [F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]
    seen = rows.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg"), *found).alias("s")).scalar()
    k1, b = settings.bm25_k1, settings.bm25_b
    total, some = F.lit(0.0), F.lit(False)
    for i, times in enumerate(terms.values()):
        f = F.col(f"_tf{i}")
        weight = f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("dl") / seen["avg"]))
        total = total + F.when(f > 0, times * idf(seen["n"], seen[f"df{i}"]) * weight).otherwise(0.0)
        some = some | (f > 0)
    return rows.where(some).select("id", total.alias("bm25_score")).where("bm25_score > 0")


def scores(c: DataFrame, query: str, settings: Settings = Settings(), repeated: bool = False) -> DataFrame:
    """id, bm25_score of every document with a positive score; see `counted` and `score_counts`."""
    return score_counts(counted(c, query, repeated), query, settings)


def best(scored: DataFrame, k: int) -> DataFrame:
    """The k best; scores are rounded to 6 decimals and ties ordered by id."""
    return scored.select("id", F.round("bm25_score", 6).alias("bm25_score")).orderBy(F.desc("bm25_score"), "id").limit(k)


def topk(c: DataFrame, query: str, k: int = 20, settings: Settings = Settings(), repeated: bool = False) -> DataFrame:
    return best(scores(c, query, settings, repeated), k)


def update(c: DataFrame, add: DataFrame | None = None, remove: DataFrame | None = None) -> DataFrame:
    """The corpus (or its counts for a query) without the ids of `remove` and with the rows of `add`; an added id replaces its stored row."""
    out = c
    if remove is not None:
        out = out.join(remove.select("id"), "id", "left_anti")
    if add is not None:
        out = out.join(add.select("id"), "id", "left_anti").unionByName(add.select(*c.columns))
    return out
