"""Problem 7: mixing sources to target weights with a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import cut, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenisation pattern of the byte-level BPE vocabulary named above.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LATTICE = 1 << 31
STEP = 1327217885  # odd, about LATTICE / golden ratio: n * STEP mod LATTICE are the golden-ratio points
SLOT_CHUNK = 8192
MAX_SOURCES = 10_000


@lru_cache(maxsize=2)
def encoder(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as fh:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, fh)}
    return tiktoken.Encoding("mix", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_counts(text: Column, path: str = TOKENIZER) -> Column:
    """Tokens of each whole text; strings of special tokens are ordinary text; NULL gives NULL."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path)
        for s in batches:
            yield pd.Series([None if t is None else len(enc.encode_ordinary(t)) for t in s], dtype="Int64")

    return count(text)


def source_key(source: Column) -> Column:
    """One spelling per source: lower case, hyphens for underscores and white space."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[_\s]+", "-")


def sized(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """source, doc_id, n_tokens of the distinct texts of each targeted source. A text repeated within a source counts once
    (its smallest doc_id), since otherwise it would be used more than max_repeats times; only its hash is shuffled. NULL doc_id, NULL
    source, NULL and empty texts and sources without a target take no part."""
    keys = F.broadcast(targets.select("source"))
    rows = (
        spread(documents.select("doc_id", source_key(F.col("source")).alias("source"), "text").where(F.col("doc_id").isNotNull() & F.col("source").isNotNull() & (F.length("text") > 0)))
        .join(keys, "source")
        .select("doc_id", "source", F.sha2("text", 256).alias("_h"), token_counts(F.col("text"), path).alias("n_tokens"))
    )
    once = rows.groupBy("source", "_h").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"))
    return once.where(F.col("n_tokens") > 0).select("source", "doc_id", "n_tokens")


def clean_targets(targets: DataFrame) -> DataFrame:
    """One row per source spelling; NULL sources and non-positive weights drop out, NULL max_repeats count as 1."""
    return (
        targets.select(source_key(F.col("source")).alias("source"), "weight", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1)).alias("max_repeats"))
        .where(F.col("source").isNotNull() & (F.col("weight") > 0))
        .groupBy("source")
        .agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    )


def running(df: DataFrame, keys: list[str], bucket: str, order: list[Column], size: Column, out: str) -> DataFrame:
    """Exclusive running sum of size within keys in the order of (bucket, order...), without any task holding a whole key.

    Sums per bucket are few rows; their prefix is joined back, and the sum inside a bucket is a window over that bucket only.
    """
    tot = df.groupBy(*keys, bucket).agg(F.sum(size).alias("_t"))
    before = F.coalesce(F.sum("_t").over(W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    prefix = tot.select(*keys, bucket, before.alias("_b"))
    inner = F.coalesce(F.sum(size).over(W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_i", inner).join(prefix, [*keys, bucket]).withColumn(out, F.col("_b") + F.col("_i")).drop("_b", "_i")


def mix(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER, seed: int = 7, block_tokens: int | None = None, total_tokens: int | None = None, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(mix, shares).

    mix: slot, position, doc_id, source, repeat_no, n_tokens, in the order of training; shares: source, target_share, share, tokens,
    documents, most_repeats, cap for every target.

    total_tokens defaults to all tokens of the distinct texts of targeted sources. Each source gets its weight of this total, repeating
    its texts as often as that takes; one that would exceed its cap gives all its texts max_repeats times and stays short, so the total
    is less by that, and the shares tell what was reached. exact lowers the total to the largest that meets every target within its
    cap (the scarcest source sets it). Sources with a target but no text get share 0 and the others keep their proportions. Slot n maps
    the golden-ratio point of n through the cumulative shares to a source, and the k-th slot of a source takes the k-th block of about
    block_tokens tokens of that source's shuffled texts (reshuffled for each repeat). What comes out differs from what was planned by
    about one block a source. Empty tables give
    an empty mix. The targets are a fixed small table; more than MAX_SOURCES raise.
    """
    spark = documents.sparkSession
    want = clean_targets(targets)
    rows = want.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources have targets")
    docs = cut(sized(documents, want, path))
    size = {r["source"]: (r["t"], r["n"]) for r in docs.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    live = sorted((r for r in rows if r["source"] in size), key=lambda r: r["source"])
    whole = sum(r["weight"] for r in live)
    most = {r["source"]: r["max_repeats"] * size[r["source"]][0] for r in live}
    total = sum(size[r["source"]][0] for r in live) if total_tokens is None else total_tokens
    if exact:
        fits = int(min((most[r["source"]] * whole / r["weight"] for r in live), default=0))
        total = fits if total_tokens is None else min(fits, total)
    given = {r["source"]: min(total * r["weight"] / whole, most[r["source"]]) for r in live}
    block = block_tokens or min(1 << 20, max(64, int(sum(given.values())) // 4096))
    if not exact:  # room for the last block, which is not full, of what comes out whole
        given = {k: x + 2 * block if x == most[k] else x for k, x in given.items()}
    total = sum(given.values())
    share = {k: x / total for k, x in given.items()}
    slots = int(total // block)
    ends, at = [], 0.0
    for r in live:
        at += share[r["source"]]
        ends.append(at)
    names = F.array(*[F.lit(r["source"]) for r in live]) if live else F.array().cast("array<string>")
    marks = F.array(*[F.lit(int(e * LATTICE)) for e in ends[:-1]]) if len(ends) > 1 else F.array().cast("array<int>")
    point = (F.col("slot") * F.lit(STEP)) % F.lit(LATTICE)
    chosen = F.size(F.filter(marks, lambda m: m.cast("bigint") <= point)) + 1
    schedule = (
        spark.range(slots, numPartitions=max(1, min(64, slots // 100_000 + 1)))
        .withColumnRenamed("id", "slot")
        .select("slot", F.get(names, chosen - 1).alias("source"), F.floor(F.col("slot") / SLOT_CHUNK).alias("_c"))
    )
    schedule = running(schedule, ["source"], "_c", [F.col("slot")], F.lit(1), "block").select("source", "block", "slot")

    repeats = {r["source"]: min(r["max_repeats"], math.ceil((slots * share[r["source"]] + 4) * block / size[r["source"]][0])) for r in live}
    plan = [(r["source"], repeats[r["source"]], max(1, size[r["source"]][1] // 20_000), int((slots * share[r["source"]] + 8) * block)) for r in live]
    plan_df = F.broadcast(spark.createDataFrame(plan, "source string, _e int, _nb long, _need long"))
    copies = (
        docs.join(plan_df, "source")
        .withColumn("repeat_no", F.explode(F.sequence(F.lit(1), F.col("_e"))))
        .withColumn("_h", F.xxhash64(F.lit(seed), "repeat_no", "doc_id"))
        .withColumn("_k", F.col("repeat_no") * F.col("_nb") + F.pmod(F.col("_h"), F.col("_nb")))
    )
    placed = running(copies, ["source"], "_k", [F.col("_h"), F.col("doc_id")], F.col("n_tokens"), "_at").where(F.col("_at") < F.col("_need"))
    placed = placed.withColumn("block", F.floor(F.col("_at") / F.lit(block)))
    out = placed.join(schedule, ["source", "block"]).select("slot", (F.col("_at") % F.lit(block)).alias("position"), "doc_id", "source", "repeat_no", "n_tokens")

    got = out.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.countDistinct("doc_id").alias("documents"), F.max("repeat_no").alias("most_repeats"))
    everything = F.sum(F.coalesce("tokens", F.lit(0))).over(W.partitionBy(F.lit(0)))  # over one row a target
    shares = (
        want.join(got, "source", "left")
        .select(
            "source",
            F.col("weight").alias("target_share"),
            (F.coalesce("tokens", F.lit(0)) / F.greatest(everything, F.lit(1))).alias("share"),
            F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.coalesce("documents", F.lit(0)).alias("documents"),
            F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
            F.col("max_repeats").alias("cap"),
        )
    )
    return out, shares


def checked(mixed: DataFrame, documents: DataFrame, targets: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """source, texts (distinct texts there are), once: no text comes twice in one repeat; capped: no text more often than max_repeats; met: the
    share of the whole is reached within the tolerance, or all texts came max_repeats times."""
    want = clean_targets(targets)
    texts = documents.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select(source_key(F.col("source")).alias("source"), F.sha2("text", 256).alias("h"))
    have = texts.groupBy("source").agg(F.countDistinct("h").alias("texts"))
    uses = mixed.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("repeat_no").alias("r"), F.sum("n_tokens").alias("t"))
    got = uses.groupBy("source").agg(F.sum("t").alias("t"), F.max("n").alias("most"), F.bool_and(F.col("n") == F.col("r")).alias("once"), F.sum("n").alias("rows"))
    whole = got.agg(F.sum("t")).scalar()
    all_weight = want.join(have, "source", "left_semi").agg(F.sum("weight")).scalar()
    rows = want.join(have, "source", "left").join(got, "source", "left")
    n = F.coalesce("texts", F.lit(0))
    spent = F.coalesce("rows", F.lit(0)) >= n * F.col("max_repeats")
    return rows.select(
        "source", n.cast("bigint").alias("texts"), F.coalesce("once", F.lit(True)).alias("once"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("capped"),
        (spent | (F.coalesce(F.col("t") / whole, F.lit(0.0)) >= F.col("weight") / all_weight - tolerance)).alias("met"),
    )
