"""Problem 1: generated, minified, vendored and data-only source files - a random forest taught by header notices."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import cut, spread

SLOTS = 8
SALTS = 8
SAMPLE_PER_CLASS = 20_000  # files the forests are fitted on, at most, per class
TREES, DEPTH = 20, 9  # of each forest
LEAVES = 1000  # a leaf of the first step holds at least this part of the sample
FOUND = 0.5
FEWEST = 5  # labelled files needed to learn at all
SEED = 11

# Notices that tools and foreign projects leave in comments. They label a file and are removed before its features are taken.
_OPEN = r"^[ \t﻿]*(?://+!?|#+!?|/\*+!?|\*+|--+|<!--|;+|%+|\"\"\"|''')[ \t]*"
TOOL_NOTICE = re.compile(
    _OPEN
    + r"(?:@generated\b|<?auto-?generated\b|generated[ -]by[ :]|code generated by\b|(?:this (?:file|code) )?(?:was|is) (?:auto\w*|machine)[ -]?(?:generated|created|written)"
    r"|this file (?:was|is) (?:automatically )?(?:generated|created|produced)|do not (?:edit|modify|change) this file|produced from \S+ with\b|produced by \S+ (?:v?\d|from)|output of \S+ \(?v?\d"
    r"|fichier (?:produit|généré) par|automatisch (?:erzeugt|generiert)|generado (?:automáticamente|por)|wygenerowan|gerado (?:automaticamente|por)|автоматически (?:создан|сгенерирован)).*$",
    re.I | re.M,
)
PROJECT_NOTICE = re.compile(
    _OPEN
    + r"(?:spdx-license-identifier:|copyright (?:\(c\)|©) .*(?:authors|contributors|rights reserved)|\(c\) \d{4}\S* .*(?:authors|contributors)|use is governed by a \S+ licen[cs]e|originally from the \S+ project"
    r"|@licen[cs]e \S+ v?\d|@preserve\b|\S+ v?\d+\.\d+(?:\.\d+)?(?: \||[ \t]*(?:\*/)?[ \t]*$)|permission is (?:hereby )?granted\b|licensed under the\b).*$",
    re.I | re.M,
)
_TOOL_LINE, _PROJECT_LINE = (re.compile(p.pattern + r"(?:\r?\n)?", re.I | re.M) for p in (TOOL_NOTICE, PROJECT_NOTICE))
_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*")
_COMMENT = re.compile(r"^[ \t]*(?://|#(?!include|define|if|endif|else|undef|pragma)|\*|/\*|--).*$|\"\"\"[\s\S]*?\"\"\"|/\*[\s\S]*?\*/", re.M)
_LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|\b0[xX][0-9a-fA-F]+\b|-?\b\d[\d.eE+-]*\b")
_SPLIT_LINES = re.compile(r"\r\n|\r|\n")
_SUMS = ["chars", "packed", "names", "name_chars", "short_names", "tokens", "entropy", "comment", "lines", "blank", "space", "digits", "punct", "literal", "odd", "distinct", "body"]
_MAXES = ["longest_line", "longest_token", "tool", "project"]
_SLOT_COLS = [f"m{i}" for i in range(SLOTS)]
_MUL = np.random.default_rng(SEED).integers(1, 1 << 62, SLOTS, dtype=np.uint64) | np.uint64(1)
_NONE = (1 << 63) - 1


def measures(text: str) -> list:
    """Additive measures of one chunk (sums, maxima, minima), without its notices."""
    tool, project = TOOL_NOTICE.search(text) is not None, PROJECT_NOTICE.search(text) is not None
    if tool or project:
        text = _PROJECT_LINE.sub("", _TOOL_LINE.sub("", text))
    raw = text.encode("utf-8", "replace")
    n = len(text)
    tokens = _TOKEN.findall(text)
    counts = Counter(tokens)
    names = [t for t in counts if not t[0].isdigit()]
    weights = [counts[t] for t in names]
    total = len(tokens)
    entropy = -sum(c / total * math.log2(c / total) for c in counts.values()) if total else 0.0
    comment = sum(len(m) for m in _COMMENT.findall(text))
    lines = _SPLIT_LINES.split(text)
    code = [s for s in (x.strip() for x in lines) if s]
    odd = sum(len(m) for m in re.findall(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f�]", text))
    keys = [" ".join(s.split()) for s in code if len(s) > 40 and not s.startswith(("//", "#", "*", "/*", "import ", "from ", "--", '"""'))]
    if keys:
        h = np.array([xxhash.xxh64_intdigest(k.encode("utf-8", "replace")) for k in keys], np.uint64)
        mixed = h[:, None] * _MUL[None, :]
        mixed ^= mixed >> np.uint64(31)
        slots = ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)).min(0).astype(np.int64).tolist()
    else:
        slots = [_NONE] * SLOTS
    return [
        n, len(zlib.compress(raw, 1)), sum(weights), sum(len(t) * c for t, c in zip(names, weights)), sum(c for t, c in zip(names, weights) if len(t) <= 2), total, entropy * total,
        comment, len(lines), len(lines) - len(code), sum(map(text.count, " \t\n\r")), sum(c.isdigit() for c in text), n - sum(map(len, tokens)) - sum(map(text.count, " \t\n\r")),
        sum(len(m) for m in _LITERAL.findall(text)), odd, len(counts), len(keys),
        max(map(len, lines)), max(map(len, counts), default=0), int(tool), int(project), *slots,
    ]


_SCHEMA = "directory string, file_path string, " + ", ".join([f"{c} double" for c in _SUMS] + [f"{c} double" for c in _MAXES] + [f"{c} bigint" for c in _SLOT_COLS])


def chunk_measures(chunks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [measures(t) for t in b["text"]]
            out = pd.DataFrame(rows, columns=[*_SUMS, *_MAXES, *_SLOT_COLS])
            for c in (*_SUMS, *_MAXES):
                out[c] = out[c].astype("float64")
            out.insert(0, "file_path", b["file_path"].to_numpy())
            out.insert(0, "directory", b["directory"].to_numpy())
            yield out

    code = chunks.where((F.col("content_type") == "code") & (F.length("text") > 0) & F.col("file_path").isNotNull()).select("directory", "file_path", "text")
    return spread(code).mapInPandas(run, _SCHEMA)


FEATURES = [
    "ratio", "entropy_", "name_len", "short_share", "comment_share", "line_len", "blank_share", "space_share", "digit_share", "punct_share", "literal_share", "odd_share",
    "distinct_share", "repeat_lines", "longest_line_", "longest_token_", "shared_slots", "shared_bands", "places", "size", "body_lines",
]


def file_features(chunks: DataFrame) -> DataFrame:
    """One row per (directory, file_path) with FEATURES, tool and project (notice flags; a project's notice also counts where another
    checkout's copy of the same code, with four equal min-hashes, carries it).

    Texts never leave the task that reads them: every chunk becomes a row of measures that combine by sum, maximum and
    minimum (map side first). shared_slots counts the min-hash slots of a file's code lines that another checkout shares, places the
    checkouts that share the least shared of the upper ones; both are counted by partial aggregation, never by pairs.
    """
    per_file = (
        chunk_measures(chunks)
        .groupBy("directory", "file_path")
        .agg(*[F.sum(c).alias(c) for c in _SUMS], *[F.max(c).alias(c) for c in _MAXES], *[F.min(c).alias(c) for c in _SLOT_COLS])
    )
    files = cut(per_file)
    bands = [F.xxhash64(*_SLOT_COLS[: SLOTS // 2]), F.xxhash64(*_SLOT_COLS[SLOTS // 2 :])]
    salt = F.pmod(F.xxhash64("directory", "file_path"), F.lit(SALTS))  # a min-hash that a third of all files share is met in SALTS tasks
    slots = files.where(F.col("body") >= 3).select("directory", "file_path", "project", "body", salt.alias("salt"), F.posexplode(F.array(*_SLOT_COLS, *bands)).alias("slot", "h"))
    spread = slots.groupBy("slot", "h", "directory").agg(F.max("project").alias("p")).groupBy("slot", "h").agg(F.count(F.lit(1)).alias("dirs"), F.max("p").alias("noticed")).where("dirs > 1")
    spread = spread.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    kin = F.max(F.when((F.col("slot") >= SLOTS) & (F.col("body") >= 4), F.col("noticed")).otherwise(0.0))
    shared = slots.join(spread, ["slot", "h", "salt"]).groupBy("directory", "file_path").agg(
        F.count_if(F.col("slot") < SLOTS).alias("shared_slots"), F.count_if(F.col("slot") >= SLOTS).alias("shared_bands"), F.percentile_approx("dirs", F.lit(0.5)).alias("places"), kin.alias("kin")
    )
    n = F.greatest(F.col("chars"), F.lit(1.0))
    t = F.greatest(F.col("tokens"), F.lit(1.0))
    same = F.col("directory").eqNullSafe(F.col("_d")) & (F.col("file_path") == F.col("_p"))
    return (
        files.join(shared.withColumnsRenamed({"directory": "_d", "file_path": "_p"}), same, "left")
        .select(
            "directory", "file_path", "tool", F.greatest("project", F.coalesce("kin", F.lit(0.0))).alias("project"), (F.col("packed") / n).alias("ratio"), (F.col("entropy") / t).alias("entropy_"),
            (F.col("name_chars") / F.greatest(F.col("names"), F.lit(1.0))).alias("name_len"), (F.col("short_names") / F.greatest(F.col("names"), F.lit(1.0))).alias("short_share"),
            (F.col("comment") / n).alias("comment_share"), (F.col("chars") / F.greatest(F.col("lines"), F.lit(1.0))).alias("line_len"), (F.col("blank") / F.greatest(F.col("lines"), F.lit(1.0))).alias("blank_share"),
            (F.col("space") / n).alias("space_share"), (F.col("digits") / n).alias("digit_share"), (F.col("punct") / n).alias("punct_share"), (F.col("literal") / n).alias("literal_share"),
            (F.col("odd") / n).alias("odd_share"), (F.col("distinct") / t).alias("distinct_share"), (F.col("body") / F.greatest(F.col("lines"), F.lit(1.0))).alias("repeat_lines"),
            F.log1p("longest_line").alias("longest_line_"), F.log1p("longest_token").alias("longest_token_"), F.coalesce("shared_slots", F.lit(0)).cast("double").alias("shared_slots"),
            F.coalesce("shared_bands", F.lit(0)).cast("double").alias("shared_bands"), F.coalesce("places", F.lit(0)).cast("double").alias("places"), F.log1p("chars").alias("size"), F.col("body").alias("body_lines"),
        )
    )


HIDDEN = ("space_share", "longest_line_", "literal_share", "digit_share")  # what the shapes that label minified files and data blobs are told by
LEARNT = [c for c in FEATURES if c not in HIDDEN]
COPY = ["shared_slots", "shared_bands", "places", "body_lines"]


def shaped() -> Column:
    """Unmistakable minified files (no white space on very long lines) and data blobs (next to nothing but literals): two kinds that seldom carry
    a notice. They only teach; the columns that tell them are HIDDEN from the forest that learns from them."""
    minified = (F.col("space_share") < 0.06) & (F.col("longest_line_") > math.log1p(300))
    data = (F.col("literal_share") >= 0.6) | ((F.col("literal_share") >= 0.5) & (F.col("digit_share") >= 0.25))
    return (minified | data) & (F.col("odd_share") < 0.01)


def _weighted(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(df)


def _crossed(train: DataFrame, score: DataFrame, columns: list[str], label: str, depth: int, leaf: int, out: str) -> DataFrame:
    """score with `out`: the share of the votes for the label, of the forest fitted on the other fold's rows of train."""
    spec = RandomForestClassifier(labelCol=label, numTrees=TREES, maxDepth=depth, minInstancesPerNode=leaf, subsamplingRate=0.8, seed=SEED, maxBins=32, featureSubsetStrategy="0.4", weightCol="weight")
    known, df = _weighted(train, columns), _weighted(score, columns)
    for k in (0, 1):
        forest = spec.fit(known.where(F.col("fold") == k))
        forest.setFeaturesCol("features").setPredictionCol(f"_y{k}").setProbabilityCol(f"_p{k}").setRawPredictionCol(f"_r{k}")
        df = forest.transform(df)
    p = F.when(F.col("fold") == 1, vector_to_array("_p0")[1]).otherwise(vector_to_array("_p1")[1])
    return df.select(*score.columns, p.alias(out))


def _both(df: DataFrame, label: str) -> bool:
    """Whether both folds hold both classes."""
    return df.select("fold", label).distinct().count() == 4


def classify(chunks: DataFrame) -> DataFrame:
    """directory, file_path, label (a header notice), score (the forest's), found (labelled, or a score of at least FOUND).

    Learning goes in two steps, on at most SAMPLE_PER_CLASS files of each class, each file scored by the forest that did not see its half:

    1. A shallow forest learns the notices of foreign projects from what checkouts share. Files without a notice that it scores above the
       average may be copies whose notice was taken away; they are no examples of hand-written files.
    2. A forest learns noticed and `shaped` files against the rest, without the columns that the labels are told by, and scores every file. Among
       the rest are cases too, so the score is divided by the mean of the noticed files' (learning from positive and unlabelled examples).

    NULL directories are one checkout; chunks without text or path take no part; repeated chunks weigh twice in ratios and change nothing
    else. Where too few files are labelled (fewer than FEWEST, or none in some half) nothing can be learnt and only noticed ones are found.
    """
    notice, foreign = (F.col("tool") > 0) | (F.col("project") > 0), (F.col("project") > 0).cast("double")
    marks = {"notice": notice, "case": (notice | shaped()).cast("double"), "foreign": foreign, "fold": F.pmod(F.xxhash64(F.lit(SEED), "directory", "file_path"), F.lit(2))}
    files = cut(file_features(chunks).withColumns(marks))
    n = {r["case"]: (r["n"], r["f"]) for r in files.groupBy("case").agg(F.count(F.lit(1)).alias("n"), F.sum("foreign").alias("f")).collect()}
    (pos, copied), rest = n.get(1.0, (0, 0)), n.get(0.0, (0, 0))[0]
    notices_only = files.select("directory", "file_path", F.col("notice").alias("label"), F.col("notice").cast("double").alias("score"), F.col("notice").alias("found"))
    if pos < FEWEST or rest < FEWEST:
        return notices_only
    hit = F.col("case") > 0
    h = F.pmod(F.xxhash64("directory", "file_path"), F.lit(1 << 20)) / (1 << 20)
    share = F.when(hit, min(1.0, SAMPLE_PER_CLASS / pos)).otherwise(min(1.0, SAMPLE_PER_CLASS / rest))
    # a row weighs as many files as it stands for, so that the sample's bound doesn't change the balance of the classes
    sample = cut(files.where(h < share).withColumn("weight", 1 / share).coalesce(2))
    known = sample
    if copied >= FEWEST and _both(sample, "foreign"):
        suspect = _crossed(sample, sample, COPY, "foreign", 4, max(4, sample.count() // LEAVES), "_c")
        known = cut(suspect.where(hit | (F.col("_c") <= copied / (pos + rest))))
    if not _both(known, "case"):
        return notices_only
    scored = cut(_crossed(known, files.select("directory", "file_path", "notice", "fold", *LEARNT), LEARNT, "case", DEPTH, 4, "p").select("directory", "file_path", "notice", "p"))
    c = scored.where("notice").agg(F.avg("p")).first()[0] or 0.5  # what a case can reach among cases that pass for others
    score = F.least(F.col("p") / F.lit(float(c)), F.lit(1.0))
    return scored.select("directory", "file_path", F.col("notice").alias("label"), score.alias("score"), (F.col("notice") | (score >= FOUND)).alias("found"))
