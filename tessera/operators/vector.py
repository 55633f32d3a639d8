"""Cosine search over a table of vectors."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """The vector scaled to length one, as float; one of length 0 stays as it is, NULL gives NULL."""
    scaled = lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x).cast("float"))
    return F.get(F.transform(F.array(norm(v)), scaled), F.lit(0))


def cosine(v: Column, query: list[float], scaled: bool = False) -> Column:
    """Cosine with a literal query vector in double precision; NULL for vectors of another length, with NULLs or of norm 0. For vectors that are
    stored at length one (scaled) their length is not computed again."""
    q = [float(x) for x in query]
    length = math.sqrt(sum(x * x for x in q))
    lit = F.array(*[F.lit(x) for x in q])
    dot = F.aggregate(F.zip_with(v, lit, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)
    if scaled:
        return F.when((F.size(v) == len(q)) & F.lit(length > 0), dot / F.lit(length or 1.0))
    n = norm(v)
    usable = (F.size(v) == len(q)) & (n > 0) & F.lit(length > 0)
    return F.when(usable, dot / (n * F.lit(length or 1.0)))


def matches(directory: str | None = None, path_contains: str | None = None, directory_col: str = "directory", path_col: str = "file_path") -> Column:
    """Conjunction of payload filters; none means all rows. The path filter is a literal, case-sensitive substring."""
    conds = []
    if directory is not None:
        conds.append(F.col(directory_col) == directory)
    if path_contains:
        conds.append(F.contains(F.col(path_col), F.lit(path_contains)))
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def topk(points: DataFrame, query: list[float], k: int, vector_col: str = "vector", id_col: str = "id", where: Column | None = None, unique: bool = True, scaled: bool = False) -> DataFrame:
    """points without the vector, plus score: the k highest; scores rounded to 6 decimals, ties by id. The filter runs below the sort.

    With unique ids this is one scan and TakeOrderedAndProject. Where ids may repeat, only (id, score) is grouped by id, and the
    payload of the k winners is fetched by a broadcast of those k ids; of repeated rows the one with the greatest payload counts.
    """
    rows = points.where(where) if where is not None else points
    scored = rows.withColumn("score", F.round(cosine(F.col(vector_col), query, scaled), 6)).where(F.col("score").isNotNull() & ~F.isnan("score")).drop(vector_col)
    if unique:
        return scored.orderBy(F.desc("score"), id_col).limit(k)
    win = scored.groupBy(id_col).agg(F.max("score").alias("_top")).orderBy(F.desc("_top"), id_col).limit(k)
    rest = [c for c in scored.columns if c != id_col]
    hit = scored.join(F.broadcast(win), id_col).where(F.col("score") == F.col("_top"))
    one = hit.groupBy(id_col).agg(F.max(F.struct(*rest)).alias("_r"))
    return one.select(id_col, "_r.*").orderBy(F.desc("score"), id_col)
