"""Weighted reciprocal rank fusion of two rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.config import Settings


def ranked(hits: DataFrame, score: str, out: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """0-based rank of each hit; the lists are short (twice the number of results) or partitioned by query."""
    w = W.partitionBy(*(by or [F.lit(1)])).orderBy(F.desc_nulls_last(score), "id")
    return hits.withColumn(out, F.row_number().over(w) - 1)


def fuse(semantic: DataFrame, lexical: DataFrame, settings: Settings = Settings(), by: list[str] = []) -> DataFrame:  # noqa: B006
    """by..., id, fused_score, sem_rank, bm_rank from rankings with sem_rank and bm_rank. An id in one list only gets that list's share."""
    k = settings.rrf_k
    part = lambda w, r: F.coalesce(F.lit(w) / (k + F.col(r) + 1), F.lit(0.0))
    both = semantic.select(*by, "id", "sem_rank").join(lexical.select(*by, "id", "bm_rank"), [*by, "id"], "full_outer")
    total = part(settings.hybrid_semantic_weight, "sem_rank") + part(settings.hybrid_bm25_weight, "bm_rank")
    return both.withColumn("fused_score", F.round(total, 9)).select(*by, "id", "fused_score", "sem_rank", "bm_rank")


def best(fused: DataFrame, n: int) -> DataFrame:
    """The n best; ties keep the semantic order first, then the lexical one."""
    return fused.orderBy(F.desc("fused_score"), F.asc_nulls_last("sem_rank"), F.asc_nulls_last("bm_rank"), "id").limit(n)
