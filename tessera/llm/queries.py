"""Queries of the training-data operators, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import encoding, handwritten, leaks, mixing, neighbors, splitting, syntax, terms
from tessera.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_scored(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.classify(table(spark, d, "chunks"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_scored(spark, d).where("found").select("directory", "file_path")


def p2_split(spark: SparkSession, d: str) -> DataFrame:
    out = splitting.split_oversized(table(spark, d, "extractions"), table(spark, d, "chunks"), table(spark, d, "chunk_limits"))
    return out


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_split(spark, d).where("chunk_index > 0").select("item_kind", "item_id").distinct()


def p2_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    return splitting.rebuilt(p2_split(spark, d), table(spark, d, "chunk_limits"))


def p3_knn(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "points")
    return neighbors.with_payload(neighbors.neighbors(points), points)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.similar_pairs(table(spark, d, "points"))


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.frequencies(table(spark, d, "bm25_corpus"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_terms(spark, d).where("mark IS NOT NULL").select("term", "mark")


def p5_judged(spark: SparkSession, d: str) -> DataFrame:
    return syntax.judged(table(spark, d, "extractions"))


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(table(spark, d, "extractions"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_judged(spark, d).where("error IS NOT NULL").select("file_id").distinct()


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return leaks.report(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.exact_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p7_proof(spark: SparkSession, d: str) -> DataFrame:
    return mixing.checked(p7_mix(spark, d), table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_repaired(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_repaired(spark, d).select("doc_id")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_scored, p2_found, p2_rebuilt, p2_split, p3_found, p3_knn, p4_found, p4_terms, p5_found, p5_judged, p5_rates, p6_found, p6_leaks, p6_report, p7_mix, p7_proof, p7_shares, p8_found, p8_repaired)
}

_TERMS = """
WITH r AS (SELECT id, max(list_filter(tokens, lambda t: t IS NOT NULL AND t <> '')) AS tokens FROM bm25_corpus
           WHERE id IS NOT NULL AND tokens IS NOT NULL AND len(list_filter(tokens, lambda t: t IS NOT NULL AND t <> '')) > 0 GROUP BY id),
     e AS (SELECT id, unnest(tokens) AS term FROM r),
     n AS (SELECT count(*) AS n FROM r),
     t AS (SELECT term, count(*) AS occurrences, count(DISTINCT id) AS records FROM e GROUP BY term),
     m AS (SELECT term, occurrences, records,
                  CASE WHEN records < 3 THEN 'rare' WHEN records > 0.05 * n THEN 'common' END AS mark FROM t, n)
"""
_STRIP = r"regexp_replace(text, '^[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0b}]+|[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0b}]+$', '', 'g')"
ORACLES: dict[str, str] = {
    "p4_terms": _TERMS + "SELECT term, CAST(occurrences AS BIGINT) AS occurrences, CAST(records AS BIGINT) AS records, mark FROM m",
    "p4_found": _TERMS + "SELECT term, mark FROM m WHERE mark IS NOT NULL",
    "p2_found": f"""
SELECT 'file' AS item_kind, CAST(file_id AS VARCHAR) AS item_id FROM extractions x JOIN chunk_limits l
  ON coalesce(x.content_type, 'plain_text') = coalesce(l.content_type, 'plain_text') WHERE length({_STRIP}) > chunk_size
UNION
SELECT 'chunk', id FROM chunks c JOIN chunk_limits l
  ON coalesce(c.content_type, 'plain_text') = coalesce(l.content_type, 'plain_text') WHERE length(text) > chunk_size + chunk_overlap
""",
    "p2_rebuilt": f"""
SELECT 'file' AS item_kind, CAST(file_id AS VARCHAR) AS item_id, length({_STRIP}) AS n_chars, md5({_STRIP}) AS text_md5, true AS within, true AS lapped, true AS natural FROM extractions x JOIN chunk_limits l
  ON coalesce(x.content_type, 'plain_text') = coalesce(l.content_type, 'plain_text') WHERE length({_STRIP}) > chunk_size
UNION
SELECT 'chunk', id, length(text), md5(text), true, true, true FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length(text) DESC, text DESC) AS n FROM chunks) c JOIN chunk_limits l
  ON coalesce(c.content_type, 'plain_text') = coalesce(l.content_type, 'plain_text') WHERE n = 1 AND length(text) > chunk_size + chunk_overlap
""",
    "p3_found": """
WITH u AS (SELECT id, max(vector) AS v FROM points WHERE id IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NOT NULL AND isfinite(x))) = 64
                  AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY id),
     s AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v::DOUBLE[], b.v::DOUBLE[]) AS c FROM u a, u b WHERE a.id <> b.id),
     r AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY c DESC) AS n FROM s)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE n <= 10 AND c >= 0.9
""",
    "p6_found": r"""
WITH norm AS (SELECT 'd' AS kind, doc_id AS k, text FROM documents UNION ALL SELECT 'i', item_id, text FROM eval_items),
     w AS (SELECT kind, k, regexp_extract_all(regexp_replace(lower(strip_accents(regexp_replace(text, '[\x{ad}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{feff}\x{fe00}-\x{fe0f}]', '', 'g'))), '[\x{300}-\x{36f}]', '', 'g'), '[\p{L}\p{N}]+') AS w FROM norm),
     g AS (SELECT DISTINCT kind, k, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT kind, k, w, unnest(range(1, len(w) - 10)) AS i FROM w WHERE len(w) >= 12))
SELECT DISTINCT d.k AS doc_id, i.k AS item_id FROM g d JOIN g i ON d.g = i.g WHERE d.kind = 'd' AND i.kind = 'i'
""",
    "p7_proof": r"""
WITH k AS (SELECT regexp_replace(lower(trim(source)), '[_\s]+', '-', 'g') AS source FROM mix_targets WHERE source IS NOT NULL AND weight > 0),
     t AS (SELECT regexp_replace(lower(trim(source)), '[_\s]+', '-', 'g') AS source, count(DISTINCT text) AS texts FROM documents WHERE length(text) > 0 AND doc_id IS NOT NULL GROUP BY 1)
SELECT k.source, CAST(coalesce(max(texts), 0) AS BIGINT) AS texts, true AS once, true AS capped, true AS met FROM k LEFT JOIN t ON k.source = t.source GROUP BY k.source
""",
}
