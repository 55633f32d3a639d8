"""Queries of the retrieval engine over the test tables, and the SQL that checks those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.functions import embeddings
from tessera.functions import text as T
from tessera.operators import chunkers, diff, fusion, ingest, lexical, overview, structure, vector
from tessera.operators import store as S
from tessera.plans import chunk_sql, planted
from tessera.session import shared_dir, spread, table
from tessera.sources import extract, filetree, gitignore, registry

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

FILE = ["directory", "file_path"]
QUESTION = "normalize shared shard import"
PROBE = [((i * 7) % 13 - 6) / 10 for i in range(64)]
RULES = ["*.log", "docs/", "!docs/index.*", "/areas/*/tools/", "**/fixtures/", "# comment", "*.[ch]"]
_SQL_PROBE = "[" + ", ".join(map(str, PROBE)) + "]::DOUBLE[]"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _q(s: str) -> str:
    return s.replace("'", "''")


# --- current state of the files: of repeated extractions the one with the greatest file_id counts
_FILES_SQL = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY directory, file_path ORDER BY file_id DESC) AS rn FROM extractions) WHERE rn = 1)"
_NAME = "split_part(file_path, '/', -1)"
_SUFFIX = "regexp_extract(split_part(file_path, '/', -1), '.(\\.[^.]+)$', 1)"
_TOKENS_SQL = "(SELECT id, max(list_filter(coalesce(tokens, []), lambda t: t IS NOT NULL AND t <> '')) AS tokens FROM bm25_corpus WHERE id IS NOT NULL GROUP BY id)"
_DOC_TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"


def files(spark: SparkSession, d: str) -> DataFrame:
    return S.latest(table(spark, d, "extractions").select(*FILE, "text", "content_type", "meta", "file_id"), FILE, [F.col("file_id")])


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return lexical.deduplicated(table(spark, d, "bm25_corpus"))


def doc_corpus(spark: SparkSession, d: str) -> DataFrame:
    return lexical.corpus(table(spark, d, "documents"), "doc_id", "text")


# --- lexical
@query(f"SELECT doc_id, CAST(len({_DOC_TOKENS}) AS BIGINT) AS n_tokens FROM documents")
def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    return doc_corpus(spark, d).select(F.col("id").alias("doc_id"), F.col("dl").cast("bigint").alias("n_tokens"))


@query("SELECT id, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT id, unnest(tokens) AS term FROM " + _TOKENS_SQL + ") GROUP BY id, term")
def term_frequency(spark: SparkSession, d: str) -> DataFrame:
    return lexical.term_frequency(corpus(spark, d))


@query(f"SELECT term, CAST(count(DISTINCT doc_id) AS BIGINT) AS df FROM (SELECT doc_id, unnest({_DOC_TOKENS}) AS term FROM documents) GROUP BY term")
def document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return lexical.document_frequency(doc_corpus(spark, d))


@query(
    f"WITH c AS {_TOKENS_SQL}, n AS (SELECT count(*) AS n FROM c) SELECT term, CAST(df AS BIGINT) AS df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf"
    " FROM (SELECT term, count(DISTINCT id) AS df FROM (SELECT id, unnest(tokens) AS term FROM c) GROUP BY term), n"
)
def idf_table(spark: SparkSession, d: str) -> DataFrame:
    return lexical.idf_table(corpus(spark, d)).select("term", "df", F.round("idf", 6).alias("idf"))


def _bm25_sql(words: str, c: str = _TOKENS_SQL) -> str:
    values = ", ".join(f"('{w}', {n})" for w, n in lexical.query_terms(words).items())
    return f"""
WITH c AS (SELECT id, tokens, len(tokens) AS dl FROM {c}), q(term, qtf) AS (VALUES {values}),
     s AS (SELECT count(*) AS n, avg(dl) AS a FROM c),
     p AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, dl, unnest(tokens) AS term FROM c) WHERE term IN (SELECT term FROM q) GROUP BY id, dl, term),
     f AS (SELECT term, count(*) AS df FROM p GROUP BY term)
SELECT id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 6) AS bm25_score
FROM p JOIN q USING (term) JOIN f USING (term), s GROUP BY id ORDER BY bm25_score DESC, id LIMIT 20"""


@query(_bm25_sql(QUESTION))
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return lexical.topk(table(spark, d, "bm25_corpus"), QUESTION, 20, repeated=True)


@query(_bm25_sql("shard shard filter"))
def bm25_duplicate_terms(spark: SparkSession, d: str) -> DataFrame:
    return lexical.topk(table(spark, d, "bm25_corpus"), "shard shard filter", 20, repeated=True)


@query(
    _bm25_sql(
        QUESTION,
        f"(SELECT id, tokens FROM {_TOKENS_SQL} WHERE id NOT IN (SELECT id FROM bm25_corpus WHERE directory LIKE '%harborline-core' AND id IS NOT NULL)"
        f" UNION ALL SELECT 'doc-' || doc_id, {_DOC_TOKENS} FROM documents WHERE source = 'glossary')",
    )
)
def bm25_update(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "bm25_corpus").where(F.col("directory").like("%harborline-core") & F.col("id").isNotNull()).select("id").distinct()
    docs = table(spark, d, "documents").where("source = 'glossary'").withColumn("doc_id", F.concat(F.lit("doc-"), F.col("doc_id")))
    now = lexical.update(lexical.counted(table(spark, d, "bm25_corpus"), QUESTION, repeated=True), lexical.counted(lexical.corpus(docs, "doc_id", "text"), QUESTION), gone)
    return lexical.best(lexical.score_counts(now, QUESTION), 20)


# --- vectors
@query(f"SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], {_SQL_PROBE}), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return vector.topk(table(spark, d, "embeddings"), PROBE, 20, "embedding", "vec_id")


@query(f"SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], {_SQL_PROBE}), 6) AS score FROM embeddings WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 20")
def cosine_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return vector.topk(table(spark, d, "embeddings"), PROBE, 20, "embedding", "vec_id", F.col("label") == 3)


_GOOD = "len(vector) = 64 AND list_dot_product(vector::DOUBLE[], vector::DOUBLE[]) > 0 AND NOT list_contains(list_transform(vector, lambda x: x IS NULL), true)"
_POINTS_SQL = f"""SELECT id, any_value(file_path) AS file_path, any_value(directory) AS directory, max(round(list_cosine_similarity(vector::DOUBLE[], {_SQL_PROBE}), 6)) AS score
FROM points WHERE {_GOOD} AND NOT isnan(list_sum(vector::DOUBLE[]))"""


@query(f"SELECT * FROM ({_POINTS_SQL} GROUP BY id) ORDER BY score DESC, id LIMIT 20")
def points_topk(spark: SparkSession, d: str) -> DataFrame:
    return vector.topk(table(spark, d, "points").select("id", "file_path", "directory", "vector"), PROBE, 20, unique=False)


@query(f"SELECT * FROM ({_POINTS_SQL} AND directory = '/srv/checkouts/harborline-core' AND contains(file_path, 'src/') GROUP BY id) ORDER BY score DESC, id LIMIT 10")
def search_by_file(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "points").select("id", "file_path", "directory", "vector")
    return vector.topk(p, PROBE, 10, where=vector.matches("/srv/checkouts/harborline-core", "src/"), unique=False)


@query("SELECT DISTINCT directory, file_path FROM chunks WHERE contains(file_path, 'lib/') AND contains(lower(file_path), 'parse')")
def path_substring_search(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where(vector.matches(path_contains="lib/") & structure.path_contains(F.col("file_path"), "PARSE"))
    return c.select(*FILE).distinct()


# --- fusion
_SEM_SQL = f"SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS sem_rank FROM (SELECT * FROM ({_POINTS_SQL} GROUP BY id) ORDER BY score DESC, id LIMIT 20)"
_LEX_SQL = f"SELECT id, row_number() OVER (ORDER BY bm25_score DESC, id) - 1 AS bm_rank FROM ({_bm25_sql(QUESTION)})"
_SHARE = "round(coalesce(0.7 / (60 + sem_rank + 1), 0) + coalesce(0.3 / (60 + bm_rank + 1), 0), 9)"


@query(
    f"SELECT f.id, fused_score, any_value(c.file_path) AS file_path FROM (SELECT coalesce(s.id, b.id) AS id, {_SHARE} AS fused_score, sem_rank, bm_rank FROM ({_SEM_SQL}) s"
    f" FULL OUTER JOIN ({_LEX_SQL}) b ON s.id = b.id ORDER BY fused_score DESC, sem_rank NULLS LAST, bm_rank NULLS LAST, 1 LIMIT 10) f LEFT JOIN chunks c ON f.id = c.id GROUP BY f.id, fused_score"
)
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    sem = vector.topk(table(spark, d, "points").select("id", "vector"), PROBE, 20, unique=False)
    lex = lexical.topk(table(spark, d, "bm25_corpus"), QUESTION, 20, repeated=True)
    top = fusion.best(fusion.fuse(fusion.ranked(sem, "score", "sem_rank"), fusion.ranked(lex, "bm25_score", "bm_rank")), 10)
    paths = table(spark, d, "chunks").select("id", "file_path").join(F.broadcast(top.select("id")), "id").groupBy("id").agg(F.max("file_path").alias("file_path"))
    return top.join(paths, "id", "left").select("id", "fused_score", "file_path")


_ASKED = "SELECT query_id, id, max(score) AS score FROM semantic_hits WHERE score IS NOT NULL AND id IS NOT NULL GROUP BY query_id, id"
_STORED = "SELECT query_id, id, min(rank) AS rank FROM semantic_hits WHERE id IS NOT NULL GROUP BY query_id, id"


@query(
    f"WITH s AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS sem_rank FROM ({_ASKED})),"
    f" b AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY -rank DESC, id) - 1 AS bm_rank FROM ({_STORED}))"
    f" SELECT coalesce(s.query_id, b.query_id) AS query_id, coalesce(s.id, b.id) AS id, {_SHARE} AS fused_score, CAST(sem_rank AS BIGINT) AS sem_rank, CAST(bm_rank AS BIGINT) AS bm_rank"
    " FROM s FULL OUTER JOIN b ON s.query_id = b.query_id AND s.id = b.id"
)
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "semantic_hits").where("id IS NOT NULL")
    sem = hits.where("score IS NOT NULL").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    lex = hits.groupBy("query_id", "id").agg((-F.min("rank")).alias("score"))
    out = fusion.fuse(fusion.ranked(sem, "score", "sem_rank", ["query_id"]), fusion.ranked(lex, "score", "bm_rank", ["query_id"]), by=["query_id"])
    return out.select("query_id", "id", "fused_score", F.col("sem_rank").cast("bigint").alias("sem_rank"), F.col("bm_rank").cast("bigint").alias("bm_rank"))


# --- sources
def _case(col: str, pairs: dict[str, str]) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


_KINDS = {k: e.content_type for k, e in registry.resolved().items()}
_EXTRACTORS = {k: e.extractor for k, e in registry.resolved().items()}
_BY = lambda pairs: f"coalesce({_case(_NAME, pairs)}, {_case(f'lower({_SUFFIX})', pairs)})"


@query(
    f"SELECT file_path, extractor, content_type, CASE WHEN extractor = 'code' THEN coalesce({_case(_NAME, registry.NAME_LANGUAGES)}, {_case(f'lower({_SUFFIX})', registry.LANGUAGES)}, 'unknown') END AS language,"
    f" CASE WHEN extractor = 'structured' THEN {_case(f'lower({_SUFFIX})', registry.STRUCTURED)} WHEN extractor = 'markdown' THEN substr({_SUFFIX}, 2) END AS format"
    f" FROM (SELECT DISTINCT file_path, coalesce({_BY(_EXTRACTORS)}, 'text') AS extractor, coalesce({_BY(_KINDS)}, 'plain_text') AS content_type FROM extractions)"
)
def registry_dispatch(spark: SparkSession, d: str) -> DataFrame:
    paths = table(spark, d, "extractions").select("file_path").distinct()
    return registry.dispatch(paths).select("file_path", "extractor", F.col("content_type_").alias("content_type"), "language", "format")


_PRUNE_SQL = "NOT list_contains(list_transform(string_split(file_path, '/')[:-2], lambda x: starts_with(x, '.') OR x IN (" + ", ".join(f"'{x}'" for x in Settings().pruned) + ")), true)"


@query(f"SELECT DISTINCT directory, file_path FROM extractions WHERE lower({_SUFFIX}) IN ('.py', '.go', '.md') AND lower({_SUFFIX}) <> '.md' AND octet_length(encode(text)) <= 4000 AND {_PRUNE_SQL}")
def extension_filter(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("file_path")
    ok = filetree.included(p, ["py", ".GO", "md"], [".md"]) & filetree.within_size(F.octet_length("text"), Settings(max_file_size_bytes=4000)) & filetree.not_pruned(p)
    return table(spark, d, "extractions").where(ok).select(*FILE).distinct()


# the rules by hand, the last one first, since the last match decides
_IGNORED = r"""CASE WHEN regexp_matches(file_path, '(^|/)[^/]*\.[ch](/|$)') THEN true WHEN regexp_matches(file_path, '(^|/)fixtures/') THEN true
WHEN regexp_matches(file_path, '^areas/[^/]+/tools/') THEN true WHEN regexp_matches(file_path, '^docs/index\.[^/]*(/|$)') THEN false
WHEN regexp_matches(file_path, '(^|/)docs/') THEN true ELSE regexp_matches(file_path, '(^|/)[^/]*\.log(/|$)') END"""


@query(f"SELECT directory, CAST(count(*) AS BIGINT) AS kept, CAST(sum(length(file_path)) AS BIGINT) AS chars FROM (SELECT DISTINCT directory, file_path FROM extractions) WHERE NOT ({_IGNORED}) GROUP BY directory")
def gitignore_filter(spark: SparkSession, d: str) -> DataFrame:
    rules = gitignore.compile_lines(RULES)
    paths = table(spark, d, "extractions").select(*FILE).distinct().where(~gitignore.ignored(F.col("file_path"), rules))
    return paths.groupBy("directory").agg(F.count(F.lit(1)).alias("kept"), F.sum(F.length("file_path")).alias("chars"))


@query("SELECT file_id, coalesce(meta['language'], 'unknown') AS language, file_path, CAST(coalesce(cardinality(meta), 0) + CASE WHEN meta['language'] IS NULL THEN 2 ELSE 1 END AS INT) AS keys FROM extractions")
def metadata_merge(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "extractions")
    m = extract.merged_meta(F.create_map(F.lit("language"), F.lit("unknown"), F.lit("file_path"), F.col("file_path")), F.col("meta"))
    e = e.select("file_id", m.alias("m"))
    return e.select("file_id", F.col("m")["language"].alias("language"), F.col("m")["file_path"].alias("file_path"), F.size("m").alias("keys"))


# --- chunkers
@query()
def chunk_by_type(spark: SparkSession, d: str) -> DataFrame:
    return chunkers.chunk(files(spark, d), FILE).withColumn("meta", F.to_json("meta"))


@query(chunk_sql.exploded("doc_id", "documents WHERE text IS NOT NULL", chunk_sql.recursive("text", 1000, 200)))
def chunk_recursive(spark: SparkSession, d: str) -> DataFrame:
    pieces = chunkers.recursive(F.col("text"), 1000, 200)
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(pieces).alias("chunk_index", "chunk"))


@query(chunk_sql.exploded("doc_id", "documents WHERE text IS NOT NULL", chunk_sql.paragraph("text", 1000, 200)))
def chunk_paragraph(spark: SparkSession, d: str) -> DataFrame:
    pieces = chunkers.paragraph(F.col("text"), 1000, 200)
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(pieces).alias("chunk_index", "chunk"))


@query(chunk_sql.exploded("directory, file_path", f"{_FILES_SQL} WHERE text IS NOT NULL AND ends_with(file_path, '.csv')", chunk_sql.csv("text", 800)))
def chunk_csv(spark: SparkSession, d: str) -> DataFrame:
    rows = files(spark, d).where(F.endswith("file_path", F.lit(".csv")))
    return rows.select(*FILE, F.posexplode(chunkers.csv(F.col("text"), 800)).alias("chunk_index", "chunk"))


@query(
    "SELECT doc_id, CAST(i AS INT) AS chunk_index, CASE WHEN i > 0 THEN right(substr(text, (i - 1) * 500 + 1, 500), 50) || substr(text, i * 500 + 1, 500) ELSE substr(text, 1, 500) END AS chunk"
    " FROM (SELECT doc_id, text, unnest(range(0, CAST(floor((length(text) - 1) / 500) AS BIGINT) + 1)) AS i FROM documents WHERE length(text) > 0)"
)
def overlap_prefix(spark: SparkSession, d: str) -> DataFrame:
    cuts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 500).cast("int"))
    raw = F.transform(cuts, lambda i: F.substring("text", i * 500 + 1, F.lit(500)))
    docs = table(spark, d, "documents").where(F.length("text") > 0)
    return docs.select("doc_id", raw.alias("raw")).select("doc_id", F.posexplode(chunkers.with_overlap(F.col("raw"), 50)).alias("chunk_index", "chunk"))


@query("SELECT DISTINCT sha256(concat_ws(chr(0), directory, file_path, CAST(chunk_index AS VARCHAR))) AS chunk_key, directory, file_path, chunk_index FROM chunks")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    key = chunkers.chunk_id(F.col("directory"), F.col("file_path"), F.col("chunk_index"))
    return table(spark, d, "chunks").select(key.alias("chunk_key"), *FILE, "chunk_index").distinct()


@query("SELECT CAST(count(*) AS BIGINT) AS texts FROM documents WHERE trim(text, chr(32) || chr(9) || chr(10) || chr(13)) <> ''")
def nonblank_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("text").isNotNull() & ~T.is_blank(F.col("text"))).agg(F.count(F.lit(1)).alias("texts"))


# --- overview
_LINES = "CASE WHEN coalesce(text, '') = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END"
_EXT = f"CASE WHEN lower({_SUFFIX}) <> '' THEN lower({_SUFFIX}) ELSE '(' || {_NAME} || ')' END"
_STATS_SQL = f"SELECT directory, {_EXT} AS extension, CAST(count(*) AS BIGINT) AS files, CAST(sum({_LINES}) AS BIGINT) AS lines FROM {_FILES_SQL} GROUP BY 1, 2"


@query(_STATS_SQL)
def extension_stats(spark: SparkSession, d: str) -> DataFrame:
    return overview.extension_stats(files(spark, d), ["directory"])


@query(f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY directory ORDER BY files DESC, extension) AS INT) AS rank FROM ({_STATS_SQL})) WHERE rank <= 15")
def top_extensions(spark: SparkSession, d: str) -> DataFrame:
    return overview.top_extensions(overview.extension_stats(files(spark, d), ["directory"]), ["directory"])


@query(f"SELECT file_id, CAST({_LINES} AS BIGINT) AS lines FROM extractions")
def line_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extractions").select("file_id", T.line_count(F.col("text")).alias("lines"))


def _key_sql() -> str:
    named = ", ".join(f"('{c}', '{p}')" for c, ps in overview.KEY_FILES.items() for p in ps if not p.endswith("/") and "*" not in p)
    dirs = [(c, p) for c, ps in overview.KEY_FILES.items() for p in ps if p.endswith("/")]
    base = "(SELECT DISTINCT directory, file_path FROM extractions)"
    hits = f"SELECT directory, category, pattern, file_path FROM {base} JOIN (VALUES {named}) v(category, pattern) ON {_NAME} = pattern"
    hits += f" UNION ALL SELECT directory, 'tests', 'test_*.py', file_path FROM {base} WHERE regexp_matches({_NAME}, '^test_.*\\.py$')"
    out = f"SELECT directory, category, pattern, file_path FROM (SELECT *, row_number() OVER (PARTITION BY directory, category, pattern ORDER BY file_path) AS n FROM ({hits})) WHERE n <= 5"
    for c, p in dirs:
        out += f" UNION ALL SELECT DISTINCT directory, '{c}', '{p}', '{p}' FROM extractions WHERE starts_with(file_path, '{p}')"
    return out


@query(_key_sql())
def key_file_match(spark: SparkSession, d: str) -> DataFrame:
    return overview.key_files(table(spark, d, "extractions").select(*FILE), ["directory"])


@query("SELECT DISTINCT directory, file_path AS file, label FROM extractions JOIN (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in overview.MANIFESTS.items()) + ") m(name, label) ON file_path = name")
def manifest_detect(spark: SparkSession, d: str) -> DataFrame:
    return overview.manifests(table(spark, d, "extractions"), ["directory"])


@query(
    "SELECT directory, CAST(count(*) FILTER (WHERE NOT contains(file_path, '/')) AS VARCHAR) || ':' || CAST(coalesce(sum(octet_length(encode(text))) FILTER (WHERE NOT contains(file_path, '/')), 0) AS VARCHAR) AS fingerprint"
    f" FROM {_FILES_SQL} GROUP BY directory"
)
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return overview.fingerprint(files(spark, d).withColumn("size", F.octet_length("text").cast("bigint")), ["directory"])


_NODE = "lambda x: '0' || lower(x) || chr(0) || x"
_TREE_SQL = f"""
WITH b AS (SELECT DISTINCT directory, string_split(file_path, '/') AS p FROM extractions WHERE file_path IS NOT NULL),
     d AS (SELECT DISTINCT directory, p[1:k] AS d FROM (SELECT directory, p, unnest(range(1, least(len(p) - 1, 4) + 1)) AS k FROM b)),
     dr AS (SELECT directory, list_transform(d, {_NODE}) AS sort, len(d) - 1 AS depth, d[-1] || '/' AS name FROM d),
     f AS (SELECT directory, p[1:len(p) - 1] AS dir, p[-1] AS n FROM b WHERE len(p) <= 3),
     g AS (SELECT *, row_number() OVER (PARTITION BY directory, dir ORDER BY lower(n), n) AS i, count(*) OVER (PARTITION BY directory, dir) AS a FROM f),
     fr AS (SELECT directory, list_append(list_transform(dir, {_NODE}), CASE WHEN i <= 20 THEN '1' || lower(n) || chr(0) || n ELSE '2' END) AS sort, len(dir) AS depth,
                   CASE WHEN i <= 20 THEN n ELSE '... (' || (a - 20) || ' more files)' END AS name FROM g WHERE i <= 21),
     r AS (SELECT *, row_number() OVER (PARTITION BY directory ORDER BY sort) AS position FROM (SELECT * FROM dr UNION ALL SELECT * FROM fr))
SELECT directory, CAST(position AS INT) AS position, repeat('  ', depth) || name AS line FROM r WHERE position <= 100
"""


@query(_TREE_SQL)
def directory_tree(spark: SparkSession, d: str) -> DataFrame:
    return overview.tree(table(spark, d, "extractions").select(*FILE), ["directory"])


@query()
def project_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return overview.dependencies(files(spark, d), ["directory"]).withColumns({"requires": F.array_join("requires", ","), "dev_requires": F.array_join("dev_requires", ",")})


# --- structure
_JS = "('.js', '.ts', '.tsx', '.jsx')"


@query()
def signatures(spark: SparkSession, d: str) -> DataFrame:
    s = structure.signatures(files(spark, d).where("content_type = 'code'"), FILE)
    return s.withColumns({"params": F.array_join("params", ","), "bases": F.array_join("bases", ",")})


def _js_names(pattern: str) -> str:
    return f"SELECT directory, file_path, unnest(regexp_extract_all(text, '{_q(pattern)}', 1)) AS name FROM {_FILES_SQL} WHERE {_SUFFIX} IN {_JS} AND content_type = 'code'"


@query(
    "SELECT directory, file_path, type, name, CAST(count(*) AS BIGINT) AS n FROM ("
    + " UNION ALL ".join(f"SELECT directory, file_path, '{kind}' AS type, name FROM ({_js_names(p)})" for kind, p, _ in structure.PATTERNS["js"])
    + ") GROUP BY ALL"
)
def signatures_js(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d).where((F.col("content_type") == "code") & T.suffix(F.col("file_path")).isin(".js", ".ts", ".tsx", ".jsx"))
    return structure.signatures(f, FILE).groupBy(*FILE, "type", "name").agg(F.count(F.lit(1)).alias("n"))


def _js_imports(extra: str = "") -> str:
    each = [f"SELECT directory, file_path, {i} AS p, unnest(regexp_extract_all(text, '{_q(p)}', 1)) AS module FROM {_FILES_SQL} WHERE {_SUFFIX} IN {_JS} {extra}" for i, p in enumerate(structure.JS_IMPORTS)]
    return " UNION ALL ".join(each)


@query(f"SELECT directory, file_path, module, CAST(count(*) AS BIGINT) AS n FROM ({_js_imports()}) GROUP BY directory, file_path, module")
def imports_js(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d).where(T.suffix(F.col("file_path")).isin(".js", ".ts", ".tsx", ".jsx"))
    return structure.imports(f, FILE).groupBy(*FILE, "module").agg(F.count(F.lit(1)).alias("n"))


@query()
def dependency_edges(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    return structure.edges(structure.imports(f.where("content_type = 'code'"), FILE), f, ["directory"])


_CAND = "list_transform(['.ts', '.tsx', '.js', '.jsx', '/index.ts', '/index.js'], lambda e: regexp_replace(module, '^[./]+', '') || e)"


@query(
    f"WITH i AS (SELECT *, row_number() OVER () AS imp FROM ({_js_imports()}) WHERE starts_with(module, '.')), c AS (SELECT directory, file_path AS src, imp, unnest({_CAND}) AS dst, unnest(range(6)) AS n FROM i),"
    " h AS (SELECT c.directory, src, imp, arg_min(dst, n) AS dst FROM c JOIN (SELECT DISTINCT directory, file_path FROM extractions) f ON c.directory = f.directory AND c.dst = f.file_path WHERE dst <> src GROUP BY c.directory, src, imp)"
    " SELECT directory, src, dst, CAST(count(*) AS BIGINT) AS n FROM h GROUP BY directory, src, dst"
)
def dependency_graph_js(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    js = f.where(T.suffix(F.col("file_path")).isin(".js", ".ts", ".tsx", ".jsx"))
    return structure.edges(structure.imports(js, FILE), f, ["directory"]).groupBy("directory", "src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query()
def dependency_graph(spark: SparkSession, d: str) -> DataFrame:
    return structure.graph(dependency_edges(spark, d), ["directory"]).withColumn("targets", F.array_join("targets", ","))


# --- maintenance
_MANIFEST_SQL = "(SELECT directory, rel_path, md5 FROM (SELECT *, row_number() OVER (PARTITION BY directory, rel_path ORDER BY coalesce(mtime, -1) DESC, coalesce(size, -1) DESC, coalesce(md5, '') DESC) AS rn FROM manifest WHERE rel_path IS NOT NULL) WHERE rn = 1)"
_DIFF_SQL = (
    "SELECT coalesce(c.directory, o.directory) AS directory, coalesce(c.rel_path, o.rel_path) AS rel_path,"
    " CASE WHEN o.rel_path IS NULL THEN 'new' WHEN c.rel_path IS NULL THEN 'deleted' ELSE 'modified' END AS change"
    f" FROM (SELECT directory, file_path AS rel_path, md5(text) AS md5 FROM {_FILES_SQL}) c FULL OUTER JOIN {_MANIFEST_SQL} o ON c.directory = o.directory AND c.rel_path = o.rel_path"
    " WHERE o.rel_path IS NULL OR c.rel_path IS NULL OR c.md5 IS DISTINCT FROM o.md5"
)


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    order = [F.coalesce("mtime", F.lit(-1.0)), F.coalesce("size", F.lit(-1)), F.coalesce("md5", F.lit(""))]
    return S.latest(table(spark, d, "manifest").where("rel_path IS NOT NULL"), ["directory", "rel_path"], order)


@query(_DIFF_SQL)
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    now = files(spark, d).select("directory", F.col("file_path").alias("rel_path"), F.md5("text").alias("md5"))
    return diff.changes(now, _manifest(spark, d), ["directory", "rel_path"])


@query(f"SELECT directory, true AS has_changes, CAST(count(*) FILTER (WHERE change <> 'deleted') AS BIGINT) AS changed_files, CAST(count(*) FILTER (WHERE change = 'deleted') AS BIGINT) AS deleted_files FROM ({_DIFF_SQL}) GROUP BY directory")
def change_report(spark: SparkSession, d: str) -> DataFrame:
    return diff.report(snapshot_diff(spark, d), ["directory"])


@query(
    f"WITH r AS (SELECT directory, count(*) FILTER (WHERE change <> 'deleted') AS c, count(*) FILTER (WHERE change = 'deleted') AS g FROM ({_DIFF_SQL}) GROUP BY directory), h AS (SELECT DISTINCT directory FROM chunks)"
    " SELECT coalesce(h.directory, r.directory) AS directory, h.directory IS NOT NULL AS is_indexed, r.directory IS NOT NULL AS has_changes, CAST(coalesce(c, 0) AS BIGINT) AS changed_files, CAST(coalesce(g, 0) AS BIGINT) AS deleted_files,"
    " CASE WHEN h.directory IS NULL THEN 'ingestion needed' WHEN r.directory IS NOT NULL THEN 'consider re-indexing' ELSE 'ready to search' END AS recommendation"
    " FROM h FULL OUTER JOIN r ON h.directory = r.directory"
)
def freshness_report(spark: SparkSession, d: str) -> DataFrame:
    return diff.freshness(table(spark, d, "chunks"), snapshot_diff(spark, d), ["directory"])


@query(
    "SELECT id, file_path, n_chars FROM (SELECT id, max(file_path) AS file_path, CAST(max(length(text)) AS INT) AS n_chars FROM chunks WHERE id IS NOT NULL GROUP BY id)"
    " UNION ALL SELECT DISTINCT id, 'stored earlier', -1 FROM bm25_corpus WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM chunks WHERE id IS NOT NULL)"
    " UNION ALL SELECT 'old-' || id, 'stored earlier', -1 FROM (SELECT DISTINCT id FROM points WHERE id IS NOT NULL)"
)
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """Stored: stale rows for the ids of the corpus (replaced by the chunks') and for ids that no chunk has (kept)."""
    c = table(spark, d, "chunks").where("id IS NOT NULL").select("id", "file_path", F.length("text").alias("n_chars"))
    only = table(spark, d, "points").where("id IS NOT NULL").select(F.concat(F.lit("old-"), "id").alias("id")).distinct()
    stale = table(spark, d, "bm25_corpus").where("id IS NOT NULL").select("id").distinct().unionByName(only)
    old = stale.select("id", F.lit("stored earlier").alias("file_path"), F.lit(-1).alias("n_chars"))
    return S.upsert(old, S.latest(c, ["id"], [F.col("n_chars")]), ["id"])


@query("SELECT directory, CAST(count(*) AS BIGINT) AS chunks FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM semantic_hits h WHERE h.directory = c.directory AND h.file_path = c.file_path) GROUP BY directory")
def delete_by_key(spark: SparkSession, d: str) -> DataFrame:
    left = S.delete(table(spark, d, "chunks").select(*FILE), table(spark, d, "semantic_hits"), FILE)
    return left.groupBy("directory").agg(F.count(F.lit(1)).alias("chunks"))


@query("SELECT content_type, CAST(count(*) AS BIGINT) AS chunks FROM chunks WHERE directory IS DISTINCT FROM '/srv/checkouts/harborline-core' GROUP BY content_type")
def delete_directory(spark: SparkSession, d: str) -> DataFrame:
    left = S.delete_where(table(spark, d, "chunks").select("directory", "content_type", "file_path"), "/srv/checkouts/harborline-core")
    return left.groupBy("content_type").agg(F.count(F.lit(1)).alias("chunks"))


@query(
    "SELECT CAST(count(*) AS BIGINT) AS total_points, CAST(count(*) FILTER (WHERE len(vector) = 64) AS BIGINT) AS indexed_vectors, CASE WHEN count(*) > 0 THEN 'green' ELSE 'empty' END AS status, 'hash' AS provider, 'local' AS storage_mode FROM points"
)
def collection_stats(spark: SparkSession, d: str) -> DataFrame:
    return S.stats(table(spark, d, "points"), 64)


@query("SELECT DISTINCT m.directory FROM manifest m WHERE EXISTS (SELECT 1 FROM points p WHERE p.directory = m.directory)")
def indexed_directories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "manifest").select("directory").distinct().join(table(spark, d, "points").select("directory"), "directory", "left_semi")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def stream_incremental_upsert(spark: SparkSession, d: str) -> DataFrame:
    from tessera.streaming import incremental

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = table(spark, d, "events")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(f"{d}/events.parquet*")
    kept = S.Store(spark, f"{base}/events", ("user_id",))
    incremental.upsert_stream(source, kept, ["user_id"], ["ts", "event_id"], f"{base}/checkpoint")
    return kept.read().select("user_id", "event_id", "event_type", "value")


# --- providers
_BYTES = "list_transform(range(32), lambda i: (CAST('0x' || substr(h, 2 * i + 1, 2) AS INT) - 128) / 128.0)"


@query(
    f"SELECT doc_id, 384 AS dim, 1.0 AS length, round(CAST(CAST(v[1] / sqrt(12 * list_sum(list_transform(v, lambda x: x * x))) AS FLOAT) AS DOUBLE), 6) AS first"
    f" FROM (SELECT doc_id, {_BYTES} AS v FROM (SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL))"
)
def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    v = embeddings.embed(F.col("text"))
    e = spread(table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")).select("doc_id", v.alias("v"))
    return e.select("doc_id", F.size("v").alias("dim"), F.round(vector.norm(F.col("v")), 5).alias("length"), F.round(F.col("v")[0].cast("double"), 6).alias("first"))


@query("SELECT DISTINCT query_id, id, format('{:.3f}', score) AS shown FROM semantic_hits WHERE score IS NOT NULL")
def score_format(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "semantic_hits").where("score IS NOT NULL").select("query_id", "id", F.format_string("%.3f", "score").alias("shown")).distinct()


@query(f"WITH q AS (SELECT query_id, unnest({_DOC_TOKENS.replace('text', 'question')}) AS term FROM (SELECT DISTINCT query_id, question FROM semantic_hits WHERE question IS NOT NULL)) SELECT query_id, term, CAST(count(*) AS BIGINT) AS qtf FROM q GROUP BY query_id, term")
def question_terms(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "semantic_hits").where("question IS NOT NULL").select("query_id", "question").distinct()
    return q.select("query_id", F.explode(T.tokens(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


@query("SELECT directory, CAST(count(*) AS BIGINT) AS n, max(rank) AS most FROM (SELECT DISTINCT query_id, id, rank, directory FROM semantic_hits) GROUP BY directory")
def hits_by_directory(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "semantic_hits").select("query_id", "id", "rank", "directory").distinct()
    return h.groupBy("directory").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("most"))


@query(
    f"WITH x AS ({_DIFF_SQL}), o AS {_MANIFEST_SQL} SELECT o.directory, rel_path AS file_path, md5('was ' || md5) AS source FROM o ANTI JOIN x USING (directory, rel_path) WHERE md5 IS NOT NULL"
    f" UNION ALL SELECT f.directory, file_path, md5(text) FROM {_FILES_SQL} f JOIN x ON f.directory = x.directory AND f.file_path = x.rel_path WHERE change <> 'deleted' AND trim(text, chr(32) || chr(9) || chr(10) || chr(13)) <> ''"
)
def ingest_incremental(spark: SparkSession, d: str) -> DataFrame:
    """The index at the checkpoint, brought to the present by the changes since then (applied twice, as after a failure): each file's chunks come from
    the text that its meta names."""
    base = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    store = S.Store(spark, f"{base}/chunks", ("directory", "file_path"))
    source = lambda t: F.create_map(F.lit("source"), F.md5(t))
    was = F.concat(F.lit("was "), "md5")
    old = _manifest(spark, d).where("md5 IS NOT NULL").select("directory", "rel_path", was.alias("text"), F.lit(None).cast("string").alias("content_type"), source(was).alias("meta"))
    store.write(ingest.build_chunks(old, None))
    delta = snapshot_diff(spark, d)
    now = files(spark, d).select("directory", F.col("file_path").alias("rel_path"), "text", F.lit(None).cast("string").alias("content_type"), source(F.col("text")).alias("meta"))
    new = ingest.build_chunks(now.join(delta.where("change <> 'deleted'").select("directory", "rel_path"), ["directory", "rel_path"], "left_semi"), None)
    for _ in range(2):
        ingest.apply_changes(store, delta.select("directory", F.col("rel_path").alias("file_path")), new)
        store.clean()
    return store.read().select(*FILE, F.col("meta")["source"].alias("source")).distinct()


QUERIES.update(planted.QUERIES)
ORACLES.update(planted.ORACLES)
