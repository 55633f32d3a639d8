"""The tools of the engine: each gives a DataFrame; the functions named render_* turn one into text."""

from __future__ import annotations

import functools
import os
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import embeddings
from tessera.functions.text import suffix
from tessera.operators import diff, fusion, lexical, overview, structure, vector
from tessera.operators import store as S
from tessera.operators.ingest import Index
from tessera.sources import filetree

HIT = ["id", "file_path", "text", "directory", "chunk_index", "score"]


def _ready(index: Index, directory: str) -> str:
    directory = os.path.abspath(directory)
    if not index.is_indexed(directory):
        index.ingest(directory)
    return directory


def _query_vector(index: Index, query: str) -> list[float]:
    return list(embeddings.provider(index.spec).embed([query])[0])


def search(index: Index, directory: str, query: str, n_results: int | None = None, everywhere: bool = True) -> DataFrame:
    """Hybrid search: twice the number of results from each ranking, fused, cut. The vectors of all directories are searched if `everywhere`; terms
    and their statistics are always those of the directory."""
    directory = _ready(index, directory)
    n = index.settings.clamp(n_results)
    chunks = index.chunks.read()
    scope = chunks if everywhere else chunks.where(F.col("directory") == directory)
    slim = scope.select("id", "vector")
    sem = vector.topk(slim, _query_vector(index, query), 2 * n, scaled=True)
    if not index.settings.hybrid_search_enabled:
        top = sem.orderBy(F.desc("score"), "id").limit(n)
    else:
        lex = lexical.topk(index.corpus(directory), query, 2 * n, index.settings)
        fused = fusion.fuse(fusion.ranked(sem, "score", "sem_rank"), fusion.ranked(lex, "bm25_score", "bm_rank"), index.settings)
        top = fusion.best(fused, n).withColumnRenamed("fused_score", "score")
    # payload columns are fetched for the winners only
    return scope.drop("vector", "tokens").join(F.broadcast(top.select("id", "score")), "id").select(*HIT).orderBy(F.desc("score"), "id")


def search_by_file(index: Index, directory: str, query: str, file_pattern: str, n_results: int | None = None) -> DataFrame:
    """Vector search among the files whose path contains the pattern; no fusion."""
    directory = _ready(index, directory)
    n = index.settings.clamp(n_results)
    return vector.topk(index.chunks.read().drop("tokens"), _query_vector(index, query), n, where=vector.matches(directory, file_pattern), scaled=True).select(*HIT)


def stats(index: Index) -> DataFrame:
    index.ensure()
    return S.stats(index.chunks.read(), index.spec.dim, index.spec.kind)


def ingest(index: Index, directory: str, force: bool = False, include_extensions=None, exclude_extensions=None) -> dict:
    return index.ingest(directory, force, include_extensions, exclude_extensions)


def check_status(index: Index, directory: str) -> DataFrame:
    directory = os.path.abspath(directory)
    index.ensure()
    here = index.chunks.read().where(F.col("directory") == directory).select("directory")
    delta = index.changes(directory).withColumn("directory", F.lit(directory))
    return diff.freshness(here, delta, ["directory"])


def _files(index: Index, directory: str) -> DataFrame:
    f = filetree.files(index.spark, directory, everyfile="true")
    return f.select(F.col("root").alias("directory"), F.col("rel_path").alias("file_path"), "size", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def get_context(index: Index, directory: str, fresh: bool = False) -> dict:
    """The overview of a directory as a small dictionary (every part is capped). It is kept with the directory's fingerprint (the git commit, or
    number and size of the files at the root) and served from there while that stays the same, unless `fresh`."""
    directory = os.path.abspath(directory)
    files = _files(index, directory).persist()
    now = overview.current_fingerprint(directory, files)
    kept = None if fresh else overview.cached(index.overviews, directory, now)
    if kept is not None:
        files.unpersist()
        return kept
    key = ["directory"]
    rows = lambda df: [r.asDict() for r in df.drop("directory").collect()]
    out = {
        "directory": directory,
        "total_files": files.count(),
        "languages": rows(overview.top_extensions(overview.extension_stats(files, key), key).orderBy("rank")),
        "manifests": rows(overview.manifests(files, key)),
        "key_files": rows(overview.key_files(files, key)),
        "dependencies": rows(overview.dependencies(files, key)),
        "structure": [r["line"] for r in overview.tree(files, key).orderBy("position").collect()],
    }
    files.unpersist()
    index.save_overview(directory, out, now)
    return out


def get_file_signatures(index: Index, directory: str, file_path: str = "") -> DataFrame:
    f = _files(index, os.path.abspath(directory)).where(structure.path_contains(F.col("file_path"), file_path))
    return structure.signatures(f, ["file_path"])


def get_dependency_graph(index: Index, directory: str, file_pattern: str = "") -> DataFrame:
    f = _files(index, os.path.abspath(directory)).where(structure.path_contains(F.col("file_path"), file_pattern))
    code = f.where(suffix(F.col("file_path")).isin(*structure.FAMILY))
    return structure.graph(structure.edges(structure.imports(code, ["file_path"]), f)).orderBy("src")


# --- text (the wording is a fixed value) ---------------------------------------------------------------------------------------------------------------------------


def render_hits(hits: DataFrame, query: str, directory: str, pattern: str | None = None) -> str:
    rows = hits.collect()
    if not rows:
        also = f" matching file pattern '{pattern}'" if pattern else ""
        return f"No results found for '{query}'{also} in {directory}"
    return "\n".join(f"--- {r['file_path'] or 'unknown'} (score: {r['score']:.3f}) ---\n{r['text'] or ''}\n" for r in rows)


def render_ingest(r: dict, directory: str, incremental: bool) -> str:
    if not r["files"] and not r["deleted"]:
        return f"Index is up to date for {directory}"
    if incremental:
        return f"Incrementally indexed {r['chunks']} chunks from {r['files']} files"
    return f"Ingested {r['chunks']} chunks from {r['files'] - r['failed']}/{r['files']} files ({r['seconds']:.1f}s)"


def render_signatures(found: DataFrame, files: int = 30) -> str:
    rows = found.orderBy("file_path", "position").collect()
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(r["file_path"], []).append(r)
    out = [f"Found signatures in {len(by)} files:"]
    for path in list(by)[:files]:
        out.append(f"\n## {path}")
        for r in by[path]:
            if r["type"] in ("class", "interface", "struct"):
                bases = f"({', '.join(r['bases'])})" if r["bases"] and r["type"] == "class" else f" extends {', '.join(r['bases'])}" if r["bases"] else ""
                out.append(f"  L{r['line']}: {r['type']} {r['name']}{bases}")
            else:
                ahead = "async " if r["type"] == "async_function" else ""
                back = f" -> {r['return_type']}" if r["return_type"] else ""
                out.append(f"  L{r['line']}: {ahead}def {r['name']}({', '.join(r['params'] or [])}){back}")
            if r["docstring"]:
                out.append(f"    # {r['docstring']}")
    return "\n".join(out)


def render_graph(g: DataFrame) -> str:
    rows = g.orderBy("src").collect()
    out = [f"Dependency graph ({len(rows)} files):"]
    for r in rows:
        out.append(r["src"])
        out += [f"  -> {t}" for t in r["targets"]]
    return "\n".join(out)


# How much of each part the text shows.
SHOWN_LANGUAGES, SHOWN_PATHS, SHOWN_DEPENDENCIES, SHOWN_LINES = 10, 5, 15, 50


def render_context(o: dict) -> str:
    """The overview as text. Headings and layout are fixed values."""
    out = [f"Directory: {o['directory']}", f"Total files: {o['total_files']}"]
    part = lambda title, lines: out.extend([f"\n## {title}", *lines]) if lines else None
    part("Languages (by file count)", [f"  {r['extension']:12s} {r['files']:4d} files  {r['lines']:6d} lines" for r in o["languages"][:SHOWN_LANGUAGES]])
    part("Project Type", [f"  {r['file']} → {r['label']}" for r in o["manifests"]])
    by: dict[str, list] = {}
    for r in o["key_files"]:
        by.setdefault(r["category"], []).append(r["file_path"])
    part("Key Files", [f"  {k}: {', '.join(v[:SHOWN_PATHS])}" for k, v in by.items()])
    needs = []
    for r in o["dependencies"]:
        needs.append(f"  {r['ecosystem']}: {r['name']} {r['version']}")
        needs += [f"    - {d}" for d in r["requires"][:SHOWN_DEPENDENCIES]]
        if (more := len(r["requires"]) - SHOWN_DEPENDENCIES) > 0:
            needs.append(f"    ... and {more} more")
    part("Dependencies", needs)
    more = len(o["structure"]) - SHOWN_LINES
    part("Directory Structure", [f"  {x}" for x in o["structure"][:SHOWN_LINES]] + ([f"  ... ({more} more entries)"] if more > 0 else []))
    return "\n".join(out)


# --- older names ---------------------------------------------------------------------------------------------------------------------


def _older(name: str, target: Callable) -> Callable:
    @functools.wraps(target)
    def call(*args, **kwargs):
        warnings.warn(f"{name} is deprecated, use {target.__name__}", DeprecationWarning, stacklevel=2)
        return target(*args, **kwargs)

    return call


search_codebase = _older("search_codebase", search)
search_codebase_by_file = _older("search_codebase_by_file", search_by_file)
get_codebase_context = _older("get_codebase_context", get_context)
collection_stats = _older("collection_stats", stats)
ingest_current_directory = _older("ingest_current_directory", ingest)
check_index_status = _older("check_index_status", check_status)
