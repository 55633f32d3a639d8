"""Code structure: signatures, imports and the import graph.

Signatures need match offsets or an AST, so they are taken in Python batches (also registered as a SQL table function); the graph is an
equi-join of candidate paths with the files that exist.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tessera.functions.text import suffix

SIGNATURE = "name string, type string, line int, params array<string>, return_type string, docstring string, bases array<string>"
FIELDS = ("name", "type", "line", "params", "return_type", "docstring", "bases")

# The patterns of each language with the meaning of their groups; '-' skips a group.
PATTERNS: dict[str, list[tuple[str, str, tuple[str, ...]]]] = {
    "js": [
        ("function", r"(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(([^)]*)\)", ("name", "params")),
        ("arrow_function", r"(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\(([^)]*)\)\s*(?::\s*\w+)?\s*=>", ("name", "params")),
        ("class", r"(?:export\s+)?class\s+(\w+)(?:\s+extends\s+(\w+))?", ("name", "base")),
        ("interface", r"(?:export\s+)?interface\s+(\w+)(?:\s+extends\s+([\w,\s]+))?", ("name", "bases")),
    ],
    "go": [
        ("function", r"func\s+(?:\((\w+)\s+\*?(\w+)\)\s+)?(\w+)\s*\(([^)]*)\)(?:\s+([^{]+))?", ("-", "receiver", "name", "params", "return_type")),
        ("struct", r"type\s+(\w+)\s+struct", ("name",)),
        ("interface", r"type\s+(\w+)\s+interface", ("name",)),
    ],
    "jvm": [
        ("class", r"(?:public|private|protected|internal)?\s*(?:abstract|open|data)?\s*class\s+(\w+)(?:\s*(?:extends|:)\s*(\w+))?", ("name", "base")),
        ("method", r"(?:public|private|protected)\s+(?:static\s+)?(\w+)\s+(\w+)\s*\(([^)]*)\)", ("return_type", "name", "params")),
        ("function", r"(?:fun|suspend\s+fun)\s+(\w+)\s*\(([^)]*)\)(?:\s*:\s*(\w+))?", ("name", "params", "return_type")),
    ],
    "generic": [("function", r"(?:def|fn|func|function)\s+(\w+)\s*\(([^)]*)\)", ("name", "params"))],
}
FAMILY = {".py": "python", ".js": "js", ".ts": "js", ".tsx": "js", ".jsx": "js", ".go": "go", ".java": "jvm", ".kt": "jvm", ".kts": "jvm"}
JS_IMPORTS = (r"""import\s+.*?from\s+['"]([^'"]+)['"]""", r"""require\s*\(\s*['"]([^'"]+)['"]\s*\)""")
GO_STD = frozenset(("fmt", "os", "io", "log", "net", "sync", "time", "context"))
DOCSTRING = 100

_COMPILED = {fam: [(kind, re.compile(p), groups) for kind, p, groups in rows] for fam, rows in PATTERNS.items()}


def _record(**known) -> tuple:
    return tuple(known.get(f) for f in FIELDS)


def _comma(text: str) -> list[str]:
    return [x for x in (p.strip() for p in text.split(",")) if x]


def python_signatures(source: str) -> list[tuple]:
    """Functions and classes at any depth, breadth first; a source that does not parse has none."""
    try:
        nodes = list(ast.walk(ast.parse(source)))
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    for n in nodes:
        kind = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "async_function", ast.ClassDef: "class"}.get(type(n))
        if kind is None:
            continue
        doc = ast.get_docstring(n)
        common = {"name": n.name, "type": kind, "line": n.lineno, "docstring": doc[:DOCSTRING] if doc else None}
        if kind == "class":
            out.append(_record(**common, bases=[ast.unparse(b) for b in n.bases]))
        else:
            shown = [a.arg + (f": {ast.unparse(a.annotation)}" if a.annotation else "") for a in n.args.args]
            out.append(_record(**common, params=shown, return_type=ast.unparse(n.returns) if n.returns else None))
    return out


def pattern_signatures(source: str, family: str) -> list[tuple]:
    ends = [i for i, c in enumerate(source) if c == "\n"]
    out = []
    for kind, pattern, groups in _COMPILED[family]:
        for m in pattern.finditer(source):
            got = {g: m[i] for i, g in enumerate(groups, 1)}
            rec = {"name": got["name"], "type": kind, "line": bisect_left(ends, m.start()) + 1}
            if "params" in got:
                rec["params"] = _comma(got["params"])
            if got.get("receiver"):
                rec |= {"name": f"{got['receiver']}.{got['name']}", "type": "method"}
            if got.get("return_type"):
                rec["return_type"] = got["return_type"].strip()
            if got.get("base"):
                rec["bases"] = [got["base"]]
            if got.get("bases"):
                rec["bases"] = [b.strip() for b in got["bases"].split(",")]
            out.append(_record(**rec))
    return out


def signatures_of(path: str, source: str | None) -> list[tuple]:
    at = path.rfind(".")
    family = FAMILY.get(path[at:] if at >= 0 else "", "generic")
    if source is None:
        return []
    return python_signatures(source) if family == "python" else pattern_signatures(source, family)


def imports_of(path: str, source: str | None) -> list[str]:
    """Imported modules in the order they are met; relative Python imports without a module are left out."""
    family = FAMILY.get("." + path.rsplit(".", 1)[-1])
    if source is None:
        return []
    if family == "python":
        try:
            nodes = list(ast.walk(ast.parse(source)))
        except (SyntaxError, ValueError, RecursionError):
            return []
        found = [[a.name for a in n.names] if isinstance(n, ast.Import) else [n.module] if isinstance(n, ast.ImportFrom) and n.module else [] for n in nodes]
        return [x for f in found for x in f]
    if family == "js":
        return [m for p in JS_IMPORTS for m in re.findall(p, source)]
    if family == "go":
        return [m for m in re.findall(r'"([^"]+)"', source) if "/" in m or m in GO_STD]
    return []


@udtf(returnType=SIGNATURE)
class Signatures:
    """SQL: SELECT * FROM files, LATERAL signatures(path, text)."""

    def eval(self, path: str, text: str):
        yield from signatures_of(path or "", text)


@udtf(returnType="position int, module string")
class Imports:
    def eval(self, path: str, text: str):
        yield from enumerate(imports_of(path or "", text))


def register(spark: SparkSession) -> None:
    spark.udtf.register("signatures", Signatures)
    spark.udtf.register("imports", Imports)


def path_contains(path: Column, pattern: str | None) -> Column:
    """Case-insensitive literal substring; an empty pattern matches everything."""
    return F.contains(F.lower(path), F.lit((pattern or "").lower()))


def signatures(files: DataFrame, keys: list[str], path_col: str = "file_path", text_col: str = "text") -> DataFrame:
    """keys..., position, name, type, line, params, return_type, docstring, bases, one row per signature. NULL paths and texts have none."""

    @F.pandas_udf(f"array<struct<{', '.join(':'.join(f.split(' ', 1)) for f in SIGNATURE.split(', '))}>>")
    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for paths, texts in batches:
            yield pd.Series([[dict(zip(FIELDS, s)) for s in signatures_of(p or "", t)] for p, t in zip(paths, texts)])

    out = files.select(*keys, F.posexplode(find(path_col, text_col)).alias("position", "_s"))
    return out.select(*keys, "position", "_s.*")


def imports(files: DataFrame, keys: list[str], path_col: str = "file_path", text_col: str = "text") -> DataFrame:
    """keys..., position, module."""

    @F.pandas_udf("array<string>")
    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for paths, texts in batches:
            yield pd.Series([imports_of(p or "", t) for p, t in zip(paths, texts)])

    return files.select(*keys, F.posexplode(find(path_col, text_col)).alias("position", "module"))


def candidates(module: Column, source_suffix: Column) -> Column:
    """Paths an import may stand for, in the order they are tried; Go imports stand for none."""
    dotted = F.replace(module, F.lit("."), F.lit("/"))
    py = F.array(F.concat(dotted, F.lit(".py")), F.concat(dotted, F.lit("/__init__.py")))
    clean = F.regexp_replace(module, r"^[./]+", "")
    js = F.array(*[F.concat(clean, F.lit(e)) for e in (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js")])
    none = F.array().cast("array<string>")
    return F.when(source_suffix == ".py", py).when(source_suffix.isin(".js", ".ts", ".tsx", ".jsx") & F.startswith(module, F.lit(".")), js).otherwise(none)


def edges(imported: DataFrame, files: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """keys..., src, position, dst: each import resolved to the first candidate that exists and is not the file itself.

    imported: keys..., file_path, position, module; files: keys..., file_path, one row each. The candidates join the files by path; the
    winner per import is a minimum over its at most six candidates (aggregated, not sorted), so a popular target is no hot spot.
    Neither side is broadcast: what is known of their sizes is an estimate that counts a file once, however many imports and candidates it gives.
    """
    cand = imported.select(*keys, F.col("file_path").alias("src"), "position", F.posexplode(candidates(F.col("module"), suffix(F.col("file_path")))).alias("_n", "dst"))
    there = files.select(*keys, F.col("file_path").alias("dst")).distinct()
    hit = cand.hint("merge").join(there, [*keys, "dst"]).where("dst <> src")
    return hit.groupBy(*keys, "src", "position").agg(F.min_by("dst", "_n").alias("dst"))


def graph(e: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """keys..., src, targets: adjacency lists in import order, repeats kept."""
    lists = e.groupBy(*keys, "src").agg(F.sort_array(F.collect_list(F.struct("position", "dst"))).alias("_t"))
    return lists.select(*keys, "src", F.col("_t.dst").alias("targets"))
