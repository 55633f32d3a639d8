"""Queries over texts planted from the rows of `part`: what each extractor must give is known row by row, and SQL states it from the keys alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import chunkers, overview, structure
from tessera.session import table

Query = Callable[[SparkSession, str], DataFrame]

SOURCES = [
    ("src/m{k}.py", 'class Box{k}(Base, ns.Other):\n    """Holds {k}."""\n    def get{k}(self, a: int, b={n}) -> List[str]:\n        return a\n\n\nasync def run{k}(x):\n    def inner{k}():\n        pass\n'),
    ("src/g{k}.go", "package p\n\ntype T{k} struct {\n\tA int\n}\n\ntype I{k} interface {\n}\n\nfunc (t *T{k}) Get{k}(a int, b string) (int, error) {\n\treturn a, nil\n}\n\nfunc New{k}() *T{k} {\n\treturn nil\n}\n"),
    ("src/A{k}.java", "public class A{k} extends B{k} {\n    public static int size{k}(int a, String b) {\n        return a;\n    }\n}\n"),
    ("src/P{k}.kt", "data class P{k} : Q{k}\n\nsuspend fun load{k}(id: Int): Text {\n}\n"),
    ("src/r{k}.rb", "def go{k}(a, b)\nend\n"),
    ("src/f{k}.ts", "export interface I{k} extends J, K {\n}\nexport class C{k} extends D{k} {\n}\nexport async function f{k}(a, b) {\n}\nconst h{k} = async (x) => x\n"),
]
#: source, position, name, type, line, params, return_type, docstring, bases; # stands for the key
SIGNATURES = [
    (0, 0, "Box#", "class", 1, None, None, "Holds #.", "Base,ns.Other"), (0, 1, "run#", "async_function", 7, "x", None, None, None), (0, 2, "get#", "function", 3, "self,a: int,b", "List[str]", None, None),
    (0, 3, "inner#", "function", 8, "", None, None, None), (1, 0, "T#.Get#", "method", 10, "a int,b string", "(int, error)", None, None), (1, 1, "New#", "function", 14, "", "*T#", None, None),
    (1, 2, "T#", "struct", 3, None, None, None, None), (1, 3, "I#", "interface", 7, None, None, None, None), (2, 0, "A#", "class", 1, None, None, None, "B#"),
    (2, 1, "size#", "method", 2, "int a,String b", "int", None, None), (3, 0, "P#", "class", 1, None, None, None, "Q#"), (3, 1, "load#", "function", 3, "id: Int", "Text", None, None),
    (4, 0, "go#", "function", 1, "a,b", None, None, None), (5, 0, "f#", "function", 5, "a,b", None, None, None), (5, 1, "h#", "arrow_function", 7, "x", None, None, None),
    (5, 2, "C#", "class", 3, None, None, None, "D#"), (5, 3, "I#", "interface", 1, None, None, None, "J,K"),
]
IMPORTS = [
    ("pkg/m{k}.py", "import os\nimport pkg.m{next}\nfrom pkg import x\nfrom . import y\n"),
    ("pkg/j{k}.ts", "import a from './pkg/j{next}';\nconst b = require('../pkg/j{k}');\nimport c from 'react';\n"),
    ("pkg/g{k}.go", 'package g\n\nimport (\n\t"fmt"\n\t"pkg/g{next}"\n)\n'),
]
PROJECTS = [
    ("pyproject.toml", '[project]\nname = "n{k}"\nversion = "1.{n}"\ndependencies = ["a{k}>=1", "b"]\n'),
    ("package.json", '{"name": "n{k}", "version": "1.{n}", "dependencies": {"x{k}": "1"}, "devDependencies": {"y": "2"}}'),
    ("Cargo.toml", '[package]\nname = "n{k}"\nversion = "1.{n}"\n[dependencies]\nz{k} = "1"\n'),
    ("go.mod", "module m/n{k}\n\ngo 1.22\n\nrequire (\n\tr/q{k} v1\n)\n"),
]
CHUNKED = [
    ("markdown", "", "intro {k}\n# One {k}\nbody one\n## Two\n\ntext two\n"),
    ("structured_data", "json", '{"a": {k}, "b": [1, 2]}'),
    ("code", "python", "import os\n\ndef f{k}():\n    return 1\n"),
    ("code", "go", "package p\n\nfunc a{k}() {\n}\nfunc b{k}() {\n}\n"),
]


def planted(spark: SparkSession, d: str, rows: list[tuple], columns: list[str]) -> DataFrame:
    """One row per part: the template of its key's turn, with {k} the key, {n} the size and {next} the next key of that turn filled in."""
    k, n = F.col("p_partkey"), len(rows)
    parts = table(spark, d, "part").select(k.alias("k"), F.col("p_size").alias("n"))

    def filled(i: int) -> Column:
        text = F.element_at(F.array(*[F.lit(r[i]) for r in rows]), (F.pmod("k", F.lit(n)) + 1).cast("int"))
        for mark, value in (("{k}", F.col("k")), ("{n}", F.col("n")), ("{next}", F.col("k") + n)):
            text = F.replace(text, F.lit(mark), value.cast("string"))
        return text

    return parts.select("k", *[filled(i).alias(c) for i, c in enumerate(columns)])


def _sql(text: str | None) -> str:
    if text is None:
        return "CAST(NULL AS VARCHAR)"
    return "replace('" + text.replace("'", "''") + "', '#', CAST(p_partkey AS VARCHAR))"


def _signatures_sql() -> str:
    each = []
    for s, pos, name, kind, line, params, back, doc, bases in SIGNATURES:
        path = SOURCES[s][0].replace("{k}", "#")
        cols = [f"{_sql(v)} AS {c}" for c, v in (("file_path", path), ("name", name), ("type", kind), ("params", params), ("return_type", back), ("docstring", doc), ("bases", bases))]
        each.append(f"SELECT {', '.join(cols)}, {pos} AS position, {line} AS line FROM part WHERE p_partkey % {len(SOURCES)} = {s}")
    return " UNION ALL ".join(each)


def planted_signatures(spark: SparkSession, d: str) -> DataFrame:
    s = structure.signatures(planted(spark, d, SOURCES, ["file_path", "text"]), ["file_path"])
    return s.withColumns({"params": F.array_join("params", ","), "bases": F.array_join("bases", ",")})


def planted_imports(spark: SparkSession, d: str) -> DataFrame:
    return structure.imports(planted(spark, d, IMPORTS, ["file_path", "text"]), ["file_path"])


def planted_edges(spark: SparkSession, d: str) -> DataFrame:
    f = planted(spark, d, IMPORTS, ["file_path", "text"])
    return structure.edges(structure.imports(f, ["file_path"]), f)


def planted_graph(spark: SparkSession, d: str) -> DataFrame:
    return structure.graph(planted_edges(spark, d)).withColumn("targets", F.array_join("targets", ","))


def planted_dependencies(spark: SparkSession, d: str) -> DataFrame:
    f = planted(spark, d, PROJECTS, ["file_path", "text"]).withColumn("directory", F.concat(F.lit("/d"), "k"))
    return overview.dependencies(f, ["directory"]).withColumns({"requires": F.array_join("requires", ","), "dev_requires": F.array_join("dev_requires", ",")})


def planted_manifests(spark: SparkSession, d: str) -> DataFrame:
    f = planted(spark, d, PROJECTS, ["file_path", "text"]).withColumn("directory", F.concat(F.lit("/d"), "k"))
    below = f.withColumn("file_path", F.concat(F.lit("sub/"), "file_path"))
    return overview.manifests(f.unionByName(below), ["directory"])


def planted_chunks(spark: SparkSession, d: str) -> DataFrame:
    f = planted(spark, d, CHUNKED, ["content_type", "kind", "text"])
    meta = F.map_filter(F.create_map(F.lit("language"), F.when(F.col("content_type") == "code", F.col("kind")), F.lit("format"), F.when(F.col("kind") == "json", "json")), lambda k, v: v.isNotNull())
    return chunkers.chunk(f.withColumn("meta", meta), ["k"], 30, 0).select("k", "content_type", "chunk_index", "chunk", "section_title")


_HAS_NEXT = "FROM part p WHERE EXISTS (SELECT 1 FROM part q WHERE q.p_partkey = p.p_partkey + 3)"
_EDGES = (
    f"SELECT 'pkg/m' || p_partkey || '.py' AS src, 1 AS position, 'pkg/m' || (p_partkey + 3) || '.py' AS dst {_HAS_NEXT} AND p_partkey % 3 = 0"
    f" UNION ALL SELECT 'pkg/j' || p_partkey || '.ts', 0, 'pkg/j' || (p_partkey + 3) || '.ts' {_HAS_NEXT} AND p_partkey % 3 = 1"
)


_MODULES = " UNION ALL ".join(
    f"SELECT {_sql(path)} AS file_path, {i} AS position, replace({_sql(m)}, '@', CAST(p_partkey + 3 AS VARCHAR)) AS module FROM part WHERE p_partkey % 3 = {turn}"
    for turn, path, modules in ((0, "pkg/m#.py", ["os", "pkg.m@", "pkg"]), (1, "pkg/j#.ts", ["./pkg/j@", "react", "../pkg/j#"]), (2, "pkg/g#.go", ["fmt", "pkg/g@"]))
    for i, m in enumerate(modules)
)
_DEPENDS = " UNION ALL ".join(
    f"SELECT '/d' || p_partkey AS directory, '{eco}' AS ecosystem, {_sql(name)} AS name, {version} AS version, {_sql(req)} AS requires, '{dev}' AS dev_requires FROM part WHERE p_partkey % 4 = {i}"
    for i, (eco, name, version, req, dev) in enumerate(
        [("python", "n#", "'1.' || p_size", "a#>=1,b", ""), ("node", "n#", "'1.' || p_size", "x#", "y"), ("rust", "n#", "'1.' || p_size", "z#", ""), ("go", "m/n#", "'unknown'", "r/q#", "")]
    )
)
_CHUNKS = " UNION ALL ".join(
    f"SELECT p_partkey AS k, '{CHUNKED[turn][0]}' AS content_type, {i} AS chunk_index, {_sql(c)} AS chunk, {_sql(t)} AS section_title FROM part WHERE p_partkey % 4 = {turn}"
    for turn, chunks in (
        (0, [("intro #", None), ("body one", "One #"), ("text two", "Two")]),
        (1, [('{\n  "a": #,\n  "b": [\n    1,\n    2\n  ]\n}', None)]),
        (2, [("import os", None), ("def f#():\n    return 1", None)]),
        (3, [("package p\n\nfunc a#() {\n}", None), ("func b#() {\n}", None)]),
    )
    for i, (c, t) in enumerate(chunks)
)

QUERIES: dict[str, Query] = {f.__name__: f for f in (planted_signatures, planted_imports, planted_edges, planted_graph, planted_dependencies, planted_manifests, planted_chunks)}
ORACLES: dict[str, str] = {
    "planted_signatures": _signatures_sql(),
    "planted_imports": _MODULES,
    "planted_edges": _EDGES,
    "planted_graph": f"SELECT src, string_agg(dst, ',' ORDER BY position) AS targets FROM ({_EDGES}) GROUP BY src",
    "planted_dependencies": _DEPENDS,
    "planted_manifests": "SELECT '/d' || p_partkey AS directory, " + " ".join(["CASE p_partkey % 4", *[f"WHEN {i} THEN '{r[0]}'" for i, r in enumerate(PROJECTS)], "END AS file, CASE p_partkey % 4"])
    + " WHEN 0 THEN 'Python (modern)' WHEN 1 THEN 'JavaScript/TypeScript (npm)' WHEN 2 THEN 'Rust' ELSE 'Go' END AS label FROM part",
    "planted_chunks": _CHUNKS,
}
