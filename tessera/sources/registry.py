"""Which extractor, content type, language and format a file gets: dimension tables and their lookup as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import file_name, suffix

# Suffix or exact name -> language, format or extractor.
LANGUAGES = {
    ".py": "python", ".pyw": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".go": "go", ".rs": "rust", ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp", ".cxx": "cpp",
    ".cs": "csharp", ".rb": "ruby", ".php": "php", ".swift": "swift", ".scala": "scala", ".sh": "shell", ".bash": "shell", ".zsh": "shell", ".fish": "shell",
    ".html": "html", ".htm": "html", ".css": "css", ".scss": "scss", ".less": "less", ".vue": "vue", ".svelte": "svelte", ".sql": "sql", ".graphql": "graphql",
    ".gql": "graphql", ".proto": "protobuf", ".dockerfile": "dockerfile", ".gradle": "gradle", ".cmake": "cmake", ".makefile": "makefile", ".r": "r",
}
NAME_LANGUAGES = {"Dockerfile": "dockerfile", "Makefile": "makefile", "CMakeLists.txt": "cmake", "Jenkinsfile": "groovy", "Gemfile": "ruby", "Rakefile": "ruby"}
CODE_NAMES = ("Dockerfile", "Makefile", "CMakeLists.txt", "Jenkinsfile", "Procfile", "Vagrantfile", "Gemfile", "Rakefile", ".gitignore", ".dockerignore", ".eslintrc", ".prettierrc")
STRUCTURED = {".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".csv": "csv", ".tsv": "csv", ".xml": "xml", ".ini": "ini", ".cfg": "ini", ".conf": "ini"}
MARKDOWN = (".md", ".rst", ".adoc")
TEXT_KEYS = (".txt", ".log", ".env.example", ".editorconfig")
DOCUMENTS = {".pdf": "pdf", ".docx": "docx"}
IMAGES = (".png", ".jpg", ".jpeg", ".bmp", ".tiff")


@dataclass(frozen=True)
class Entry:
    key: str
    extractor: str
    content_type: str
    priority: int  # a later registration takes the key over


def entries() -> list[Entry]:
    out = [Entry(k, "text", "plain_text", 0) for k in TEXT_KEYS]
    out += [Entry(k, "code", "code", 1) for k in (*LANGUAGES, *CODE_NAMES)]
    out += [Entry(k, "markdown", "markdown", 2) for k in MARKDOWN]
    out += [Entry(k, "structured", "structured_data", 3) for k in STRUCTURED]
    out += [Entry(k, v, "document", 4) for k, v in DOCUMENTS.items()]
    out += [Entry(k, "image", "document", 5) for k in IMAGES]
    return out


def resolved(extra: list[Entry] = []) -> dict[str, Entry]:  # noqa: B006
    """One entry per key: the one registered last."""
    best: dict[str, Entry] = {}
    for e in [*entries(), *extra]:
        if e.key not in best or e.priority >= best[e.key].priority:
            best[e.key] = e
    return best


def table(spark: SparkSession, extra: list[Entry] = []) -> DataFrame:  # noqa: B006
    rows = [(e.key, e.extractor, e.content_type, LANGUAGES.get(e.key), STRUCTURED.get(e.key)) for e in resolved(extra).values()]
    return spark.createDataFrame(rows, "key string, extractor string, content_type string, language string, format string")


def can_extract(path: Column) -> Column:
    keys = list(resolved())
    return file_name(path).isin(keys) | F.lower(suffix(path)).isin(keys)


def dispatch(files: DataFrame, path_col: str = "file_path", registry: DataFrame | None = None) -> DataFrame:
    """files plus extractor, content_type_, language, format: exact name first, then lower-cased suffix, then the plain-text fallback.

    The registry is a constant table of about a hundred rows, so both lookups broadcast it. NULL paths fall back to text.
    """
    reg = F.broadcast(registry if registry is not None else table(files.sparkSession))
    by = lambda p: reg.select(*[F.col(c).alias(f"_{p}_{c}") for c in reg.columns])
    path = F.col(path_col)
    out = files.join(by("n"), file_name(path) == F.col("_n_key"), "left").join(by("s"), F.lower(suffix(path)) == F.col("_s_key"), "left")
    named = F.col("_n_key").isNotNull()
    pick = lambda c: F.when(named, F.col(f"_n_{c}")).otherwise(F.col(f"_s_{c}"))
    names = F.create_map(*[F.lit(x) for kv in NAME_LANGUAGES.items() for x in kv])
    extractor = F.coalesce(pick("extractor"), F.lit("text"))
    language = F.when(extractor == "code", F.coalesce(F.element_at(names, file_name(path)), F.col("_s_language"), F.lit("unknown")))
    form = F.when(extractor == "structured", pick("format")).when(extractor == "markdown", F.substring(suffix(path), 2, 100))
    return out.select(
        *files.columns,
        extractor.alias("extractor"),
        F.coalesce(pick("content_type"), F.lit("plain_text")).alias("content_type_"),
        language.alias("language"),
        form.alias("format"),
    )
