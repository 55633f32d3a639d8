"""Chunkers: one document to many chunks.

Recursive, paragraph and CSV packing are column expressions (nested `aggregate`), so they run in the JVM next to the scan; code, Markdown
and JSON need an AST, match offsets or an exact dump and run in Python batches. No chunker shuffles.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import is_blank, strip

# Fixed value: separators tried in turn; what is still too long is cut hard.
SEPARATORS = ("\n\n", "\n", " ")
_STRINGS = "array<string>"


def _parts(text: Column, sep: str) -> Column:
    return F.split(text, "\\Q" + sep + "\\E", -1)


def _kept(piece: Column) -> Column:
    """The stripped piece as an array, empty if nothing is left."""
    s = strip(piece)
    return F.when(s != "", F.array(s)).otherwise(F.array().cast(_STRINGS))


def _hard(text: Column, size: int) -> Column:
    cuts = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / F.lit(size)).cast("int"))
    return F.filter(F.transform(cuts, lambda i: strip(F.substring(text, i * size + 1, F.lit(size)))), lambda p: p != "")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: inside a lambda, an expression is evaluated anew for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


BLOCK = 512  # parts of an inner fold


def fold(parts: Column, carry: dict[str, Column], step: Callable[[Column, Column], Column], done: Callable[[Column], Column]) -> Column:
    """Folds parts into a struct of `out` (the pieces so far) and the fields of carry.

    Every step of an `aggregate` copies its state. So parts are folded in blocks whose own `out` stays short, and the long one is touched once a
    block: the time is linear in the text.
    """
    none = F.array().cast(_STRINGS).alias("out")

    def over(items: Column) -> Column:
        def block(acc: Column, b: Column) -> Column:
            start = F.struct(none, *[acc[c].alias(c) for c in carry])
            whole = lambda s: F.struct(F.concat(acc["out"], s["out"]).alias("out"), *[s[c].alias(c) for c in carry])
            return F.aggregate(F.slice(items, b * BLOCK + 1, F.lit(BLOCK)), start, step, whole)

        last = F.greatest(F.floor((F.size(items) - 1) / BLOCK).cast("int"), F.lit(0))
        return F.aggregate(F.sequence(F.lit(0), last), F.struct(none, *[v.alias(c) for c, v in carry.items()]), block, done)

    return bound(parts, over)


def _pack(parts: Column, sep: str, size: int, oversize: Callable[[Column], Column], tidy: Callable[[Column], Column]) -> Column:
    """Greedy packing of parts up to size; a part over it is split by `oversize`, and what was gathered before is flushed."""

    def step(acc: Column, part: Column) -> Column:
        joined = F.when(acc["cur"] != "", F.concat(acc["cur"], F.lit(sep), part)).otherwise(part)
        flushed = F.concat(acc["out"], tidy(acc["cur"]))
        big = F.struct(F.concat(flushed, oversize(part)).alias("out"), F.lit("").alias("cur"))
        return (
            F.when(F.length(joined) <= size, F.struct(acc["out"].alias("out"), joined.alias("cur")))
            .when(F.length(part) > size, big)
            .otherwise(F.struct(flushed.alias("out"), part.alias("cur")))
        )

    return fold(parts, {"cur": F.lit("")}, step, lambda acc: F.concat(acc["out"], tidy(acc["cur"])))


def _level(text: Column, size: int, level: int) -> Column:
    if level == len(SEPARATORS):
        return _hard(text, size)
    return _pack(_parts(text, SEPARATORS[level]), SEPARATORS[level], size, lambda p: _level(p, size, level + 1), _kept)


def recursive_raw(text: Column, size: int) -> Column:
    """Pieces of at most size code points without overlap; blank and NULL texts give none."""
    return F.when(is_blank(text), F.array().cast(_STRINGS)).when(F.length(text) <= size, _kept(text)).otherwise(_level(text, size, 0))


def with_overlap(raw: Column, overlap: int) -> Column:
    """Every piece but the first is preceded by the last `overlap` code points of the raw piece before it."""
    if overlap <= 0:
        return raw
    return bound(raw, lambda r: F.transform(r, lambda p, i: F.when(i > 0, F.concat(F.right(F.get(r, i - 1), F.lit(overlap)), p)).otherwise(p)))


def recursive(text: Column, size: int, overlap: int) -> Column:
    return with_overlap(recursive_raw(text, size), overlap)


def paragraph(text: Column, size: int, overlap: int) -> Column:
    """Blank-line paragraphs packed up to size; an oversized one is split recursively."""
    paras = F.filter(F.transform(_parts(F.coalesce(text, F.lit("")), "\n\n"), strip), lambda p: p != "")
    whole = lambda c: F.when(c != "", F.array(c)).otherwise(F.array().cast(_STRINGS))
    return _pack(paras, "\n\n", size, lambda p: recursive(p, size, overlap), whole)


def csv(text: Column, size: int) -> Column:
    """Groups of rows up to size, each under the header. A lone header gives nothing, an oversized row stays whole."""
    group = lambda head, rows: F.concat(head, F.lit("\n"), F.array_join(rows, "\n"))

    def grouped(lines: Column, head: Column) -> Column:
        def step(acc: Column, row: Column) -> Column:
            full = (acc["n"] + F.length(row) + 1 > size) & (F.size(acc["rows"]) > 0)
            flushed = F.struct(F.concat(acc["out"], F.array(group(head, acc["rows"]))).alias("out"), F.array(row).alias("rows"), (F.length(head) + F.length(row) + 1).alias("n"))
            return F.when(full, flushed).otherwise(F.struct(acc["out"].alias("out"), F.concat(acc["rows"], F.array(row)).alias("rows"), (acc["n"] + F.length(row) + 1).alias("n")))

        rest = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
        done = lambda acc: F.when(F.size(acc["rows"]) > 0, F.concat(acc["out"], F.array(group(head, acc["rows"])))).otherwise(acc["out"])
        return fold(rest, {"rows": F.array().cast(_STRINGS), "n": F.length(head)}, step, done)

    pieces = bound(_parts(strip(F.coalesce(text, F.lit(""))), "\n"), lambda lines: bound(F.get(lines, F.lit(0)), lambda head: grouped(lines, head)))
    return F.when(is_blank(text), F.array().cast(_STRINGS)).otherwise(pieces)


# --- Python side -------------------------------------------------------------------------------------------------------------------


def py_recursive(text: str, size: int, overlap: int) -> list[str]:
    """The same splitter for use inside Python chunkers."""

    def cut(s: str, level: int) -> list[str]:
        if level == len(SEPARATORS):
            return [p for i in range(0, len(s), size) if (p := s[i : i + size].strip())]
        sep, out, held = SEPARATORS[level], [], ""
        for part in s.split(sep):
            longer = f"{held}{sep}{part}" if held else part
            if len(longer) <= size:
                held = longer
                continue
            out += [held.strip()] if held.strip() else []
            held = "" if len(part) > size else part
            out += cut(part, level + 1) if len(part) > size else []
        return out + ([held.strip()] if held.strip() else [])

    if not text or not text.strip():
        return []
    raw = [text.strip()] if len(text) <= size else cut(text, 0)
    return [p if i == 0 or overlap <= 0 else raw[i - 1][-overlap:] + p for i, p in enumerate(raw)]


# Lines that begin a block, by language.
BLOCK_START = {
    "javascript": r"^(?:export\s+)?(?:async\s+)?(?:function\s+\w+|class\s+\w+|const\s+\w+\s*=\s*(?:async\s+)?\()",
    "typescript": r"^(?:export\s+)?(?:async\s+)?(?:function\s+\w+|class\s+\w+|interface\s+\w+|const\s+\w+\s*=\s*(?:async\s+)?\()",
    "go": r"^(?:func\s+|type\s+\w+\s+(?:struct|interface))",
    "java": r"^(?:\s*(?:public|private|protected)\s+)?(?:static\s+)?(?:class|interface|(?:\w+\s+)+\w+\s*\()",
    "kotlin": r"^(?:fun\s+|class\s+|interface\s+|object\s+)",
}
HEADING = re.compile(r"^(#{1,6})\s+(.+)$", re.M)


def python_blocks(text: str) -> list[str]:
    """Top-level definitions, and what lies between them stripped; a text that does not parse is one block."""
    try:
        body = ast.parse(text).body
    except (SyntaxError, ValueError, RecursionError):
        return [text]
    lines = text.split("\n")
    spans = [(n.lineno - 1, n.end_lineno) for n in body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]
    out, done = [], 0
    for a, b in [*spans, (len(lines), len(lines))]:
        between = "\n".join(lines[done:a]).strip() if a > done else ""
        out += [between] if between else []
        out += ["\n".join(lines[a:b])] if b > a else []
        done = max(done, b)
    return out or [text]


def line_blocks(text: str, language: str) -> list[str]:
    starts = re.compile(BLOCK_START[language])
    lines = text.split("\n")
    at = [0] + [i for i, x in enumerate(lines) if i and starts.match(x)] + [len(lines)]
    return [b for a, z in zip(at, at[1:]) if (b := "\n".join(lines[a:z])).strip()]


def code(text: str, size: int, overlap: int, language: str | None) -> list[str]:
    """Definitions packed up to size; an oversized one is split recursively; unknown languages are split recursively."""
    if not text or not text.strip():
        return []
    if language == "python":
        blocks = python_blocks(text)
    elif language in BLOCK_START:
        blocks = line_blocks(text, language)
    else:
        return py_recursive(text, size, overlap)
    out, held = [], ""
    for b in blocks:
        if len(held) + len(b) + 1 <= size:
            held = f"{held}\n{b}" if held else b
            continue
        out += [held.strip()] if held.strip() else []
        held = b
        if len(b) > size:
            out += py_recursive(b, size, overlap)
            held = ""
    return out + ([held.strip()] if held.strip() else [])


def markdown(text: str, size: int, overlap: int) -> list[tuple[str, str | None]]:
    """(chunk, section title): the text below each heading, without the heading line."""
    if not text or not text.strip():
        return []
    marks = list(HEADING.finditer(text))
    titles = [None, *(m[2].strip() for m in marks)]
    bounds = zip([0, *(m.end() for m in marks)], [*(m.start() for m in marks), len(text)])
    sections = [(t, text[a:b]) for t, (a, b) in zip(titles, bounds) if text[a:b].strip()]
    if not sections:  # only headings: the last keeps its title if the text ends with it
        sections = [(titles[-1] if marks and marks[-1].end() == len(text) else None, text)]
    return [(c, t) for t, body in sections for c in py_recursive(body.strip(), size, overlap)]


def json_groups(text: str, size: int) -> list[str]:
    """Top-level keys grouped by the size of their compact form, written with an indent of two; anything but an object is split recursively."""
    if not text or not text.strip():
        return []
    try:
        data = json.loads(text)
    except ValueError:
        data = None
    if not isinstance(data, dict):
        return py_recursive(text, size, 0)
    groups: list[dict] = []
    room = 0
    for k, v in data.items():
        need = len(json.dumps({k: v}))
        if not groups or need > room:
            groups.append({})
            room = size - 2
        groups[-1][k] = v
        room -= need
    return [json.dumps(g, indent=2) for g in groups]


Chunker = Callable[[str, dict, int, int], list]
_CUSTOM: dict[str, Chunker] = {}


def register(content_type: str, chunker: Chunker | None) -> None:
    """Makes chunker(text, meta, size, overlap) -> chunks, or (chunk, section title) pairs, the one of a content type; None brings the own one back.
    The last registration wins. It runs in Python batches."""
    if chunker is None:
        _CUSTOM.pop(content_type, None)
    else:
        _CUSTOM[content_type] = chunker


def python_chunks(text: str, content_type: str | None, meta: dict, size: int, overlap: int, custom: dict[str, Chunker] | None = None) -> list[tuple[str, str | None]]:
    if custom and content_type in custom:
        return [c if isinstance(c, tuple) else (c, None) for c in custom[content_type](text, meta, size, overlap)]
    if content_type == "code":
        return [(c, None) for c in code(text, size, overlap, meta.get("language"))]
    if content_type == "markdown":
        return markdown(text, size, overlap)
    return [(c, None) for c in json_groups(text, size)]


def chunk(docs: DataFrame, key: list[str], size: int = 1000, overlap: int = 200) -> DataFrame:
    """docs(key..., text, content_type, meta) -> key..., content_type, meta, chunk_index, chunk, section_title.

    Dispatch is by content_type, and for structured data by meta['format']; what has no chunker of its own (NULL included) is split
    recursively. NULL and blank texts give no rows.
    """
    form = F.lower(F.coalesce(F.element_at("meta", "format"), F.lit("")))
    kind = F.coalesce("content_type", F.lit("plain_text"))
    custom = dict(_CUSTOM)
    in_python = kind.isin("code", "markdown", *custom) | ((kind == "structured_data") & (form == "json"))
    cols = [*key, "content_type", "meta"]
    pieces = (
        F.when(kind == "document", paragraph(F.col("text"), size, overlap))
        .when((kind == "structured_data") & (form == "csv"), csv(F.col("text"), size))
        .otherwise(recursive(F.col("text"), size, overlap))
    )
    native = docs.where(~in_python & ~is_blank(F.col("text"))).select(*cols, F.posexplode(pieces).alias("chunk_index", "chunk"), F.lit(None).cast("string").alias("section_title"))

    @F.pandas_udf("array<struct<chunk:string,section_title:string>>")
    def split(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, ct, lang, fm in batches:
            yield pd.Series([[{"chunk": c, "section_title": s} for c, s in python_chunks(t, k, {"language": g, "format": f}, size, overlap, custom)] for t, k, g, f in zip(text, ct, lang, fm)])

    lang = F.element_at("meta", "language")
    other = docs.where(in_python & ~is_blank(F.col("text"))).select(*cols, F.posexplode(split("text", "content_type", lang, form)).alias("chunk_index", "_c"))
    return native.unionByName(other.select(*cols, "chunk_index", F.col("_c.chunk").alias("chunk"), F.col("_c.section_title").alias("section_title")))


def chunk_id(directory: Column, path: Column, index: Column) -> Column:
    """Content-addressed id: the same chunk of the same file keeps its id, so that replacing is idempotent."""
    return F.sha2(F.concat_ws("\0", directory, path, index.cast("string")), 256)
