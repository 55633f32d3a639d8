"""File contents to text: one mapInPandas over the files, dispatched by extractor, with an error column instead of failures."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources import registry

SCHEMA = "rel_path string, text string, content_type string, meta map<string,string>, error string"


class MissingDependency(Exception):
    pass


def read_pdf(data: bytes) -> tuple[str, dict]:
    try:
        import fitz
    except ImportError as e:
        raise MissingDependency("PyMuPDF") from e
    with fitz.open(stream=data, filetype="pdf") as doc:
        pages = [p.get_text() for p in doc]
    return "\n".join(pages), {"pages": str(len(pages))}


def read_docx(data: bytes) -> tuple[str, dict]:
    try:
        import docx
    except ImportError as e:
        raise MissingDependency("python-docx") from e
    return "\n".join(p.text for p in docx.Document(io.BytesIO(data)).paragraphs), {}


def read_image(data: bytes) -> tuple[str, dict]:
    try:
        import pytesseract
        from PIL import Image
    except ImportError as e:
        raise MissingDependency("pytesseract") from e
    image = Image.open(io.BytesIO(data))
    return pytesseract.image_to_string(image), {"size": f"{image.width}x{image.height}", "mode": image.mode}


def read_text(data: bytes) -> tuple[str, dict]:
    return data.decode("utf-8", errors="replace").replace("\r\n", "\n").replace("\r", "\n"), {}


READERS = {"pdf": read_pdf, "docx": read_docx, "image": read_image}


def register_reader(extractor: str, reader) -> None:
    """A reader takes bytes and gives (text, metadata); add its keys with registry.Entry."""
    READERS[extractor] = reader


def extract(files: DataFrame, extra: list[registry.Entry] = []) -> DataFrame:  # noqa: B006
    """rel_path, text, content_type, meta, error of every file. A file that cannot be read gives a row with its error and NULL text."""
    known = registry.dispatch(files, "rel_path", registry.table(files.sparkSession, extra))
    readers = dict(READERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rel, data, ex, kind, lang, form in zip(b["rel_path"], b["content"], b["extractor"], b["content_type_"], b["language"], b["format"]):
                meta = {k: v for k, v in (("language", lang), ("format", form)) if v}
                try:
                    text, more = readers.get(ex, read_text)(bytes(data))
                    out.append((rel, text, kind, meta | more, None))
                except MissingDependency as e:
                    out.append((rel, None, kind, meta | {"error": "missing_dependency"}, f"missing_dependency: {e}"))
                except Exception as e:  # noqa: BLE001
                    out.append((rel, None, kind, meta | {"error": type(e).__name__}, str(e)))
            yield pd.DataFrame(out, columns=["rel_path", "text", "content_type", "meta", "error"])

    return known.select("rel_path", "content", "extractor", "content_type_", "language", "format").mapInPandas(run, SCHEMA)


def _without(keys: Column) -> Callable[[Column, Column], Column]:
    return lambda k, _v: ~F.map_contains_key(keys, k)


def merged_meta(*maps: Column) -> Column:
    """Metadata maps merged, later ones winning; NULL maps count as empty. Does not depend on the session's policy for repeated keys."""
    empty = F.create_map().cast("map<string,string>")
    acc = F.coalesce(maps[0], empty)
    for m in maps[1:]:
        m = F.coalesce(m, empty)
        acc = F.map_concat(F.map_filter(acc, _without(m)), m)
    return acc
