"""Ingestion as one plan: files -> text -> chunks -> vectors -> tables."""

from __future__ import annotations

import json
import os
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.functions import embeddings
from tessera.functions.text import tokens
from tessera.operators import chunkers, diff, vector
from tessera.operators import store as S
from tessera.sources import extract, filetree

CHUNK = "id string, text string, file_path string, directory string, content_type string, chunk_index int, ingested_at string, meta map<string,string>, vector array<float>, tokens array<string>, dl int"


def build_chunks(texts: DataFrame, directory: str | None, settings: Settings = Settings(), spec: embeddings.Spec = embeddings.Spec()) -> DataFrame:
    """texts(rel_path, text, content_type, meta) -> rows of CHUNK; without a directory, texts has a column of it. Texts that could not be read
    (NULL) give none."""
    c = chunkers.chunk(texts.where(F.col("text").isNotNull()), ["rel_path"] if directory is not None else ["directory", "rel_path"], settings.chunk_size, settings.chunk_overlap)
    place = F.lit(directory) if directory is not None else F.col("directory")
    meta = extract.merged_meta(F.col("meta"), F.map_filter(F.create_map(F.lit("section_title"), "section_title", F.lit("chunk_index"), F.col("chunk_index").cast("string")), lambda k, v: v.isNotNull()))
    t = tokens(F.col("chunk"))
    c = c.withColumn("_e", embeddings.embed(F.col("chunk"), spec)).withColumn("_v", vector.unit(F.col("_e")))  # searches need not know lengths
    return c.select(
        chunkers.chunk_id(place, F.col("rel_path"), F.col("chunk_index")).alias("id"),
        F.col("chunk").alias("text"),
        F.col("rel_path").alias("file_path"),
        place.alias("directory"),
        "content_type",
        "chunk_index",
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssxxx").alias("ingested_at"),
        meta.alias("meta"),
        F.col("_v").alias("vector"),
        t.alias("tokens"),
        F.size(t).alias("dl"),
    )


MANIFEST = "directory string, rel_path string, mtime double, size bigint, md5 string"
OVERVIEW = "directory string, fingerprint string, overview string"
HEAD = "directory string, commit string"


def apply_changes(chunks: S.Store, delta: DataFrame, new: DataFrame) -> list[int]:
    """One step of incremental indexing: the chunks of all files in delta(directory, file_path) go, and new, their present chunks, come; only
    the buckets of these files are read and written. Applying a step twice changes nothing."""
    keys = ["directory", "file_path"]
    return chunks.update(delta.select(*keys), lambda old: S.delete(old, delta, keys).unionByName(new.select(*old.columns)))


class Index:
    """The tables of one index: chunks (with vectors and tokens), the manifest and the git checkpoint of each directory, and overviews."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings = Settings(), spec: embeddings.Spec = embeddings.Spec()):
        self.spark, self.settings, self.spec = spark, settings, spec
        self._corpora: dict[str, tuple[str | None, DataFrame]] = {}
        self.chunks = S.Store(spark, f"{path}/chunks", ("directory", "file_path"))
        self.manifest = S.Store(spark, f"{path}/manifest", ("directory", "rel_path"))
        self.heads = S.Store(spark, f"{path}/heads", ("directory",), 1)
        self.overviews = S.Store(spark, f"{path}/overviews", ("directory",), 1)

    def ensure(self) -> bool:
        for store, schema in ((self.manifest, MANIFEST), (self.heads, HEAD), (self.overviews, OVERVIEW)):
            if not store.exists():
                store.write(self.spark.createDataFrame([], schema))
        dim = self.spec.dim if self.spec.kind == "hash" else embeddings.provider(self.spec).dim
        return S.ensure(self.chunks, dim, CHUNK)

    def is_indexed(self, directory: str) -> bool:
        df = self.chunks.load()
        return df is not None and S.is_indexed(df, os.path.abspath(directory))

    def corpus(self, directory: str) -> DataFrame:
        """id, tokens, dl of one directory, kept in memory while the table stays the same."""
        directory, version = os.path.abspath(directory), (self.chunks.state() or {}).get("version")
        held = self._corpora.get(directory)
        if held is None or held[0] != version:
            if held is not None:
                held[1].unpersist()
            here = self.chunks.read().where(F.col("directory") == directory).select("id", "tokens", "dl")
            held = self._corpora[directory] = (version, here.persist())
        return held[1]

    def _old_manifest(self, directory: str) -> DataFrame:
        df = self.manifest.load()
        if df is None:
            return self.spark.createDataFrame([], MANIFEST)
        return df.where(F.col("directory") == directory)

    def _commit(self, directory: str) -> str | None:
        df = self.heads.load()
        row = df.where(F.col("directory") == directory).select("commit").first() if df is not None else None
        return row[0] if row else None

    def changes(self, directory: str, files: DataFrame | None = None) -> DataFrame:
        """rel_path, change. In a git checkout that was indexed at a commit, git tells what changed and no content is read; elsewhere every
        file's hash is compared with the manifest."""
        directory = os.path.abspath(directory)
        commit = self._commit(directory) if diff.uses_git(directory) else None
        if files is None and commit and diff.git(directory, "cat-file", "-e", commit) is not None:
            known = self._old_manifest(directory).select("rel_path", F.lit(True).alias("_known"))
            told = diff.git_changes(self.spark, directory, commit)
            # a file that was deleted before it was ever indexed is no change
            return told.join(known, "rel_path", "left").where("change <> 'deleted' OR _known").select("rel_path", "change")
        files = filetree.files(self.spark, directory) if files is None else files
        return diff.changes(diff.manifest(files), self._old_manifest(directory).drop("directory"))

    def ingest(self, directory: str, force: bool = False, include=None, exclude=None, seconds: float | None = None) -> dict:
        """Brings the index up to date within `seconds` (the setting's hours by default); returns files, failed, chunks, deleted, skipped,
        seconds, timed_out.

        Changed files are read, indexed and committed in batches of `ingest_batch`; their old chunks and those of deleted files go in the same
        step that brings the new ones. When the time is up the running batch is cancelled and skipped with the rest, what was committed
        stays, and the next run goes on from there; TimeoutError is raised only where nothing at all was finished. A file that cannot be read
        is left out of the manifest and so tried again. The git checkpoint is written only after a run that skipped nothing.
        """
        sc = self.spark.sparkContext
        limit = self.settings.ingestion_timeout_hours * 3600 if seconds is None else seconds
        group, late = f"tessera-ingest-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            late.set()
            sc.cancelJobGroup(group)

        timer = threading.Timer(max(0.0, limit), stop)
        timer.daemon = True
        sc.setJobGroup(group, f"ingest {directory}", interruptOnCancel=True)
        done = {"files": 0, "failed": 0, "chunks": 0, "deleted": 0, "skipped": 0, "timed_out": False}
        began = time.time()
        timer.start()
        try:
            self._ingest(os.path.abspath(directory), force, include, exclude, late, done)
        except Exception as e:
            if not late.is_set():
                raise
            if not done["files"] and not done["deleted"]:
                raise TimeoutError(f"ingestion of {directory} took more than {limit:g} s") from e
            done["timed_out"] = True
        finally:
            timer.cancel()
            sc.setLocalProperty("spark.jobGroup.id", None)
        return done | {"seconds": time.time() - began}

    def _ingest(self, directory: str, force: bool, include, exclude, late: threading.Event, done: dict) -> None:
        self.ensure()
        commit = diff.head(directory) if diff.uses_git(directory) else None
        options = {k: ",".join(v) for k, v in (("include", include), ("exclude", exclude)) if v}
        files = filetree.files(self.spark, directory, **options).persist()
        delta = diff.changes(diff.manifest(files), self._old_manifest(directory).drop("directory"))
        if force:
            delta = delta.where("change = 'deleted'").unionByName(files.select("rel_path", F.lit("modified").alias("change")))
        delta = delta.persist()
        try:
            n = delta.count()
            batches = -(-n // self.settings.ingest_batch)
            for k in range(batches):
                if late.is_set():
                    done["skipped"] = delta.where(F.pmod(F.xxhash64("rel_path"), F.lit(batches)) >= k).count()
                    raise TimeoutError
                self._step(directory, files, delta.where(F.pmod(F.xxhash64("rel_path"), F.lit(batches)) == k), done)
            if commit and done["failed"] == 0 and not include and not exclude:
                self.heads.update(self.spark.createDataFrame([(directory, commit)], HEAD), lambda old: S.upsert(old, self.spark.createDataFrame([(directory, commit)], HEAD), ["directory"]))
        finally:
            for df in (files, delta):
                df.unpersist()
        for store in (self.chunks, self.manifest):
            store.clean()

    def _step(self, directory: str, files: DataFrame, delta: DataFrame, done: dict) -> None:
        counts = {r["change"]: r["count"] for r in delta.groupBy("change").count().collect()}
        if not counts:
            return
        here = F.lit(directory).alias("directory")
        texts = extract.extract(files.join(delta.where("change <> 'deleted'").select("rel_path"), "rel_path", "left_semi")).persist()
        bad = texts.where("error IS NOT NULL").select("rel_path")
        failed, total = bad.count(), counts.get("new", 0) + counts.get("modified", 0)
        new = build_chunks(texts, directory, self.settings, self.spec).persist()
        made = new.count()
        apply_changes(self.chunks, delta.select(here, F.col("rel_path").alias("file_path")), new)
        if not total or failed < total:
            mine = diff.manifest(files).join(delta.select("rel_path"), "rel_path", "left_semi").join(bad, "rel_path", "left_anti").select(here, "rel_path", "mtime", "size", "md5")
            gone = delta.select(here, "rel_path")
            self.manifest.update(gone, lambda old: S.delete(old, gone, ["directory", "rel_path"]).unionByName(mine))
        for df in (new, texts):
            df.unpersist()
        for k, v in (("files", total), ("failed", failed), ("chunks", made), ("deleted", counts.get("deleted", 0))):
            done[k] += v

    def save_overview(self, directory: str, overview: dict, fingerprint: str) -> None:
        row = self.spark.createDataFrame([(directory, fingerprint, json.dumps(overview))], OVERVIEW)
        self.ensure()
        self.overviews.update(row, lambda old: S.upsert(old, row, ["directory"]))
        self.overviews.clean()
