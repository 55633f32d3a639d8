"""Incremental index maintenance: a stream of files or rows into versioned tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import store as S
from tessera.operators.ingest import Index, apply_changes, build_chunks
from tessera.sources import extract
from tessera.sources.filetree import FileTree


def apply_batch(store: S.Store, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the latest row per key; a store with keys rewrites only the buckets that the batch touches.

    The last batch applied is a property of the stored version, written with it, so a batch replayed after a failure changes nothing.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        state = store.state()
        if state is not None and state["properties"].get("batch", -1) >= batch_id:
            return
        by = [F.col(c) for c in order]
        if state is not None and store.keys:
            store.update(batch, lambda old: S.latest(old.unionByName(batch), keys, by), batch=batch_id)
        else:
            old = store.load()
            store.write(S.latest(batch if old is None else old.unionByName(batch), keys, by), batch=batch_id)
        store.clean()

    return sink


def upsert_stream(source: DataFrame, store: S.Store, keys: list[str], order: list[str], checkpoint: str) -> None:
    """Drains what is available of a streaming DataFrame into the store."""
    q = source.writeStream.foreachBatch(apply_batch(store, keys, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def watch_files(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """Files below root as a stream: each batch holds the new and changed ones, and a row with deleted = true for each that is gone.

    The option `listings` names a folder that the driver and a restarted query can read, for the listings that offsets refer to.
    """
    spark.dataSource.register(FileTree)
    return spark.readStream.format("filetree").options(**{"deletions": "true", **options}).load(root)


def index_files(index: Index, root: str, checkpoint: str, **options: str) -> StreamingQuery:
    """Keeps the index of root up to date from a stream of its files: every micro-batch replaces the chunks of changed files and removes those of
    deleted ones. A replayed batch changes nothing, since a step replaces what it finds."""
    import os

    root = os.path.abspath(root)
    index.ensure()

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        delta = batch.select(F.lit(root).alias("directory"), F.col("rel_path").alias("file_path")).distinct()
        texts = extract.extract(batch.where("NOT deleted").drop("deleted"))
        apply_changes(index.chunks, delta, build_chunks(texts, root, index.settings, index.spec))
        index.chunks.clean()
        batch.unpersist()

    stream = watch_files(index.spark, root, **options)
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
