"""Chunk, vector and corpus tables on parquet: versions behind a pointer, replaced bucket by bucket and never overwritten in place."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


BUCKETS = 64


class Store:
    """A versioned table in a shared folder. A reader sees the files that the pointer names; a writer adds a version, then moves the
    pointer by an atomic rename. Any Hadoop file system that renames atomically will do.

    With keys, rows lie in `buckets` buckets by a hash of their keys (as many as were named when the table was made; take some per hundred
    gigabytes), and `update` reads and writes only the buckets that the changed keys fall into. Within a bucket's files rows are sorted by
    directory where there is one, so that a filter on it skips row groups.
    """

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = (), buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self._buckets = spark, path.rstrip("/"), tuple(keys), buckets
        jvm = spark.sparkContext._jvm
        self._p = jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _read_text(self, path: str) -> str | None:
        p = self._p(path)
        if not self._fs.exists(p):
            return None
        rows = self.spark.read.text(path, wholetext=True).collect()
        return rows[0][0] if rows else None

    def _write_text(self, path: str, text: str) -> None:
        tmp = f"{path}.{uuid.uuid4().hex}"
        out = self._fs.create(self._p(tmp), True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        sc = self.spark.sparkContext
        fs = sc._jvm.org.apache.hadoop.fs
        over = sc._gateway.new_array(fs.Options.Rename, 1)
        over[0] = fs.Options.Rename.OVERWRITE
        fs.FileContext.getFileContext(self._fs.getUri(), sc._jsc.hadoopConfiguration()).rename(self._p(tmp), self._p(path), over)

    def state(self) -> dict | None:
        """The pointer: version and properties; None for a missing or corrupt one."""
        try:
            return json.loads(self._read_text(f"{self.path}/current.json") or "null")
        except ValueError:
            return None

    def exists(self) -> bool:
        return self.state() is not None

    def _paths(self, state: dict, only: set[int] | None = None) -> list[str]:
        if state.get("parts") is None:
            return [f"{self.path}/{state['version']}"]
        return [f"{self.path}/{v}/bucket={b}" for b, v in state["parts"].items() if only is None or int(b) in only]

    def _load(self, state: dict, only: set[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(state["schema"])
        paths = self._paths(state, only)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        s = self.state()
        if s is None:
            raise FileNotFoundError(self.path)
        return self._load(s)

    def load(self) -> DataFrame | None:
        return self.read() if self.exists() else None

    def buckets(self, state: dict | None = None) -> int:
        return ((state or self.state()) or {}).get("buckets") or self._buckets

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(n)).cast("int")

    def _save(self, df: DataFrame, state: dict | None, touched: set[int] | None, properties: dict) -> str:
        s = state or {"number": 0, "properties": {}}
        number = s["number"] + 1
        version = f"v{number:08d}-{uuid.uuid4().hex[:8]}"
        new = {"version": version, "number": number, "properties": s["properties"] | properties, "schema": df.schema.jsonValue(), "before": self._versions(s)}
        if self.keys:
            n = self.buckets(state)
            order = ["bucket", *[c for c in ("directory",) if c in df.columns]]
            # rebalancing splits a large bucket and gathers small ones, so that no task writes a hot bucket alone
            df.withColumn("bucket", self._bucket(n)).hint("rebalance", "bucket").sortWithinPartitions(*order).write.partitionBy("bucket").parquet(f"{self.path}/{version}")
            made = {m[1]: version for f in self._fs.listStatus(self._p(f"{self.path}/{version}")) if (m := re.match(r"bucket=(\d+)$", f.getPath().getName()))}
            kept = {b: v for b, v in (s.get("parts") or {}).items() if touched is not None and int(b) not in touched}
            new |= {"buckets": n, "parts": kept | made}
        else:
            df.write.parquet(f"{self.path}/{version}")
        self._write_text(f"{self.path}/current.json", json.dumps(new))
        return version

    @staticmethod
    def _versions(state: dict) -> list[str]:
        return sorted({v for v in [state.get("version"), *(state.get("parts") or {}).values()] if v})

    def write(self, df: DataFrame, **properties) -> str:
        """Replaces the whole table."""
        return self._save(df, self.state(), None, properties)

    def update(self, changed: DataFrame, new: Callable[[DataFrame], DataFrame], **properties) -> list[int]:
        """Replaces the buckets that the keys of `changed` fall into by what `new` makes of their rows; returns these buckets. `new` must
        give rows of these buckets only."""
        s = self.state()
        if s is None or s.get("parts") is None:
            raise ValueError("update needs a table that was written with keys")
        touched = {r[0] for r in changed.select(self._bucket(self.buckets(s)).alias("b")).distinct().collect()}  # at most as many as there are buckets
        if touched:
            self._save(new(self._load(s, touched)), s, touched, properties)
        return sorted(touched)

    def clean(self, keep: int = 2) -> None:
        """Removes what the current state (with keep > 1 also the one before it) does not read, and whatever an interrupted writer left."""
        s = self.state()
        if s is None:
            return
        used = {*self._versions(s), *(s.get("before", []) if keep > 1 else [])}
        for f in self._fs.listStatus(self._p(self.path)):
            name = f.getPath().getName()
            if re.match(r"v\d{8}-", name) and name not in used:
                self._fs.delete(f.getPath(), True)


def ensure(store: Store, dim: int, schema: str) -> bool:
    """Creates the collection if it is absent or of another dimension (then its rows are dropped); True if it was made anew."""
    s = store.state()
    if s is not None and s["properties"].get("dim") == dim:
        return False
    store.write(store.spark.createDataFrame([], schema), dim=dim)
    return True


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the greatest by `order`. Aggregates on the map side, so a key that a third of the rows share is no hot spot."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*").select(*rows.columns)


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """stored without the keys of new, and new."""
    return stored.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def delete(stored: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """stored without the rows whose keys occur in gone. NULL keys are never deleted."""
    return stored.join(gone.select(*keys).distinct(), keys, "left_anti")


def delete_where(stored: DataFrame, directory: str | None = None, file_path: str | None = None) -> DataFrame:
    conds = [F.col("directory") == directory] if directory is not None else []
    conds += [F.col("file_path") == file_path] if file_path is not None else []
    hit = reduce(lambda a, b: a & b, conds, F.lit(True)) if conds else F.lit(False)
    return stored.where(~F.coalesce(hit, F.lit(False)))


def is_indexed(chunks: DataFrame, directory: str) -> bool:
    return not chunks.where(F.col("directory") == directory).limit(1).isEmpty()


def stats(points: DataFrame, dim: int, provider: str = "hash", mode: str = "local") -> DataFrame:
    """total_points, indexed_vectors, status, provider, storage_mode."""
    good = F.count_if(F.size("vector") == dim)
    return points.agg(F.count(F.lit(1)).alias("total_points"), good.alias("indexed_vectors")).select(
        "total_points", "indexed_vectors", F.when(F.col("total_points") > 0, "green").otherwise("empty").alias("status"), F.lit(provider).alias("provider"), F.lit(mode).alias("storage_mode")
    )
