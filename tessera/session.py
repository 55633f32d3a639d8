"""Session defaults, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
}


def build(master: str | None = None, app: str = "tessera", **conf: str) -> SparkSession:
    """A session with the defaults every operator is written for."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    return ship(b.getOrCreate())


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Hands the package to the Python workers of all executors, once per application, so that they need no installation."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = package_root()
        name = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera.zip")
        with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
            for base, _, files in os.walk(os.path.join(root, "tessera")):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(base, f)
                        z.write(full, os.path.relpath(full, root))
        spark.sparkContext.addPyFile(name)  # served by the driver
        _shipped.add(app)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by spark.checkpoint.dir.

    Only a local session that names none gets a temporary folder of its own; a cluster session must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        return "file://" + tempfile.mkdtemp(prefix="tessera-checkpoint-")
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and cut its lineage; the copy survives the loss of executors."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def cores(spark: SparkSession) -> int:
    return max(1, int(spark.sparkContext.defaultParallelism))


def spread(scan: DataFrame) -> DataFrame:
    """A scan with fewer partitions than cores, dealt out evenly; others stay as they are, without a shuffle.

    For work that is far more costly than moving its input: a file of one row group is one task otherwise. Give it a scan with
    filters and a projection, not a plan with exchanges, since the number of partitions is read from the physical plan.
    """
    n = cores(scan.sparkSession)
    return scan if scan._jdf.queryExecution().toRdd().getNumPartitions() >= n else scan.repartition(n)


def package_root() -> str:
    return os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
