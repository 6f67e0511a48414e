"""Session construction and cluster-wide settings.

Library code never invents storage locations: lineage cuts go to the folder
named by ``spark.checkpoint.dir``.  Only a *local* session without that
setting (tests, bench) gets a fresh scratch folder of its own.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every session of this engine wants, whatever the cluster size.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "tessera", extra: dict | None = None) -> SparkSession:
    master = master or os.environ.get("TESSERA_MASTER", "local[8]")
    builder = SparkSession.builder.master(master).appName(app_name)
    for k, v in ENGINE_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEM", "16g"))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a scratch one only for
    local sessions that have none configured."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="run-ckpt-", dir="/tmp")
    sc.setCheckpointDir(path)
    return path


_recorded = threading.local()      # where this thread's new tables are noted


@contextmanager
def recording() -> Iterator[list[str]]:
    """Note the folders of all tables that ``cut_lineage`` writes for this thread
    meanwhile, for ``discard_folders``."""
    before, paths = getattr(_recorded, "paths", None), []
    _recorded.paths = paths
    try:
        yield paths
    finally:
        _recorded.paths = before


def cut_lineage(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder
    and read it back: one computation (a reliable ``checkpoint()`` recomputes
    an uncached input to write it), survives executor loss, and the plan
    restarts from the written files."""
    spark = df.sparkSession
    path = ensure_checkpoint_dir(spark).rstrip("/") + f"/table-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path, compression=compression)
    if getattr(_recorded, "paths", None) is not None:
        _recorded.paths.append(path)
    return spark.read.parquet(path)


def table_names(df: DataFrame) -> set[str]:
    """Names of the folders of ``cut_lineage`` that ``df`` reads."""
    return {f.rsplit("/", 2)[-2] for f in df.inputFiles() if f.rsplit("/", 2)[-2].startswith("table-")}


def discard_folders(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of ``cut_lineage`` that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        if p.rsplit("/", 1)[-1].startswith("table-"):
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)


def discard(table: DataFrame) -> None:
    """Delete a table that ``cut_lineage`` wrote and nothing reads any more."""
    home = ensure_checkpoint_dir(table.sparkSession).rstrip("/")
    discard_folders(table.sparkSession, [f"{home}/{name}" for name in table_names(table)])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
