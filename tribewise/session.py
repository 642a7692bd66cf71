"""Session construction and cluster-wide settings.

On a cluster the caller owns the session; ``get_session`` is for local runs
and tests.  ``checkpoint_dir`` reads ``spark.checkpoint.dir`` from the
session and only falls back to a fresh local folder when none is configured
(tests, laptops).  Lineage of iterative jobs is cut with ``checkpoint()``
into that shared folder, never with ``localCheckpoint`` (lost executors
would lose the data).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SCALE_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tribewise", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in SCALE_DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tribewise`` importable in Python workers (once per context).

    Pandas UDFs defined here reference module helpers, so executors need the
    package; it is zipped and registered with ``addPyFile`` (what
    ``--py-files`` does for a submitted job).
    """
    import zipfile
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="tribewise-pkg-"), "tribewise.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster; a local one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if sc.master != "local" and not sc.master.startswith("local["):  # also not local-cluster: its executors are other processes
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="tribewise-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


@contextmanager
def open_shared(uri: str, mode: str) -> Iterator:
    """Open a file of the shared folder from a task, by its scheme (file, hdfs, s3 ...)."""
    from pyarrow import fs
    system, path = fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1)
                                          if uri.startswith("file:") else f"file://{uri}")
    if mode == "w":
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(path, compression=None) as f:
            yield f
    else:
        with system.open_input_file(path) as f:
            yield f


def cut_lineage(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative job's state.

    The state is written as a Parquet table under the shared checkpoint
    folder (``spark.checkpoint.dir``) and read back: it survives executor
    loss, and the next round plans against a plain file scan.  (A
    ``Dataset.checkpoint`` leaf keeps the origin plan's statistics, which
    made planning cost grow round after round.)
    """
    spark = df.sparkSession
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tw-state-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    out = spark.read.parquet(path)
    out._state_path = path
    return out


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared checkpoint folder."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(conf).delete(folder, True)


def drop_state(*tables: DataFrame | None) -> None:
    """Delete the files of ``cut_lineage`` tables that no later step reads."""
    for df in tables:
        path = getattr(df, "_state_path", None)
        if path:
            drop_folder(df.sparkSession, path)


def default_parallelism(spark: SparkSession) -> int:
    try:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    except Exception:  # pragma: no cover
        return os.cpu_count() or 8
