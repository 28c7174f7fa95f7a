"""Session helpers: importable workers and tables in the shared folder."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Arrow batches of Python steps where the session leaves Spark's own: (setting, Spark's default, ours).
BATCHES = (
    ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"),
    ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4194304b"),
)
#: Environment of Python workers, so that they give memory back: one heap, large blocks of their own, and Arrow without a pool.
MEMORY = {"MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": "262144", "MALLOC_TRIM_THRESHOLD_": "1048576", "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: Seconds between collections that let Spark remove shuffle files.
RELEASE_S = 4
_PACKAGE = Path(__file__).resolve().parents[1]
#: Name of the archive in which the package is sent to executors.
_SENT = f"{_PACKAGE.name}-{uuid.uuid4().hex}.zip"


def _archive(folder: str) -> str:
    path = os.path.join(folder, _SENT)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(_PACKAGE.rglob("*.py")):
            out.write(file, file.relative_to(_PACKAGE.parent))
    return path


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package, and keep what they hold at once small.

    Workers of this machine take it from its folder.  Executors get it as an
    archive of some 100 KB, which the driver serves while the session lasts.
    """
    sc = spark.sparkContext
    env = sc.environment
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        parts = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
        if str(_PACKAGE.parent) not in parts:
            env["PYTHONPATH"] = os.pathsep.join([str(_PACKAGE.parent), *parts])
    elif not any(f.endswith(_SENT) for f in sc.listFiles):
        folder = tempfile.mkdtemp(prefix="lodestep-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.addPyFile(_archive(folder))
    for name, value in MEMORY.items():
        env.setdefault(name, value)
    for name, default, ours in BATCHES:
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, ours)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none (local tests) a folder of this machine is
    set, once for the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestep-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


class Scratch:
    """Intermediate tables as Parquet in the shared folder.

    A written table cuts lineage and survives lost executors.  ``drop`` deletes
    a table that no later step reads; what is left goes when Python exits.
    """

    released = 0.0

    def __init__(self, spark: SparkSession, name: str):
        ensure_importable(spark)
        self.spark = spark
        self.base = f"{shared_dir(spark)}/lodestep-{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        if time.monotonic() - self.released >= RELEASE_S:
            self.release()
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def release(self) -> None:
        """Let Spark's cleaner remove the shuffle files of steps whose result is written."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        Scratch.released = time.monotonic()

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)

    def close(self) -> None:
        if self.spark.sparkContext._jsc is None:
            return
        try:
            self._delete(self.base)
        except Exception:  # the JVM may be gone when Python exits
            pass
