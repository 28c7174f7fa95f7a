"""Importable workers, and cutting lineage in loops, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
#: Name of the archive in which the package is sent to executors.
_SENT = f"{_PACKAGE.name}-{uuid.uuid4().hex}.zip"


def archive(folder: str) -> str:
    """The package as an archive of some 100 KB."""
    path = os.path.join(folder, _SENT)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(_PACKAGE.rglob("*.py")):
            out.write(file, file.relative_to(_PACKAGE.parent))
    return path


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package.

    Workers of this machine take it from its folder.  Executors get it as an
    archive, which the driver serves while the session lasts.
    """
    sc = spark.sparkContext
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        parts = [p for p in sc.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
        if str(_PACKAGE.parent) not in parts:
            sc.environment["PYTHONPATH"] = os.pathsep.join([str(_PACKAGE.parent), *parts])
    elif not any(f.endswith(_SENT) for f in sc.listFiles):
        folder = tempfile.mkdtemp(prefix="lodestep-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.addPyFile(archive(folder))


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where a local session has none, a folder of this machine is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestep-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Paths that ``cut`` made in this context, and those that go when Python exits.
_MADE: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)
_LEFT: list[tuple[SparkSession, str]] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is there goes with the context of ``cuts``, or when Python exits."""
    path = f"{shared_dir(spark)}/lodestep-{name}-{uuid.uuid4().hex}"
    _made(spark, path)
    return path


def _made(spark: SparkSession, path: str) -> None:
    made = _MADE.get()
    if made is not None:
        made.append(path)
    else:
        if not _LEFT:
            atexit.register(_sweep)
        _LEFT.append((spark, path))


def _sweep() -> None:
    for spark, path in _LEFT:
        if spark.sparkContext._jsc is not None:
            with contextlib.suppress(Exception):  # the JVM may be gone when Python exits
                delete(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there, so that loops don't grow plans and lost executors don't matter.

    A checkpoint keeps the estimated size of its plan.  Joins multiply these, so that
    in a loop they become numbers of so many digits that planning takes longer than
    the work; what is returned has no estimate.
    """
    spark = df.sparkSession
    shared_dir(spark)
    out = df.checkpoint()
    rows = out._jdf.logicalPlan().rdd()
    if rows.getCheckpointFile().isDefined():
        _made(spark, rows.getCheckpointFile().get())
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, out._jdf.schema(), False), spark)


#: Rows of a task; and the partitions up to which every task that deals out rows opens a file for each of them.
TASK_ROWS, FILES = 500_000, 200


def parts(spark: SparkSession, rows: float) -> int:
    """Partitions for so many rows: one for each core, or one for ``TASK_ROWS`` and then more than ``FILES``."""
    cores, wanted = spark.sparkContext.defaultParallelism, int(rows // TASK_ROWS)
    return cores if wanted <= cores else max(wanted, FILES + 1)


@contextlib.contextmanager
def cuts(spark: SparkSession) -> Iterator[None]:
    """What is cut inside is deleted at the end; results must be collected by then."""
    token = _MADE.set(made := [])
    try:
        yield
    finally:
        _MADE.reset(token)
        for path in made:
            delete(spark, path)


def filesystem(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path) of an address."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = filesystem(spark, path)
    return fs.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    fs, target = filesystem(spark, path)
    fs.delete(target, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, source = filesystem(spark, old)
    _, target = filesystem(spark, new)
    fs.mkdirs(target.getParent())
    if not fs.rename(source, target):
        raise OSError(f"{old} can't be moved to {new}")


def children(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """(name, whether it is a folder) of what a folder holds; a missing folder holds nothing."""
    fs, target = filesystem(spark, path)
    if not fs.exists(target):
        return []
    return sorted((s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(target))


def touch(spark: SparkSession, path: str) -> None:
    """Make an empty file."""
    fs, target = filesystem(spark, path)
    fs.create(target, True).close()
