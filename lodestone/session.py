"""What all parts need from a session: the library on the workers, and a folder that all machines share."""

from __future__ import annotations

import contextlib
import functools
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Let every worker of this session import the library, once per Spark context, wherever it is installed."""
    context = spark.sparkContext
    if getattr(context, "_lodestone_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="spark-")) / "lodestone.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, os.path.join(root.name, f.relative_to(root)))
    context.addPyFile(str(path))
    context._lodestone_shipped = True


@functools.lru_cache(maxsize=1)
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name in spark.checkpoint.dir. Where that is unset, a local folder serves a local session; on a
    cluster it's an error, since the machines would each write to their own disks."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{base or _own_dir()}/{uuid.uuid4().hex}"


_scopes: list[list[DataFrame]] = []


def written(df: DataFrame) -> DataFrame:
    """The same rows read back from the shared folder: cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    for made in _scopes:
        made.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by written() that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written_to)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """The tables that written() makes inside, for discard()."""
    made: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.pop()
