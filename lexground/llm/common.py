"""Shared helpers: table access, lineage cuts, sizes, and what Python workers hold between tasks."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where the setting is absent (local tests)."""
    found = spark.sparkContext.getCheckpointDir()
    if found is None:
        found = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="lexground-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that later jobs neither recompute it nor depend on one executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared checkpoint folder, of which later jobs read only the columns they need; and its path,
    for ``removed``."""
    from uuid import uuid4

    place = f"{checkpoint_dir(df.sparkSession)}/table-{uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place), place


def removed(spark: SparkSession, place: str) -> None:
    """Deletes a written table, by Spark's own file systems."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def nested(df: DataFrame) -> DataFrame:
    """All columns as one, ``document``, so that no name of theirs can clash with one added beside it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("document"))


def beside(rows: DataFrame, input_columns: list[str], added: list[str]) -> DataFrame:
    """The columns of ``document`` and the ``added`` ones; an input column called like an added one is left out."""
    return rows.select(*[F.col(f"document.`{c}`") for c in input_columns if c not in added], *added)


_kept: dict = {}


def forget(but=None) -> None:
    """Drops what ``kept`` holds, unless it is that of key ``but``."""
    if but not in _kept:
        _kept.clear()


def kept(key, make: Callable):
    """``make()``, once per Python worker until another key is asked for: workers outlive a stage, and so would its vocabulary."""
    forget(key)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Gives the memory that this process has freed back to the system, which its allocators would hold beside the next stage's."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(work: Callable, uses=None) -> Callable:
    """``work``, a function of a task's batches that needs no kept object but that of key ``uses``, and releases what it has freed."""

    def run(batches):
        forget(uses)
        try:
            yield from work(batches)
        finally:
            release()

    return run


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
