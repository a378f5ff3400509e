"""Shared folders, table reading and small column helpers for the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None
#: Folders and tables of this thread of work, for ``release``.
_made: ContextVar[list[tuple[str, str | None]]] = ContextVar("made", default=[])  # noqa: B039


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    That is ``spark.checkpoint.dir``. Where it is unset, a local master gets a folder of its own
    (removed at exit) and any other master the warehouse, which executors share as well.
    """
    global _own_dir
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = conf.get("spark.master", "")
    if master.startswith("local") and not master.startswith("local-cluster"):
        if _own_dir is None:
            _own_dir = tempfile.mkdtemp(prefix="quillon-")
            atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
        return f"file://{_own_dir}"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def workspace(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.get().append((path, None))
    return path


def drop_on_release(table: str, path: str) -> None:
    """Let ``release`` drop an external table and its folder."""
    _made.get().append((path, table))


def release(spark: SparkSession) -> None:
    """Remove all folders and tables that this ``scratch`` block, or code outside of any, has made so
    far; results that read them must be done with."""
    made = _made.get()
    while made:
        path, table = made.pop()
        if table:
            spark.sql(f"DROP TABLE IF EXISTS `{table}`")
        discard(spark, path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is made inside the block is removed at its end, and nothing else."""
    token = _made.set([])
    try:
        yield
    finally:
        release(spark)
        _made.reset(token)


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to ``path`` and read it again, which cuts its lineage durably."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: str = "4m", rows: int = 1000) -> Iterator[None]:
    """While plans are made in this block, rows go to Python in batches of this size at most, so that
    neither side holds many whole texts at once. The session's own settings come back at its end; plans that other threads
    of the session make meanwhile get these batches too, which changes no results."""
    own = {"spark.sql.execution.arrow.maxBytesPerBatch": size, "spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder of the workspace that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes the fast path of ``lower``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def quoted(name: str) -> Column:
    """The column of this very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row; maps and variants, which can't be hashed, by their JSON."""
    odd = lambda c: any(k in df.schema[c].dataType.simpleString() for k in ("map<", "variant"))
    return F.xxhash64(*(F.to_json(F.struct(quoted(c))) if odd(c) else quoted(c) for c in df.columns))


def free_name(df: DataFrame, stem: str) -> str:
    """A name like ``stem`` that no column of ``df`` has, letters' case aside."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name
