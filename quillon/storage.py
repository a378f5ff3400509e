"""Written tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_made: ContextVar[list[str]] = ContextVar("made", default=[])  # noqa: B039


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, the warehouse, and with a local master a folder of
    this process, removed at its end."""
    conf = spark.sparkContext.getConf()
    if named := conf.get("spark.checkpoint.dir"):
        return named.rstrip("/")
    master = conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="quillon-stages-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written once and read again: a short plan for what follows, and safe when executors are lost."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _made.get().append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Removes the stages that this ``temporary`` block, or code outside of any, has written so far; results that read
    them must be done with."""
    made = _made.get()
    while made:
        target = spark._jvm.org.apache.hadoop.fs.Path(made.pop())
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Stages that are written inside the block, by this thread, are removed at its end."""
    token = _made.set([])
    try:
        yield
    finally:
        release(spark)
        _made.reset(token)
