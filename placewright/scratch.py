"""Tables written to cut lineage, in the folder that the cluster names for it."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

_own: dict[str, str] = {}  # temporary folders of local sessions, by application
_scope: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scope", default=None)


def scratch_dir(spark: SparkSession) -> str:
    """A fresh path below ``spark.checkpoint.dir``.

    The setting has to name a folder that all executors share. Only a local session may leave it unset;
    its tables then go to a temporary folder, and its settings stay as they are.
    """
    base = spark.conf.get(CHECKPOINT_KEY, None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
        application = spark.sparkContext.applicationId
        if application not in _own:
            _own[application] = tempfile.mkdtemp(prefix="placewright-")
        base = _own[application]
    path = f"{base.rstrip('/')}/placewright-{uuid.uuid4().hex}"
    if (owned := _scope.get()) is not None:
        owned.append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` once and return a scan of it, with its real size known to the planner."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def removed_after(spark: SparkSession) -> Iterator[None]:
    """Remove the tables written within the block at its end, when nothing reads them any more."""
    token = _scope.set([])
    try:
        yield
    finally:
        owned = _scope.get() or []
        _scope.reset(token)
        jvm = spark._jvm
        for path in owned:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
