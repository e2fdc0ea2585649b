"""Session settings the results depend on."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Fix the time zone and let Spark re-plan skewed joins and small partitions at run time."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    return spark


#: Rows of a batch that goes to Python: with whole texts in them, more would be held twice in the executor and again there.
BATCH = 1024


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python in small batches, so that their buffers stay a few MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A folder every executor reaches: below the cluster's checkpoint folder.

    Only a local session that names none, as in tests, gets one of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        if not _OWN_DIR:
            _OWN_DIR.append(tempfile.mkdtemp(prefix="tallyloom-"))
        base = _OWN_DIR[0]
    return f"{base.rstrip('/')}/{name}"


#: Tables made inside the open `scratch` blocks, the innermost last.
_OPEN: list[list[str]] = []


class Scratch:
    """The intermediate tables of a block; those kept outlive it."""

    def __init__(self, paths: list[str]):
        self.paths = paths

    def keep(self, frame: DataFrame) -> DataFrame:
        """The table that `materialise` made for this frame goes to the block outside, or stays."""
        read = {f.rsplit("/", 1)[0] for f in frame.inputFiles()}
        mine = [p for p in self.paths if any(_same(p, f) for f in read)]
        self.paths[:] = [p for p in self.paths if p not in mine]
        if len(_OPEN) > 1:
            _OPEN[-2].extend(mine)
        return frame


def _same(path: str, folder: str) -> bool:
    bare = lambda p: p.split(":", 1)[-1].replace("//", "/").rstrip("/")
    return bare(path).lstrip("/") == bare(folder).lstrip("/")


@contextmanager
def scratch(spark: SparkSession):
    """Deletes the intermediate tables made inside the block when it ends, but for those kept.

    A result is read lazily from such tables, so it has to be written or collected, or itself be
    materialised and kept, before the block ends.
    """
    _OPEN.append([])
    try:
        yield Scratch(_OPEN[-1])
    finally:
        for made in _OPEN.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(made)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder once and read from there.

    For an intermediate table that several results read: it is computed once, later plans
    start from the files, and losing executors loses nothing.
    """
    path = shared_dir(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    if _OPEN:
        _OPEN[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
