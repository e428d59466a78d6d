"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only in local mode (tests).

    On a cluster a local folder would be another one on each executor, so there it is an error not to name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or "cluster" in master:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="pagemill-"))
        atexit.register(shutil.rmtree, _own_dir[0], True)
    return "file://" + _own_dir[0]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Cuts lineage: a lost executor costs only the tasks it ran, and values such as row ids or random keys stay as
    they were first drawn.
    """
    path = f"{shared_dir(df.sparkSession)}/pagemill-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._pagemill_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing still to be computed reads."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._pagemill_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Spark deletes a shuffle's files once the driver has collected the plan that made them; so let it collect now.

    What Python has dropped of a plan is let go by a worker that looks once a second, and what listens to queries may hold
    the last one's until the next has ended. A driver that collects before that keeps the files.
    """
    gc.collect()
    time.sleep(2)
    spark.range(1).count()
    for _ in range(2):
        spark._jvm.System.gc()
        time.sleep(0.5)


#: Rows of ids that are broadcast (a few dozen MB at most); more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def few(ids: DataFrame) -> DataFrame:
    """A materialised table of ids and numbers, marked for broadcast if its counted size allows it."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids.hint("merge")


def row_uid() -> Column:
    """A row id. Only stable once the frame that holds it has been materialised."""
    return F.monotonically_increasing_id()


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one, so that their names can clash with no working column."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])
