"""Session helpers shared by every operator: shipping the package, shared scratch tables."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_LOCAL_SCRATCH: dict[str, str] = {}
_PASSING: ContextVar[list[DataFrame] | None] = ContextVar("passing", default=None)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, as ``--py-files`` would."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="skyweft-ship-"), "skyweft_pkg.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.join("skyweft", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def scratch_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Where that is unset a temporary folder is used, on a local master only; a cluster has to
    name a folder that all of its machines share.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="skyweft-")
    return _LOCAL_SCRATCH[app]


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, for steps whose work their bytes don't show: a number given to
    ``repartition`` isn't lowered to few tasks by the bytes that are shuffled."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared scratch folder and read it back.

    Cuts the lineage: a lost executor costs a reread, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    made = _PASSING.get()
    if made is not None:
        made.append(out)
    return out


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables materialized inside are listed and deleted at the end, unless they are taken off the list; so are the shuffles of plans no longer used.

    For a large job in parts, whose tables would not fit the disk together.
    """
    token = _PASSING.set(made := [])
    try:
        yield made
    finally:
        _PASSING.reset(token)
        for df in made:
            discard(df)
        made.clear()
        gc.collect()
        spark.sparkContext._jvm.System.gc()  # shuffle files go when the driver's garbage is collected


def discard(df: DataFrame) -> None:
    """Delete a table written by :func:`materialize`; its readers must have ended."""
    path = getattr(df, "_scratch_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
