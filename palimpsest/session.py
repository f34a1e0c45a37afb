"""Where intermediate tables go, and how the package reaches the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as a full URI of the store that it lies in, the same for Spark and for code outside it.

    A path without a scheme is one of the default file system (``fs.defaultFS``), not of the local
    disk; a mount (viewfs) is followed to what is behind it.  The folder is made if it isn't there.
    """
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        fs.mkdirs(p)
    return fs.resolvePath(p).toString().rstrip("/")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as set in ``spark.checkpoint.dir``, as a full URI.

    Only where that is unset, as in local tests, a temporary folder takes its place.
    """
    sc = spark.sparkContext
    asked = sc.getConf().get("spark.checkpoint.dir")
    known = getattr(sc, "_palimpsest_root", None)
    if known and known[0] == asked:
        return known[1]
    root = asked
    if not root:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="palimpsest-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = f"file://{folder}"
    sc._palimpsest_root = asked, qualified(spark, root)
    return sc._palimpsest_root[1]


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, rows_a_group: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and survives lost executors.

    rows_a_group: rows in a row group.  Tasks hold one whole when they write, and up to 4,096 of its rows when they
    read; so tables with rows of megabytes need small ones.
    """
    spark = df.sparkSession
    path = scratch(spark, what)
    out = df.write.option("compression", "zstd")
    if rows_a_group:
        out = out.option("parquet.block.row.count.limit", rows_a_group)
    out.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """Everything that scratch() names inside goes to one folder, which is removed at the end: write results elsewhere first."""
    sc = spark.sparkContext
    root, before = shared_root(spark), getattr(sc, "_palimpsest_root", None)
    folder = qualified(spark, f"{root}/run-{uuid.uuid4().hex}")
    sc._palimpsest_root = before[0], folder
    try:
        yield folder
    finally:
        sc._palimpsest_root = before
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for an application."""
    sc = spark.sparkContext
    if getattr(sc, "_palimpsest_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="palimpsest-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"palimpsest_{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
    sc.addPyFile(path)
    # Texts are long, so batches for Python are smaller than by Spark's defaults.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", min(1000, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))))
    sc._palimpsest_shipped = True


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column has it (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
