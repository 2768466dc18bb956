"""Session helpers: shipping this package to executors, shared scratch tables."""

from __future__ import annotations

import ctypes
import functools
import io
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Rows of a batch of whole texts. The JVM and a worker each hold a batch or two a task.
BATCH_ROWS = 2000


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by Python workers, whatever their sys.path.

    The zip goes through Spark's own file server, so no shared folder is needed.
    One upload per SparkContext.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="ship-")) / f"{root.name}-pkg.zip"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(Path(root.name) / f.relative_to(root)))
    out.write_bytes(buf.getvalue())
    spark.sparkContext.addPyFile(str(out))
    _SHIPPED.add(app)


def small_batches(spark: SparkSession) -> None:
    """At most BATCH_ROWS rows in a batch for Python workers, from now on in this session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def give_back() -> None:
    """Hand this process's free memory back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` in a worker that keeps no free memory from batch to batch.

    Workers outlive a task, and what their allocators keep of it adds to the memory of all later ones.
    """

    @functools.wraps(run)
    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                give_back()

        try:
            yield from run(fed())
        finally:
            give_back()

    return lean_run


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for cut lineage: ``spark.checkpoint.dir`` where it is set.

    Only where a local session names none (tests, a laptop) an own folder is used and
    registered, so that ``checkpoint()`` and written tables agree; a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared scratch folder and read it back.

    Cuts lineage with files that survive the loss of any executor.
    """
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path  # type: ignore[attr-defined]
    return out


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete scratch tables that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for t in tables:
        path = getattr(t, "scratch", None)
        if path:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
