"""Session helpers shared by the operators."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 2_000
#: Spark's setting that drops a query's shuffle files when it ends.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: For rows of megabytes: Parquet looks at its buffers after each row, as of its own accord only after 100, and a row group, which is read at once, stays small.
_LARGE_ROWS = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 4, "parquet.enable.dictionary": "false"}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or the context's checkpoint folder; one of the two must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Give the tasks' Python workers this package, once per application, wherever the driver has imported it from."""
    sc = spark.sparkContext
    if getattr(sc, "_bandlake_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="bandlake-")) / "bandlake.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._bandlake_shipped = True


def give_back() -> None:
    """Return freed memory to the system: a worker waits for its next task beside the executor that now needs it."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def in_tasks(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package shipped before the function is captured; batches are cut to ``BATCH_ROWS`` rows, as rows may hold whole texts or images."""
    ship(df.sparkSession)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batch.slice(at, BATCH_ROWS) for batch in batches for at in range(0, max(1, batch.num_rows), BATCH_ROWS))
        finally:
            give_back()

    return df.mapInArrow(short, schema)


def settle(df: DataFrame, label: str, large_rows: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, which cuts its lineage; what was shuffled for it is dropped at once.

    ``large_rows`` is for rows of megabytes, of which a task then holds few at a time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.select("*").write.options(**(_LARGE_ROWS if large_rows else {})).parquet(path)  # a frame keeps the setting that it was made under
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
