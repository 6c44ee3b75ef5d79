"""Session helpers: where a job may keep shared intermediate data."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only where the session names none (local tests) a temporary folder is made,
    and it becomes the session's checkpoint folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    if current is not None:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Tables that this process has kept and not yet removed.
_tables: list[str] = []


def clear_scratch(spark: SparkSession, keep: int = 0) -> int:
    """Delete the tables that ``cut_lineage`` has kept, but for the first ``keep``; say how many went.

    For callers that are done with every result read from them.
    """
    gone = _tables[keep:]
    for name in gone:
        folder = spark._jvm.org.apache.hadoop.fs.Path(name)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    del _tables[keep:]
    return len(gone)


@contextmanager
def scratch(spark: SparkSession):
    """Tables kept inside the block go at its end; collect or write results before.

    The block's value is a function that keeps a table beyond the end, up to that of the block around.
    """
    before, longer = len(_tables), []

    def stays(df: DataFrame) -> DataFrame:
        kept = cut_lineage(df)
        longer.append(_tables.pop())
        return kept

    try:
        yield stays
    finally:
        clear_scratch(spark, keep=before)
        _tables.extend(longer)


def ship(spark: SparkSession) -> None:
    """Give this package to the workers, once for each application.

    The archive goes through the shared folder, so a cluster needs no copy of it.
    """
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = Path(__file__).parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{package.name}-{application}.zip")
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    stream.write(bytearray(packed.getvalue()))
    stream.close()
    spark.sparkContext.addPyFile(target.toString())
    _shipped.add(application)


_shipped: set[str] = set()


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows, kept as a table in the shared folder.

    Later steps read that table: they do not repeat the work, they prune its columns,
    and no lost executor takes it away.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    _tables.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch between Spark and a worker.
BATCH_ROWS = 1_024


def small_batches(spark: SparkSession) -> None:
    """Make the session's Arrow batches no larger than ``BATCH_ROWS`` rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def spread(df: DataFrame) -> DataFrame:
    """Use every core on an input that arrives in fewer splits than there are cores.

    A large table has more splits than cores and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
