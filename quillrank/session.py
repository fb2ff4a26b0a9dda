"""Session settings and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "quillrank", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    n = str(cores)
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8" if n == "*" else n)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as the session names it.

    ``spark.checkpoint.dir`` is read from the session. Only a local session that leaves it
    unset gets a folder of its own; on a cluster an unset value is an error, because a
    machine-local folder would not survive the loss of an executor.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="quillrank-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes in this block are deleted as each write ends.

    Nothing reads them again, and they would otherwise lie on the disks of the executors until the driver happens to
    collect its garbage, so that those of all steps of a job add up.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage: a lost executor re-reads the table instead of recomputing the plan, and every
    reader of the result sees the same rows in the same files.
    """
    path = fresh_path(df.sparkSession, label)
    with shuffles_dropped(df.sparkSession):
        df.write.mode("errorifexists").parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    _stored[stored] = path
    return stored


_stored: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def discard(stored: DataFrame) -> None:
    """Delete the table that ``materialize`` returned as ``stored``; neither it nor what is built on it can be read any more."""
    spark = stored.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(_stored.pop(stored))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when a source gives fewer partitions than there are cores.

    One gzip file, or one parquet row group, is one task. Larger inputs are left as they are,
    so no shuffle is added where the scan already splits well. Three pieces per core even out
    documents of very different lengths. A plan that already exchanges data is left alone:
    asking it for its partitions would run its stages.
    """
    if re.search(r"(?<!Broadcast)Exchange", df._jdf.queryExecution().executedPlan().toString()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(3 * cores)


#: Bytes of a batch that goes to a Python worker, if it has more than one row, and rows at most.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2_000


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose batches for Python are bounded, so that long texts don't add up in a worker.

    Settings of the session that are smaller stay.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        now = str(conf.get(key)).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, most)
    return df
