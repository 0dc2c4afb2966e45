"""Session for tests and benchmarks, and the shared folder jobs may write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session. A cluster brings its own; nothing else here depends on this."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("parley")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="parley-"))
    return context.getCheckpointDir()


#: Bytes that Spark hands to a Python worker at once; its own bounds are 10,000 rows or 64 MB.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Whole texts go to Python workers in batches of ``BATCH_BYTES``, unless the session says how large they are.

    A batch is held by the executor and by the worker, of each task that runs there.
    """
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


_written: list[str] = []


def written(df: DataFrame, file_rows: int = 0) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, of at most ``file_rows`` rows a file, if given.

    It is computed once, later steps read only the columns they need, and a lost executor
    loses none of it. ``clear_written`` removes such tables when results are kept elsewhere.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_written(spark: SparkSession) -> None:
    """Remove all tables of ``written``. What was made from them must not be computed again."""
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
