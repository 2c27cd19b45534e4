"""What the corpus operators share: table access, scratch tables, stable document columns."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.shipping import ship

#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 2 << 20
#: Rows that a Parquet reader decodes at once; whole texts make buffers of tens of megabytes by Spark's default.
READ_ROWS = 512
#: Settings that are put where the session leaves Spark's default: name, the default, ours.
_BOUNDS = (
    ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", str(BATCH_BYTES)),
    ("spark.sql.parquet.columnarReaderBatchSize", "4096", str(READ_ROWS)),
)

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, so that extra columns can't clash; a null text reads as empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _bound_batches(spark: SparkSession) -> None:
    """Whole texts make batches of tens of megabytes by Spark's default; both sides of the pipe keep such buffers."""
    for key, default, bound in _BOUNDS:
        if spark.conf.get(key) == default:  # with a default given, an unset key would read as that
            spark.conf.set(key, bound)


def trim() -> None:
    """Gives what this worker has freed back to the system."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


_kept: list = []


def keep(drop) -> None:
    """Says how this worker drops what it keeps between tasks."""
    _kept.append(drop)


def drop_kept() -> None:
    while _kept:
        _kept.pop()()
    trim()


def _tidy(function, keeps: bool):
    """function, with a trim when a partition ends: workers stay for the next one. Unless it keeps things between tasks
    itself, what an operator before it kept in this worker goes first."""

    def run(batches):
        if not keeps:
            drop_kept()
        yield from function(batches)
        trim()

    return run


def map_arrow(df: DataFrame, function, schema: str, keeps: bool = False) -> DataFrame:
    """mapInArrow, in batches of about BATCH_BYTES unless the session sets its own size."""
    ship(df.sparkSession)
    _bound_batches(df.sparkSession)
    return df.mapInArrow(_tidy(function, keeps), schema)


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share. Only where the cluster names none, as in tests, a local one is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="loomspan-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def settle(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, and a lost executor
    costs only the tasks that read it. The table goes when the application ends."""
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/loomspan/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _sweep() -> None:
    for spark, path in _made:
        try:
            jvm = spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session is gone, and so are its scratch tables' readers
            return
