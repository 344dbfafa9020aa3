"""Tables and files in the folder that driver and executors share.

The folder is ``spark.checkpoint.dir`` of the session.  Only where that is
unset in a local session (tests, a laptop) a folder below ``/tmp/checkpoints``
takes its place; on a cluster that is an error.
Intermediate tables are written there rather than cached, so a lost executor
costs a reread and never a recomputation of the lineage.  `dropped` deletes
those that no later step reads.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of an Arrow batch between Spark and Python, on both sides of the pipe.
BATCH_BYTES = "4m"
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
DEFAULT_DIR = "file:///tmp/checkpoints/keyfold"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, as the session names it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    return (folder or DEFAULT_DIR).rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other call uses."""
    return f"{shared_dir(spark)}/keyfold-{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, lean: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.  If lean,
    the shuffle files of the write go when it ends, not when the driver's
    garbage collector happens to find that nothing refers to them."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, str(lean or before == "true").lower())
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def unused(name: str, columns: list[str]) -> str:
    """A name like this that none of the columns has, whatever their case."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def refuse(columns: list[str], *results: str) -> None:
    """An error if a table has columns of the result already."""
    clash = sorted({c.lower() for c in columns} & set(results))
    if clash:
        raise ValueError(f"the table has columns of the result: {clash}")


def dropped(*tables: DataFrame) -> None:
    """Delete tables that materialise wrote.  Only for those that nothing
    reads any more, results not yet computed included."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/keyfold-" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def arrow_schema(schema: str | T.StructType) -> pa.Schema:
    """Arrow form of a Spark schema, for functions given to mapInArrow."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    return to_arrow_schema(schema)


def trim() -> None:
    """Give memory that isn't used back to the system: a worker that waits for
    its next task, or a driver that has fitted a model, shouldn't hold what the largest batch so far took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries do without
        pass


def _lean(fn: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, out in enumerate(fn(batches)):
            yield out
            del out
            if k % 8 == 7:
                trim()
        trim()

    return run


def mapped(df: DataFrame, fn: Callable, schema: str | T.StructType) -> DataFrame:
    """mapInArrow with batches of bounded bytes, so that memory doesn't depend
    on the length of the texts in ten thousand rows.  (The bound is a setting
    of the session, read when the plan runs.)"""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(_lean(fn), schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
