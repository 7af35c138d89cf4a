"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: ASCII white space: \x20 and \x09-\x0D.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Only where the session names none (tests on one machine) a temporary folder
    is made and set, and removed when the driver ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = _OWN.get("dir")
    if not own:
        own = _OWN["dir"] = tempfile.mkdtemp(prefix="quarry-shared-")
        atexit.register(shutil.rmtree, own, True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


_OWN: dict[str, str] = {}


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/quarry/{kind}-{uuid.uuid4().hex}"


#: Spark's setting by which the shuffle files of a finished action go.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def dropping_shuffles(spark: SparkSession):
    """Within, an action's shuffle files go when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)


def written(df: DataFrame, kind: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back."""
    path = fresh_path(df.sparkSession, kind)
    with dropping_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that ``written`` returned and that nothing reads any more."""
    own = f"{shared_dir(spark)}/quarry/".split(":")[-1].lstrip("/")
    for folder in {unquote(x).rpartition("/")[0] for each in tables for x in each.inputFiles()}:
        if own not in folder:
            raise ValueError(f"{folder} is not a table that written() made")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Bytes of texts that a Python worker handles together; a longer text stands alone.
STEP = 4 << 20


def steps(batches, column: int, most: int = STEP):
    """The rows of Arrow batches in batches whose texts, in that column, have about ``most`` bytes in all."""
    held, size = [], 0
    for batch in batches:
        lengths = pc.binary_length(batch.column(column).cast(pa.binary())).fill_null(0).to_pylist()
        at = 0
        for k, n in enumerate(lengths):
            if size and size + n > most:
                yield pa.concat_batches([*held, batch.slice(at, k - at)])
                held, size, at = [], 0, k
            size += n
        held.append(batch.slice(at))
    if held:
        yield pa.concat_batches(held)
    del held[:]
    pa.default_memory_pool().release_unused()  # the worker may stand idle from here on


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """Bind value once and use it many times in body, inside one expression.

    A lambda variable is read, never recomputed, whatever the optimizer inlines.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
