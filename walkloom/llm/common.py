"""Helpers that the operators of this package share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that part words.
BLANKS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where that is unset, a new one on a single machine (tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: a cluster needs a folder that the driver and all executors see")
        found = "file://" + tempfile.mkdtemp(prefix="walkloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Rows in an Arrow batch at most: a batch of whole texts is held by the JVM and by Python.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: The setting of the batches is the session's, so threads write one after another.
_writing = threading.RLock()
#: id of a table -> a weak reference to it, and its path; and the paths written in each open scope.
_path: dict[int, tuple] = {}
_scopes: list[list[str]] = []


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors, and gives later plans its true size. It is deleted by discard(), with its scope, or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/walkloom/{tag}-{uuid.uuid4().hex}"
    with _writing:
        before = spark.conf.get(_BATCH)
        spark.conf.set(_BATCH, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
        try:
            df.write.parquet(path)
        finally:
            spark.conf.set(_BATCH, before)
    out = spark.read.schema(df.schema).parquet(path)
    _path[id(out)] = (weakref.ref(out), path)
    _written[path] = spark
    for s in _scopes:
        s.append(path)
    return out


#: path -> session of the tables that are there.
_written: dict[str, SparkSession] = {}


def _delete(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for t in tables:
        found, path = _path.pop(id(t), (None, None))
        if found is not None and found() is t:
            _delete(path)


@contextlib.contextmanager
def scope():
    """Tables written within are deleted at its end, but for those that keep() was given: scope() gives keep."""
    own: list[str] = []
    kept: set[str] = set()

    def keep(t: DataFrame) -> DataFrame:
        kept.add(_path[id(t)][1])
        return t

    _scopes.append(own)
    try:
        yield keep
    finally:
        _scopes[:] = [s for s in _scopes if s is not own]
        for path in own:
            if path not in kept:
                _delete(path)


@atexit.register
def _at_exit() -> None:
    """What is still there goes when the driver ends, if its session does that in order."""
    for path, spark in list(_written.items()):
        try:
            if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
                continue
            _delete(path)
        except Exception:  # noqa: BLE001 the JVM is gone: nothing can be deleted through it
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The runs of characters that aren't blanks; null text has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS)), " "), "")


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, mod n; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def pieces(batches, rows: int = 1000):
    """Arrow batches in slices, so that what is made of one at a time stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
