"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that separates words: space and the ASCII controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"

#: A table is broadcast only if its counted rows times their width stay below this.
BROADCAST_BYTES = 32 << 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and bind it inside ``body``.

    A lambda that mentions a column expression has it evaluated again for every
    element; a lambda variable is evaluated once.
    """
    return F.transform(F.array(value), body)[0]


def text_of(df: DataFrame, name: str = "text") -> Column:
    return F.coalesce(column(df, name).cast("string"), F.lit(""))


def column(df: DataFrame, name: str) -> Column:
    """A column by its whole name, whatever signs the name holds."""
    return df[f"`{name.replace('`', '``')}`"]


def columns(df: DataFrame, names: list[str] | None = None) -> list[Column]:
    return [column(df, c) for c in (df.columns if names is None else names)]


def free(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns, lengthened until ``df`` has none like them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def veiled(df: DataFrame, *plain: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with neutral names for all columns but ``plain``, and what gives a result of those rows its old columns back.

    For callers that want rows chosen by an operator, but not its columns.
    """
    names = [c if c in plain else f"c{i}" for i, c in enumerate(df.columns)]
    return df.toDF(*names), lambda out: out.select(*names).toDF(*df.columns)


def _release() -> None:
    """What a worker has freed goes back to the system: it would keep it while it waits for its next task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.pythonapi, "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def _released(function):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            _release()

    return run


def mapped(rows: DataFrame, function, *added: T.StructField) -> DataFrame:
    """``rows`` without their last column, and the columns that ``function`` of Arrow batches puts there.

    Columns travel under names of their place: a map over batches can't resolve names with dots.
    """
    names = rows.columns[:-1]
    safe = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])
    out = safe.mapInArrow(_released(function), T.StructType([*safe.schema.fields[:-1], *added]))
    return out.toDF(*names, *[f.name for f in added])


def words_of(text: Column) -> Column:
    """The words of a text: maximal runs of anything but white space."""
    return F.array_remove(F.split(text, SPACE), "")


def shared_dir(spark: SparkSession) -> str:
    """A folder below spark.checkpoint.dir, which driver and executors share.

    Where the setting is missing (tests on one machine), one is made up.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="driftmark-")
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(shutil.rmtree, root[7:], ignore_errors=True)
    return f"{root.rstrip('/')}/driftmark/{sc.applicationId}"


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


_SCOPES: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables written inside go at the end, but for those to ``keep``, which the scope around it takes over."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield
    finally:
        _SCOPES.remove(paths)
        for path in paths:
            drop_path(spark, path)


def written(df: DataFrame, what: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    Outside of any ``scope`` a table stays until its folder, named after the application, is removed.
    """
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    scopes = _SCOPES[:-1] if keep else _SCOPES
    if scopes:
        scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
