"""Shared helpers: input tables, intermediate tables in the shared folder, word patterns."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A word is a run of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows, and no more once they have BATCH_BYTES, in this session, where it leaves Spark's own
    bounds: a batch of whole texts has to fit into each Python worker, beside the executor's heap."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(BATCH_ROWS))
        if size not in spark.conf.getAll:
            spark.conf.set(size, str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Where the session names none, one of this machine if the session
    runs on it alone, as in tests."""
    if named := spark.conf.get("spark.checkpoint.dir", ""):
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="siftline-")
    return _LOCAL[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later jobs start from the files, so a lost executor costs only its own tasks."""
    bounded_batches(df.sparkSession)
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """What this Python worker has freed goes back to the machine: the worker stays, idle or with tasks of other operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``f`` over the batches of a task, after which the worker gives back what it held."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def map_frames(df: DataFrame, f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """As ``mapInPandas``, but whole numbers stay whole where a column has nulls, too: large ids are not rounded."""
    out = to_arrow_schema(StructType.fromDDL(schema))
    kinds = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype(), pa.int16(): pd.Int16Dtype(), pa.int8(): pd.Int8Dtype()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in f(b.to_pandas(types_mapper=kinds.get) for b in batches):
            yield pa.RecordBatch.from_pandas(made, schema=out, preserve_index=False)

    return df.mapInArrow(lean(run), schema)


def words(text: Column) -> Column:
    """Words of a text; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def others(df: DataFrame, *names: str) -> list[str]:
    """Columns of ``df`` that none of ``names`` takes the place of."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def held(df: DataFrame, *names: str) -> Column:
    """The other columns as one struct, so that they meet no name of an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in others(df, *names)] or [F.lit(0).alias("none")])


def released(df: DataFrame, *names: str, row: str = "row") -> list[Column]:
    """The columns of a struct that ``held`` made of ``df``."""
    return [F.col(row)[c].alias(c) for c in others(df, *names)]


def in_order(df: DataFrame, *new: str) -> list[str]:
    """Names of ``df`` and then those of ``new`` that it does not have."""
    names = {c.lower() for c in df.columns}
    return [f"`{c}`" for c in df.columns] + [n for n in new if n.lower() not in names]
