"""A fold over an append-only log, kept up to date by Structured Streaming, with state that is trusted only while it can be.

Each micro-batch is appended to the log under its batch number; a batch that comes again overwrites itself. Log and entities lie in
buckets of the key. A batch folds its own keys anew over the whole log of its buckets, so that late rows fall into their place,
where a watermark would drop them; it rewrites its buckets' entities and no others. A head, written last, says for every
bucket which generation holds it and how many rows it has, together with a fingerprint of the fold's code and of the
log's files.

Every doubt is answered by folding everything again: no head, another fingerprint, a log that is not what the head describes, a bucket
with another number of rows, or a generation that was begun after the head and never ended. Doubt costs one slow batch, never a wrong one.
"""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from siftline.operators import folds

HEAD = "generation long, written long, fingerprint string, log string, places map<int,long>, rows map<int,long>, mode string"


def fingerprint(*parts: object) -> str:
    """A digest of functions by their source, and of all else by its repr."""
    text = "\0".join(inspect.getsource(p) if callable(p) else repr(p) for p in parts)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


class FoldedLog:
    """``folder`` holds the log (by batch and bucket), entities (by generation and bucket), begun generations and heads. ``code``: what
    else decides a fold's result, such as functions that ``fold`` calls."""

    def __init__(self, spark: SparkSession, folder: str, key: str, fold: Callable[[DataFrame], DataFrame], buckets: int = 32, code: tuple = ()):
        self.spark, self.folder, self.key, self.fold, self.buckets = spark, folder, key, fold, buckets
        self.fingerprint = fingerprint(fold, key, buckets, *code)
        spark.createDataFrame([], HEAD).write.mode("ignore").parquet(f"{folder}/heads")
        spark.createDataFrame([], "generation long").write.mode("ignore").parquet(f"{folder}/begun")

    def head(self, before: int = 1 << 62) -> Row | None:
        """The newest head; of a batch that was taken in again, the one written last."""
        return self.spark.read.schema(HEAD).parquet(f"{self.folder}/heads").where(F.col("generation") < before).orderBy(F.desc("generation"), F.desc("written")).first()

    def log_files(self, before: int) -> str:
        """A digest of the log's files of earlier batches: their names, sizes and times, not their contents."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{self.folder}/log")
        at = files.select(F.regexp_extract("path", r"batch=([0-9]+)/.*", 1).cast("long").alias("batch"), F.xxhash64(F.regexp_extract("path", r"batch=.*", 0), "length", "modificationTime").alias("h"))
        n, total = at.where(F.col("batch") < before).agg(F.count("*"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
        return f"{n}:{total}"

    def doubt(self, number: int) -> str:
        """Why the state before batch ``number`` is not to be used; empty if it is."""
        head = self.head(number)
        if head is None:
            return "no state"
        if head.fingerprint != self.fingerprint:
            return "code changed"
        begun = self.spark.read.schema("generation long").parquet(f"{self.folder}/begun")
        if not begun.where((F.col("generation") > head.generation) & (F.col("generation") < number)).isEmpty():
            return "a generation did not end"
        if head.log != self.log_files(number):
            return "log changed"
        return ""

    def paths(self, places: dict[int, int]) -> list[str]:
        return [f"{self.folder}/entities/{generation}/bucket={bucket}" for bucket, generation in sorted(places.items())]

    def held(self, head: Row, buckets: list[int]) -> DataFrame | None:
        """Entities of some buckets; None if there are none, ValueError if a bucket has not the rows that the head states."""
        places = {b: head.places[b] for b in buckets if b in head.places}
        if not places:
            return None
        try:
            at = self.spark.read.parquet(*self.paths(places))
            found = at.count()
        except Exception as e:  # a folder that is gone or not to be read
            raise ValueError("entities cannot be read") from e
        if found != sum(head.rows[b] for b in places):
            raise ValueError("entities changed")
        return at

    def log(self, before: int, buckets: list[int] | None = None) -> DataFrame:
        """Rows of earlier batches, of some buckets or all: files of others are not opened."""
        rows = self.spark.read.option("basePath", f"{self.folder}/log").parquet(f"{self.folder}/log").where(F.col("batch") < before)
        return (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).drop("batch", "bucket")

    def entities(self) -> DataFrame:
        """What the newest head holds."""
        return self.spark.read.parquet(*self.paths(self.head().places))

    def bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def take(self, batch: DataFrame, number: int) -> None:
        self.spark.createDataFrame([(number,)], "generation long").write.mode("append").parquet(f"{self.folder}/begun")
        batch.withColumn("bucket", self.bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/log/batch={number}")
        if batch.isEmpty() and self.head() is not None:
            return self.end(number, self.head(number), {}, "empty")
        touched = [r[0] for r in self.log_of(number).select("bucket").distinct().collect()]  # at most ``buckets``
        mode, head = self.doubt(number), self.head(number)
        try:
            old = None if mode else self.held(head, touched)
        except ValueError as e:
            mode = str(e)
        if mode:
            head, made = None, self.fold(self.log(number + 1))
        elif old is None:
            made = self.fold(self.log(number + 1, touched))
        else:
            delta = self.log_of(number).drop("bucket")
            made = folds.incremental(old, self.log(number, touched), delta, self.key, self.fold)
        made.withColumn("bucket", self.bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/entities/{number}")
        rows = self.spark.read.parquet(f"{self.folder}/entities/{number}").groupBy("bucket").count()
        self.end(number, head, {r[0]: r[1] for r in rows.collect()}, mode or "incremental")

    def log_of(self, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/log/batch={number}")

    def end(self, number: int, head: Row | None, rows: dict[int, int], mode: str) -> None:
        """The head of this generation: its own buckets, and the others where they were."""
        places = (head.places if head else {}) | {b: number for b in rows}
        counts = (head.rows if head else {}) | rows
        written = self.spark.read.schema(HEAD).parquet(f"{self.folder}/heads").count()
        self.spark.createDataFrame([(number, written, self.fingerprint, self.log_files(number + 1), places, counts, mode)], HEAD).write.mode("append").parquet(f"{self.folder}/heads")

    def run(self, source: DataFrame) -> None:
        """Takes in what there is now, and ends."""
        out = source.writeStream.foreachBatch(self.take).option("checkpointLocation", f"{self.folder}/checkpoint")
        out.trigger(availableNow=True).start().awaitTermination()
