"""A consumer's place in a log: kept in the shared folder, and moved only after what was read has been acted on.

Positions are appended, never replaced, and the place is their maximum: two consumers of one name that advance at once lose
nothing, and no advance goes back. An action that fails leaves the place where it was, so its rows come again.

Defined results: a row without a sequence number is never read; rows of equal number are read together; a batch without rows moves nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POSITION = "name string, seq long"


class Cursor:
    """The place ``name`` in ``folder``; ``seq`` is the log's column of sequence numbers."""

    def __init__(self, spark: SparkSession, folder: str, name: str, seq: str = "seq"):
        self.spark, self.folder, self.name, self.seq = spark, f"{folder}/cursors", name, seq
        spark.createDataFrame([], POSITION).write.mode("ignore").parquet(self.folder)

    def place(self) -> int:
        """The greatest number that was acted on; 0 before the first."""
        kept = self.spark.read.schema(POSITION).parquet(self.folder).where(F.col("name") == self.name)
        return kept.agg(F.max("seq")).first()[0] or 0

    def pending(self, log: DataFrame, upto: int | None = None) -> DataFrame:
        """Rows after the place, up to ``upto`` if that is given; the bounds reach the scan."""
        after = log.where(F.col(self.seq) > self.place())
        return after if upto is None else after.where(F.col(self.seq) <= upto)

    def advance(self, seq: int) -> None:
        self.spark.createDataFrame([(self.name, seq)], POSITION).write.mode("append").parquet(self.folder)

    def consume(self, log: DataFrame, action: Callable[[DataFrame], None], upto: int | None = None) -> int:
        """Acts on what is pending and then moves on; the new place. The end is fixed first, so rows that come meanwhile wait."""
        end = self.pending(log, upto).agg(F.max(self.seq)).first()[0]
        if end is None:
            return self.place()
        action(self.pending(log, end))
        self.advance(end)
        return self.place()
