"""The incremental fold as a stream, run over the event table in micro-batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators import folds
from siftline.plans.queries import EV, INDEX_SQL, index_of, seconds
from siftline.shared import shared_dir
from siftline.streaming.cursor import Cursor
from siftline.streaming.fold import FoldedLog


def stream_fold(spark: SparkSession, d: str) -> DataFrame:
    """entity_index by foreachBatch over a source that comes in several batches, each with rows that are late for what the
    batches before it brought: a batch refolds the keys it touches."""
    folder = f"{shared_dir(spark)}/fold-{uuid.uuid4().hex}"
    at = F.date_trunc("second", F.col("ts").cast("timestamp"))
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type", "value", seconds(at).alias("t"))
    events.withColumn("part", F.col("event_id") % 3).write.partitionBy("part").parquet(f"{folder}/source")
    log = FoldedLog(spark, folder, "user_id", index_of, code=(folds.entity_index,))
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 8).parquet(f"{folder}/source/part=*")
    log.run(source)
    return log.entities()


def consumer_cursor(spark: SparkSession, d: str) -> DataFrame:
    """The event log read in three turns by a consumer whose second turn fails after it has written: what it wrote comes again."""
    folder = f"{shared_dir(spark)}/cursor-{uuid.uuid4().hex}"
    log = spark.read.parquet(f"{d}/events.parquet").select((F.col("event_id") + 1).alias("seq"), "user_id")
    last = log.agg(F.max("seq")).first()[0] or 0
    cursor = Cursor(spark, folder, "reader")

    def write(turn: int, fails: bool = False):
        def act(rows: DataFrame) -> None:
            rows.withColumn("turn", F.lit(turn)).write.mode("append").parquet(f"{folder}/seen")
            if fails:
                raise RuntimeError("after the write")

        return act

    spark.createDataFrame([], "seq long, user_id long, turn int").write.parquet(f"{folder}/seen")
    cursor.consume(log, write(1), upto=last // 3)
    try:
        cursor.consume(log, write(2, fails=True), upto=last // 2)
    except RuntimeError:
        pass
    cursor.consume(log, write(3))
    return spark.read.parquet(f"{folder}/seen")


CURSOR_SQL = """WITH e AS (SELECT event_id + 1 AS seq, user_id, (SELECT max(event_id) + 1 FROM events) AS n FROM events)
SELECT seq, user_id, 1 AS turn FROM e WHERE seq <= n // 3 UNION ALL SELECT seq, user_id, 2 FROM e WHERE seq > n // 3 AND seq <= n // 2 UNION ALL SELECT seq, user_id, 3 FROM e WHERE seq > n // 3"""
STREAMS = {"stream_fold": stream_fold, "consumer_cursor": consumer_cursor}
ORACLE = {"stream_fold": INDEX_SQL.format(EV), "consumer_cursor": CURSOR_SQL}
