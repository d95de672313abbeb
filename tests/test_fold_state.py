"""The fold's state: equal to a full fold after each batch, and trusted only while it may be."""

import glob
import os
import shutil

import pytest

from siftline.operators import folds
from siftline.streaming.fold import FoldedLog

SCHEMA = "id long, k string, t long, v string"
BATCHES = [
    [(1, "a", 10, "x"), (2, "b", 11, "y"), (3, "c", 12, "z")],
    [(4, "a", 20, "w"), (5, "a", 5, "late")],
    [(6, "d", 30, "new"), (7, "b", 1, "first")],
]


def index(df):
    return folds.entity_index(df, "k", ["t", "id"], ["v"], "t", "id")


def other_index(df):
    return folds.entity_index(df, "k", ["id"], ["v"], "t", "id")


def rows(df):
    return sorted(tuple(r) for r in df.select("k", "v", "first_seen", "last_seen", "seq", "observations").collect())


@pytest.fixture
def log(spark, tmp_path):
    at = FoldedLog(spark, str(tmp_path), "k", index, buckets=8)
    for n, batch in enumerate(BATCHES):
        at.take(spark.createDataFrame(batch, SCHEMA), n)
        assert rows(at.entities()) == rows(index(spark.createDataFrame(sum(BATCHES[: n + 1], []), SCHEMA)))
    return at


def full(spark, extra=()):
    return rows(index(spark.createDataFrame(sum(BATCHES, []) + list(extra), SCHEMA)))


def test_a_batch_rewrites_its_own_buckets(log, spark):
    head = log.head()
    assert [r.mode for r in sorted(spark.read.parquet(log.folder + "/heads").collect(), key=lambda r: r.generation)] == ["no state", "incremental", "incremental"]
    assert set(head.places.values()) == {0, 1, 2} or len(set(head.places.values())) > 1
    at = {os.path.basename(p) for p in glob.glob(log.folder + "/entities/1/bucket=*")}
    assert len(at) == 1


def test_restart_and_repeated_batch(log, spark):
    again = FoldedLog(spark, log.folder, "k", index, buckets=8)
    again.take(spark.createDataFrame(BATCHES[2], SCHEMA), 2)
    assert rows(again.entities()) == full(spark)
    again.take(spark.createDataFrame([(8, "c", 40, "q")], SCHEMA), 3)
    assert again.head().mode == "incremental" and rows(again.entities()) == full(spark, [(8, "c", 40, "q")])


def test_changed_code_folds_all(log, spark):
    changed = FoldedLog(spark, log.folder, "k", other_index, buckets=8)
    changed.take(spark.createDataFrame([(8, "c", 40, "q")], SCHEMA), 3)
    assert changed.head().mode == "code changed" and set(changed.head().places.values()) == {3}
    assert rows(changed.entities()) == rows(other_index(spark.createDataFrame(sum(BATCHES, []) + [(8, "c", 40, "q")], SCHEMA)))


def test_changed_log_folds_all(log, spark):
    shutil.rmtree(log.folder + "/log/batch=1")
    log.take(spark.createDataFrame([(8, "c", 40, "q")], SCHEMA), 3)
    assert log.head().mode == "log changed"
    assert rows(log.entities()) == rows(index(spark.createDataFrame(BATCHES[0] + BATCHES[2] + [(8, "c", 40, "q")], SCHEMA)))


def test_unfinished_generation_folds_all(log, spark):
    spark.createDataFrame([(3,)], "generation long").write.mode("append").parquet(log.folder + "/begun")
    log.take(spark.createDataFrame([(8, "c", 40, "q")], SCHEMA), 4)
    assert log.head().mode == "a generation did not end" and rows(log.entities()) == full(spark, [(8, "c", 40, "q")])


def test_lost_entities_fold_all(log, spark):
    gone = next(p for p in log.paths(log.head().places))
    bucket = int(gone.rsplit("=", 1)[1])
    key = next(r.k for r in log.entities().withColumn("b", log.bucket()).collect() if r.b == bucket)
    shutil.rmtree(gone)
    log.take(spark.createDataFrame([(8, key, 40, "q")], SCHEMA), 3)
    assert log.head().mode == "entities cannot be read" and rows(log.entities()) == full(spark, [(8, key, 40, "q")])


def test_empty_batch(log, spark):
    log.take(spark.createDataFrame([], SCHEMA), 3)
    assert log.head().mode == "empty" and rows(log.entities()) == full(spark)
