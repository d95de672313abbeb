"""A consumer's place across restarts, failures and repeats."""

import pytest

from siftline.streaming.cursor import Cursor


def test_moves_only_after_the_action(spark, tmp_path):
    log = spark.createDataFrame([(k, f"r{k}") for k in (1, 2, 2, 5, 9)] + [(None, "none")], "seq long, row string")
    got = []
    at = Cursor(spark, f"file://{tmp_path}", "mail")

    def act(rows):
        got.append(sorted(r.row for r in rows.collect()))

    def fail(rows):
        act(rows)
        raise RuntimeError("the action failed")

    assert at.place() == 0 and at.consume(log, act, upto=2) == 2
    with pytest.raises(RuntimeError):
        at.consume(log, fail)
    again = Cursor(spark, f"file://{tmp_path}", "mail")
    assert again.place() == 2 and again.consume(log, act) == 9 and again.consume(log, act) == 9
    assert got == [["r1", "r2", "r2"], ["r5", "r9"], ["r5", "r9"]]
    again.advance(4)  # a slower consumer
    assert again.place() == 9 and Cursor(spark, f"file://{tmp_path}", "other").place() == 0


def test_empty_log(spark, tmp_path):
    at = Cursor(spark, f"file://{tmp_path}", "mail")
    assert at.consume(spark.createDataFrame([], "seq long, row string"), lambda rows: pytest.fail("nothing to act on")) == 0
