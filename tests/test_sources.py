"""Sources and sinks on small files."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from siftline.sources import jsonl, manifests


def test_strict_index_and_repair(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"_schema": "x.v1"}\n{"k": 1}\n{"k": 2}\n{"k": 3')
    at = f"file://{tmp_path}/a.jsonl"
    assert sorted(r.k for r in jsonl.read_index(spark, at, "k int")[0].collect()) == [1, 2]
    assert len(jsonl.read_strict(spark, at, "k int").collect()) == 3
    assert len(jsonl.repaired(spark, at).collect()) == 3
    (tmp_path / "b.jsonl").write_text('{"k": 4}\nnot json\n')
    with pytest.raises(Exception, match="damaged line"):
        jsonl.read_strict(spark, f"file://{tmp_path}/b.jsonl", "k int").collect()


def test_lines_that_are_no_rows_are_damaged(spark, tmp_path):
    lines = ['{"k": 1}', "3", "[1]", '[{"k": 5}]', '{"k": "x"}', '{"k": 2.5}', "null", '"k"', '{"k": null}', "{}", ' {"k": 7, "other": []}', "", "   ", '{"k": 1} trailing', '{"k": 1},{"k": 2}', '{"k": 9}\r']
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n", newline="")
    rows, damaged = jsonl.read(spark, f"file://{tmp_path}/a.jsonl", "k int")
    assert sorted((r.k for r in rows.collect()), key=str) == sorted([1, None, None, 7, 9], key=str)
    assert {r.line for r in damaged.collect()} == {"3", "[1]", '[{"k": 5}]', '{"k": "x"}', '{"k": 2.5}', "null", '"k"', '{"k": 1} trailing', '{"k": 1},{"k": 2}'}
    with pytest.raises(Exception, match="damaged line"):
        jsonl.read_strict(spark, f"file://{tmp_path}/a.jsonl", "k int").collect()


def test_large_logs_are_read_in_splits(spark, tmp_path):
    n = 200_000
    for name, tail in (("torn", '{"k": 999999999, "t": "cut'), ("complete", '{"k": -1}'), ("ended", '{"k": -2}\n'), ("empty", "")):
        with open(tmp_path / f"{name}.jsonl", "w") as f:
            f.writelines('{"k": %d, "t": "Zürich"}\n' % k for k in range(n if name == "torn" else 10 if name != "empty" else 0))
            f.write(tail)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300k")
    try:
        rows, damaged = jsonl.read(spark, f"file://{tmp_path}/*.jsonl", "k long")
        assert rows.rdd.getNumPartitions() > 15
        assert rows.count() == n + 21 and damaged.count() == 0
        assert rows.where("k < 0").count() == 1  # a last line without an end is left out, whole or not
        assert rows.agg(F.max("k")).first()[0] == n - 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_canonical_at_all_depths(spark):
    df = spark.sql("select named_struct('b', 1, 'a', array(named_struct('z', null, 'y', map('q', 2, 'p', 1)))) as x, cast(null as struct<b:int,a:int>) as w")
    assert jsonl.canonical(df).first().value == '{"w":null,"x":{"a":[{"y":{"p":1,"q":2},"z":null}],"b":1}}'
    with pytest.raises(Exception, match="JSON number"):
        jsonl.canonical(spark.sql("select double('NaN') as x")).collect()


def test_manifests_and_blobs(spark, tmp_path):
    import zstandard

    names = {}
    os.makedirs(tmp_path / "blobs")
    for k, data in enumerate((b"one", b"two", b"three")):
        names[k] = hashlib.sha256(data).hexdigest()
        stored = zstandard.ZstdCompressor().compress(data) if k < 2 else b"torn"
        (tmp_path / "blobs" / f"{names[k]}.zst").write_bytes(stored)
    found = manifests.blobs(spark, f"file://{tmp_path}/blobs")
    assert {r.hash: (r.state, r.content and bytes(r.content)) for r in found.collect()} == {names[0]: ("present", b"one"), names[1]: ("present", b"two"), names[2]: ("corrupt", None)}
    for k, text in {"f1": json.dumps({"fetch_id": "f1", "source": "s", "payload": {"blob": names[0]}}), "f2": json.dumps({"fetch_id": "f2", "payload": {"blob": "0" * 64}}), "f3": '{"fetch_id": '}.items():
        os.makedirs(tmp_path / "raw" / k)
        (tmp_path / "raw" / k / "manifest.json").write_text(text)
    good, bad = manifests.read_manifests(spark, f"file://{tmp_path}/raw")
    assert sorted(r.fetch_id for r in good.collect()) == ["f1", "f2"]
    assert [r._file.split("/")[-2] for r in bad.collect()] == ["f3"]
    assert [r.fetch_id for r in manifests.missing(good, found).collect()] == ["f2"]
    named = good.select(F.col("payload.blob").alias("hash"))
    nothing = spark.createDataFrame([], "hash string")
    assert {r.hash[:4]: r.state for r in manifests.blob_states(named, found, nothing).collect()} == {names[0][:4]: "present", "0000": "not-synced"}
    gone = spark.createDataFrame([("0" * 64,)], "hash string")
    assert {r.hash[:4]: r.state for r in manifests.blob_states(named, found, gone).collect()} == {names[0][:4]: "present", "0000": "pruned"}


@pytest.mark.parametrize("source", sorted(manifests.SHAPES))
def test_payload_shapes(spark, source):
    path, fields = manifests.SHAPES[source]

    def put(into, at, value):
        *steps, last = at.removeprefix("$.").replace("[0]", ".0").split(".")
        for k, s in enumerate(steps):
            follow = steps[k + 1] if k + 1 < len(steps) else last
            into = into[0] if s == "0" else into.setdefault(s, [{}] if follow == "0" else {})
        if last == "0":
            into[0] = value
        else:
            into[last] = value

    item = {}
    for name, at in fields.items():
        put(item, at, f"the {name}")
    body = json.dumps([item, {}] if path == "$" else {path.removeprefix("$."): [item, {}]})
    df = spark.createDataFrame([(source, body), (source, body[:-2]), (source, "[]"), (source, "3"), (source, None), ("unknown", body)], "source string, body string")
    got = sorted(manifests.parse(df).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == [0, 1]
    assert {n: got[0][n] for n in fields} == {n: f"the {n}" for n in fields}
    assert all(got[1][n] is None for n in fields)


def test_folders_by_status(spark, tmp_path):
    for status, name, jobs in (("1_open", "acme", [{"role": "a"}, {"role": "b"}]), ("2_done", "beta", [{"role": "c"}]), ("2_done", "none", [])):
        os.makedirs(tmp_path / status / name)
        (tmp_path / status / name / "meta.json").write_text(json.dumps({"company": name, "jobs": jobs}))
    got = manifests.read_folders(spark, f"file://{tmp_path}", "company string, jobs array<struct<role string>>", "jobs")
    assert sorted((r.status, r.document, r.company, r.role) for r in got.collect()) == [("1_open", "acme", "acme", "a"), ("1_open", "acme", "acme", "b"), ("2_done", "beta", "beta", "c")]
