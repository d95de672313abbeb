"""op9: an exact round trip, and the records of each file."""

import base64
import hashlib
import random

import zstandard

from siftline.llm import warc


def expected(rows):
    by = {}
    for page, _, html in rows:
        by.setdefault(html or "", []).append(page)
    out = []
    for page, url, html in rows:
        data = (html or "").encode()
        ids = [p for p in by[html or ""] if p is not None]
        first = min(ids) if len(by[html or ""]) > 1 and ids else None
        refers = None if first is None or page == first else first
        out.append((page, url, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if refers is None else "revisit", refers, None if refers is not None else data))
    return sorted(out, key=str)


def test_round_trip(spark):
    rnd = random.Random(4)
    rows = [(i, f"http://h.example/{i}?a=b c%20é", f"<p>page {rnd.randrange(12)}</p>" * 3) for i in range(60)]
    rows += [(100, None, None), (101, "u", ""), (2**60 + 1, "u\r\nX: y", "\0\r\n\r\nWARC/1.1\r\n" * 5), (None, "n", "only"), (None, "n", "shared"), (7_000, "n", "shared"), (102, "big", "z" * 3_000_000), (103, "x", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [tuple(r[:6]) + (None if r.payload is None else bytes(r.payload),) for r in warc.read_archives(warc.write_archives(df)).collect()]
    assert sorted(got, key=str) == expected(rows)


def test_min_bytes(spark):
    df = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy"), (3, "c", "long enough"), (4, "d", "long enough")], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.archived(df, 5).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}


def test_empty_table_and_equal_smallest_ids(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (2, "c", "x")], "page_id long, url string, html string")
    assert warc.archived(df.limit(0)).count() == 0
    assert sorted((r.page_id, r.record_type) for r in warc.archived(df).collect()) == [(1, "response"), (1, "response"), (2, "revisit")]


def test_a_file_is_a_skippable_dictionary_and_one_frame_for_each_record():
    found = [warc.record(i, "http://a.example/", f"<html>body {i} {'text ' * 50}</html>".encode(), "D", None) for i in range(300)]
    data = warc.archive(found)
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC
    size = int.from_bytes(data[4:8], "little")
    of = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    frames = list(warc.frames(data, 8 + size))
    assert [of.decompress(f) for f in frames] == found and b"".join(frames) == data[8 + size :]
    assert sum(map(len, frames)) < sum(len(zstandard.ZstdCompressor(level=3).compress(x)) for x in found)


def test_files_of_a_lost_attempt_are_not_read(spark):
    df = spark.createDataFrame([(i, "u", f"p{i}") for i in range(9)], "page_id long, url string, html string")
    manifest = warc.write_archives(df)
    one = manifest.first().file.removeprefix("file://")
    with open(one, "rb") as f, open(one.replace(".warc", "-again.warc"), "wb") as g:
        g.write(f.read())
    assert sorted(r.page_id for r in warc.read_archives(manifest).collect()) == list(range(9))
