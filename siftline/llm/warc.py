"""WARC archives of individually compressed records with a shared Zstandard dictionary.

A file begins with a skippable frame that holds the dictionary, then each record is one frame compressed with it. The
dictionary of a file is built from its own first records, up to DICTIONARY_FROM bytes of them. Each attempt of a task
writes files of its own names; the manifest, which Spark commits once for each task, lists those that count, and
only these are read back. Files of lost attempts stay unread.

Records of equal payloads of at least ``min_bytes`` bytes: that with the smallest page_id is a response, the others
are revisits that name it and keep digest and length, but no payload. The first of a payload is found by a grouped
minimum over digests; pages meet only the groups of more than one, and a very common payload is a skewed join that
Spark splits.

Defined results: a null html is an empty payload; a null url leaves the header out and is null again when read;
rows that share the smallest page_id are all responses; a null page_id is a response unless an equal payload
has an id; an empty table gives no archives and an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import map_frames, new_path, stored

DICTIONARY_MAGIC = 0x184D2A5D
DICTIONARY_BYTES = 1 << 16
DICTIONARY_FROM = 4 << 20
FILE_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
PAGE = "urn:page:"


def name_of(page_id) -> str:
    return f"<{PAGE}{'null' if pd.isna(page_id) else int(page_id)}>"


def id_of(name: str) -> int | None:
    v = name.strip("<>").removeprefix(PAGE)
    return None if v == "null" else int(v)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = not pd.isna(refers_to)
    block = http if revisit else http + payload
    fields = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name_of(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        fields.append(f"WARC-Target-URI: {quote(url, safe=SAFE)}")
    if revisit:
        fields += [f"WARC-Refers-To: {name_of(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    fields += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: Characters of a URL that stay; a space, a line break or a percent sign would not come back as it was.
SAFE = ":/?#[]@!$&'()*+,;=-._~"


def parsed(data: bytes) -> dict:
    """The fields of a record in small letters, and its http header and payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    fields["http"], _, fields["payload"] = block.partition(b"\r\n\r\n")
    return fields


def dictionary(records: list[bytes]) -> bytes:
    """A dictionary from records; too few or too short ones give their own beginning as a raw one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records, k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(records)[:DICTIONARY_BYTES]


def archive(records: list[bytes]) -> bytes:
    first, size = [], 0
    for r in records:
        first.append(r)
        size += len(r)
        if size >= DICTIONARY_FROM:
            break
    made = dictionary(first)
    to = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(made), write_content_size=True)
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(made)), made, *map(to.compress, records)])


def frames(data: bytes, at: int) -> Iterator[bytes]:
    """The frames from ``at`` on, by their block headers."""
    while at < len(data):
        begin = at
        if data[at : at + 4] != b"\x28\xb5\x2f\xfd":
            raise ValueError("no Zstandard frame")
        flags = data[at + 4]
        single = flags >> 5 & 1
        at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
        last = 0
        while not last:
            head = int.from_bytes(data[at : at + 3], "little")
            last = head & 1
            at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        at += 4 * (flags >> 2 & 1)
        yield data[begin:at]


def records(data: bytes) -> Iterator[bytes]:
    magic, size = struct.unpack("<II", data[:8])
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary")
    of = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    for f in frames(data, 8 + size):
        yield of.decompress(f)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _written(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        at = TaskContext.get()
        store, path = fs.FileSystem.from_uri(folder)
        held: list[bytes] = []
        size, files = 0, 0

        def close() -> pd.DataFrame:
            nonlocal held, size, files
            name = f"{at.partitionId():06d}-{at.taskAttemptId()}-{files:04d}.warc.zst"
            with store.open_output_stream(f"{path}/{name}", compression=None) as f:
                f.write(archive(held))
            n, held, size, files = len(held), [], 0, files + 1
            return pd.DataFrame({"file": [f"{folder}/{name}"], "records": [n]})

        for b in batches:
            for page, url, payload, refers in zip(b["page_id"], b["url"], b["payload"], b["refers_to"]):
                payload = bytes(payload)
                held.append(record(page, url, payload, base32(hashlib.sha1(payload).digest()), refers))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    yield close()
        if held:
            yield close()

    return run


def write_archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The manifest: files of the archives and their numbers of records."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    long_enough = F.octet_length("payload") >= min_bytes
    shared = rows.where(long_enough).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    refers = F.when(long_enough & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = rows.join(shared, "digest", "left").select("page_id", "url", "payload", refers.alias("refers_to"))
    folder = new_path(pages.sparkSession, "archives")
    folder = folder.removeprefix("file:") if folder.startswith("file:/") and not folder.startswith("file://") else folder
    uri = folder if "://" in folder else f"file://{folder}"
    spark = pages.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(uri)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    return stored(map_frames(rows, _written(uri), "file string, records long"), "manifest")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from urllib.parse import unquote

    from pyarrow import fs

    for file in (f for b in batches for f in b["file"]):
        store, path = fs.FileSystem.from_uri(file)
        with store.open_input_stream(path, compression=None) as f:
            data = f.read()
        out = []
        for r in map(parsed, records(data)):
            revisit = r["warc-type"] == "revisit"
            if revisit:
                size = int(r["http"].rsplit(b"Content-Length: ", 1)[1])
                digest, payload = r["warc-payload-digest"].removeprefix("sha1:"), None
            else:
                payload = r["payload"]
                size, digest = len(payload), base32(hashlib.sha1(payload).digest())
                if f"sha1:{digest}" != r["warc-payload-digest"]:
                    raise ValueError(f"{r['warc-record-id']}: the payload does not have its digest")
            url = unquote(r["warc-target-uri"]) if "warc-target-uri" in r else None
            out.append((id_of(r["warc-record-id"]), url, size, digest, r["warc-type"], id_of(r["warc-refers-to"]) if revisit else None, payload))
            if len(out) == 500:
                yield _frame(out)
                out = []
        if out:
            yield _frame(out)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    return pd.DataFrame(rows, columns=names, dtype=object)


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of the archives that a manifest lists; revisits have no payload. Files are dealt out by name."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_frames(manifest.select("file").repartition(n, "file"), _read, RECORD)


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages written and read back."""
    return read_archives(write_archives(pages, min_bytes)).drop("payload", "url")
