"""Fetch logs: manifests, their payloads by hash, and the rows in payloads."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = (
    "envelope_schema int, fetch_id string, source string, operation string, request struct<url: string, params: string>, status int, item_count int, "
    "fetched_at string, duration_ms int, payload struct<blob: string, bytes_raw: long, content_type: string>, context struct<company: string, profile: string>, _damaged string"
)

#: Where each source keeps its rows, and its names for them: source -> (path of the array, {field: JSON path}).
SHAPES: Mapping[str, tuple[str, dict[str, str]]] = {
    "greenhouse": ("$.jobs", {"native_id": "$.id", "title": "$.title", "url": "$.absolute_url", "location": "$.location.name", "posted_at": "$.updated_at", "description": "$.content"}),
    "lever": ("$", {"native_id": "$.id", "title": "$.text", "url": "$.hostedUrl", "location": "$.categories.location", "posted_at": "$.createdAt", "description": "$.descriptionPlain"}),
    "ashby": ("$.jobs", {"native_id": "$.id", "title": "$.title", "url": "$.jobUrl", "location": "$.location", "posted_at": "$.publishedAt", "description": "$.descriptionPlain"}),
    "smartrecruiters": ("$.content", {"native_id": "$.id", "title": "$.name", "url": "$.ref", "location": "$.location.city", "posted_at": "$.releasedDate", "description": "$.jobAd"}),
    "workday": ("$.jobPostings", {"native_id": "$.bulletFields[0]", "title": "$.title", "url": "$.externalPath", "location": "$.locationsText", "posted_at": "$.postedOn", "description": "$.jobDescription"}),
    "amazon": ("$.jobs", {"native_id": "$.id_icims", "title": "$.title", "url": "$.job_path", "location": "$.location", "posted_at": "$.posted_date", "description": "$.description"}),
    "arbeitnow": ("$.data", {"native_id": "$.slug", "title": "$.title", "url": "$.url", "location": "$.location", "posted_at": "$.created_at", "description": "$.description"}),
    "jobicy": ("$.jobs", {"native_id": "$.id", "title": "$.jobTitle", "url": "$.url", "location": "$.jobGeo", "posted_at": "$.pubDate", "description": "$.jobDescription"}),
    "remoteok": ("$", {"native_id": "$.id", "title": "$.position", "url": "$.url", "location": "$.location", "posted_at": "$.date", "description": "$.description"}),
    "themuse": ("$.results", {"native_id": "$.id", "title": "$.name", "url": "$.refs.landing_page", "location": "$.locations[0].name", "posted_at": "$.publication_date", "description": "$.contents"}),
    "adzuna": ("$.results", {"native_id": "$.id", "title": "$.title", "url": "$.redirect_url", "location": "$.location.display_name", "posted_at": "$.created", "description": "$.description"}),
}


def read_manifests(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Manifests below a folder, and the files of damaged ones."""
    at = spark.read.schema(MANIFEST).option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json").option("multiLine", True).option("columnNameOfCorruptRecord", "_damaged").json(folder)
    at = at.withColumn("_file", F.col("_metadata.file_path"))
    return at.where("_damaged is null and fetch_id is not null").drop("_damaged"), at.where("_damaged is not null or fetch_id is null").select("_file", "_damaged")


def _plain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contents of files as they were before they were compressed; null where a file is no whole frame."""
    import zstandard

    reader = zstandard.ZstdDecompressor()

    def opened(path: str, content: bytes) -> bytes | None:
        if not path.endswith(".zst"):
            return content
        try:
            return reader.decompressobj().decompress(content)
        except zstandard.ZstdError:
            return None

    for b in batches:
        yield b.assign(content=[opened(p, c) for p, c in zip(b["path"], b["content"])])


def blobs(spark: SparkSession, folder: str) -> DataFrame:
    """hash (the file's name: that of the bytes before they were compressed), content and state (present or corrupt) of stored payloads."""
    at = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content").mapInPandas(_plain, "path string, content binary")
    name = F.regexp_extract(F.col("path"), r"([0-9a-f]{64})[^/]*$", 1)
    whole = F.coalesce(F.sha2("content", 256) == name, F.lit(False))
    return at.select(name.alias("hash"), F.when(whole, F.col("content")).alias("content"), F.when(whole, "present").otherwise("corrupt").alias("state"))


def blob_states(named: DataFrame, found: DataFrame, pruned: DataFrame) -> DataFrame:
    """State of each hash that ``named`` has (column hash): that of its file, pruned if retention took it away, or else not-synced.
    ``found`` has hash and state, ``pruned`` hash."""
    at = named.select("hash").where("hash is not null").distinct()
    states = found.groupBy("hash").agg(F.max("state").alias("state"))  # present, if any copy is
    gone = pruned.select("hash", F.lit(True).alias("gone")).distinct()
    out = at.join(states, "hash", "left").join(gone, "hash", "left")
    return out.select("hash", F.coalesce("state", F.when(F.col("gone"), "pruned"), F.lit("not-synced")).alias("state"))


def new_blobs(payloads: DataFrame, stored: DataFrame, content: str = "content") -> DataFrame:
    """hash and content of payloads that ``stored`` (column hash) does not have, each once: bytes that are known write nothing."""
    at = payloads.where(F.col(content).isNotNull()).select(F.sha2(F.col(content).cast("binary"), 256).alias("hash"), F.col(content).alias("content"))
    return at.join(stored.select("hash"), "hash", "left_anti").groupBy("hash").agg(F.first("content").alias("content"))


def write_blobs(blobs: DataFrame, path: str) -> None:
    """Adds blobs (column hash) to a store whose folders are the first two digits of the hash."""
    blobs.withColumn("_of", F.substring("hash", 1, 2)).write.mode("append").partitionBy("_of").parquet(path)


def missing(manifests: DataFrame, found: DataFrame) -> DataFrame:
    """Payloads that a manifest names and no file has."""
    named = manifests.where("payload is not null").select(F.col("payload.blob").alias("hash"), "fetch_id")
    return named.join(found, "hash", "left_anti")


def parse(payloads: DataFrame, source: str = "source", body: str = "body") -> DataFrame:
    """One row for each posting in a payload (column ``body``, JSON); a payload that does not parse has none. Sources are told
    apart by value, so a payload is parsed once, as a variant."""
    at = payloads.withColumn("_v", F.try_parse_json(body))

    def fields(paths: dict[str, str]) -> Callable[[Column], Column]:
        return lambda item: F.struct(*[F.try_variant_get(item, p, "string").alias(n) for n, p in paths.items()])

    rows = F.array().cast("array<struct<native_id:string,title:string,url:string,location:string,posted_at:string,description:string>>")
    for name, (path, paths) in SHAPES.items():
        items = F.expr(f"try_variant_get(_v, '{path}', 'array<variant>')")
        rows = F.when(F.col(source) == name, F.transform(items, fields(paths))).otherwise(rows)
    out = at.withColumn("_rows", rows).select(*payloads.columns, F.posexplode("_rows").alias("position", "_row")).select(*payloads.columns, "position", "_row.*")
    return out.drop(body)


def write_partitioned(df: DataFrame, path: str, by: str, touched: DataFrame | None = None) -> None:
    """Buckets by a column of plain values; only the buckets in ``df`` are replaced. Buckets that ``touched`` (column ``by``) names and
    that have no row any more lose their folder."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    if touched is not None:
        spark = df.sparkSession
        for r in touched.select(by).distinct().join(df.select(by), by, "left_anti").toLocalIterator():
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{by}={r[0]}")
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def violations(rows: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """(key, rule) for each rule that a row breaks; a rule that is null for a row is broken."""
    broken = F.array(*[F.when(F.coalesce(holds, F.lit(False)), None).otherwise(F.lit(name)) for name, holds in rules.items()])
    return rows.select(key, F.explode(F.array_compact(broken)).alias("rule"))


def imported(rows: DataFrame, key: str, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and (key, rule) of what the others break: one bad row does not stop an import."""
    keep = F.lit(True)
    for holds in rules.values():
        keep = keep & F.coalesce(holds, F.lit(False))
    return rows.where(keep), violations(rows, key, rules)


def read_folders(spark: SparkSession, root: str, schema: str, items: str) -> DataFrame:
    """A row for each entry of the array ``items`` of JSON documents that lie in folders by status (root/status/name/file.json), with
    ``status`` and ``document`` from the folders; a document without entries gives none."""
    at = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return at.select(F.element_at(parts, -3).alias("status"), F.element_at(parts, -2).alias("document"), "*").withColumn("_item", F.explode(items)).drop(items).select("*", "_item.*").drop("_item")


def durable_index(new: DataFrame, old: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The new index with old rows that no build accounts for, but for those that were taken away."""
    return new.unionByName(old.join(new, key, "left_anti").join(gone, key, "left_anti"), allowMissingColumns=True)
