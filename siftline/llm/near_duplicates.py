"""Near-duplicates by a multi-index Hamming join over b-bit MinHash signatures, confirmed on full shingle sets.

A signature has CHUNKS * WIDTH symbols of b = 16 bits. Two sets of Jaccard similarity s agree in each symbol
with probability s, so at s = 0.8 the distance (symbols that differ) is binomial(130, 0.2): over LIMIT = 51
with a chance of about 1e-7. Pigeonhole: among 26 chunks, 51 = 2 * 26 - 1 errors leave one chunk with at most
one. Each chunk is therefore entered WIDTH times, once without each of its symbols: two chunks with at most one
error share such an entry. So every pair within LIMIT meets in a bucket, whatever the data.

Equal sets are one class from the start. In a bucket, links are first sought to one member, that which shares most buckets
(the middle of a group of near copies); what shares a component needs no more checks, and buckets of one component go
away. The pairs of what is left are not listed by bucket but by prefix: with the shingles of each set in one order, the
rarest first, two sets of similarity 0.8 share one among the first fifth of each, at places i and j from which on enough
shingles are left in both. So a shingle that stands near the front of two sets of different components makes a pair, which
counts if its signatures are within LIMIT (they are if, and only if, the bucket join may find it). Sets whose rare part is too
large to be similar to anything meet nobody, however many share a template or passage with them. No link between different
components is missed, and no group has all its pairs listed. Every link is confirmed on full sets:
100 * |A and B| >= 80 * |A or B|.

Defined results: null, empty and blank texts have no shingles, are linked with nothing and kept; a text with
fewer words than a shingle is one shingle; a row with a null id is returned unlinked and kept; rows of one id
count as one document; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .components import components
from .tables import lean, map_frames, stored

CHUNKS, WIDTH = 26, 5
SYMBOLS = CHUNKS * WIDTH
LIMIT = 2 * CHUNKS - 1
ROUNDS, TRIES = 2, 2
BLOCK = 4096


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = max(1, len(h) - size + 1)
    x = np.full(n, len(h) if len(h) < size else size, np.uint64)
    for k in range(min(size, len(h))):
        x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(x)


_MUL = (_odd(SYMBOLS, 11) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADD = (_odd(SYMBOLS, 12) >> np.uint64(32)).astype(np.uint32)


def signature(hashes: np.ndarray) -> np.ndarray:
    """SYMBOLS 16-bit symbols."""
    low = np.full(SYMBOLS, 0xFFFFFFFF, np.uint32)
    x = (hashes >> np.uint64(20)).astype(np.uint32)
    for k in range(0, len(x), BLOCK):
        low = np.minimum(low, (x[k : k + BLOCK, None] * _MUL + _ADD).min(axis=0))
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """For each signature (row), its SYMBOLS bucket keys: each chunk without each of its symbols."""
    chunks = signatures.reshape(len(signatures), CHUNKS, WIDTH).astype(np.uint64)
    salts, out = _odd(SYMBOLS, 13).reshape(CHUNKS, WIDTH), []
    for gone in range(WIDTH):
        packed = np.zeros(chunks.shape[:2], np.uint64)
        for k in range(WIDTH):
            if k != gone:
                packed = (packed << np.uint64(16)) | chunks[:, :, k]
        out.append(_mix(packed ^ salts[:, gone]))
    return np.concatenate(out, axis=1).view(np.int64)


def _signed(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingle_hashes(t, size) for t in b["text"]]
            yield pd.DataFrame({
                "doc_id": b["doc_id"],
                "n_shingles": [len(s) for s in sets],
                "class": [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets],
                "sig": [signature(s).tobytes() if len(s) else None for s in sets],
            })

    return run


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for at in range(0, len(b), 1000):
            part = b.iloc[at : at + 1000]
            keys = chunk_keys(np.frombuffer(b"".join(part["sig"]), np.uint16).reshape(len(part), SYMBOLS))
            yield pd.DataFrame({"key": keys.ravel(), "id": np.repeat(part["id"].to_numpy(), SYMBOLS), "n": np.repeat(part["n"].to_numpy(), SYMBOLS)})


def _shingles(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc, t in zip(b["doc_id"], b["text"]):
                h = shingle_hashes(t, size)
                own = xxhash.xxh3_64_intdigest(h.tobytes(), doc & (2**64 - 1))
                yield pd.DataFrame({"set": np.full(len(h), own, np.uint64).view(np.int64), "id": np.full(len(h), doc, np.int64), "n": np.full(len(h), len(h), np.int64), "h": h.view(np.int64)})

    return run


def _sets(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["doc_id"], "s": [shingle_hashes(t, size).view(np.int64) for t in b["text"]]})

    return run


@F.pandas_udf(IntegerType())
def distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Symbols in which two signatures differ."""
    x, y = (np.frombuffer(b"".join(v), np.uint16).reshape(-1, SYMBOLS) for v in (a, b))
    return pd.Series((x != y).sum(axis=1).astype(np.int32))


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough. Only texts named in a pair are moved."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInPandas(lean(_sets(size)), "id long, s array<long>")
    both = F.size(F.array_intersect("s", "t"))
    of_a, of_b = sets.select(F.col("id").alias("a"), "s"), sets.select(F.col("id").alias("b"), F.col("s").alias("t"))
    return pairs.join(of_a, "a").join(of_b, "b").where(100 * both >= percent * (F.size("s") + F.size("t") - both)).select("a", "b")


def prefix_pairs(docs: DataFrame, own: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of ``own`` (id, c: its component) in different components whose sets may be similar enough by size and by the
    places of a common shingle, rarest first. All similar pairs are among them."""
    left = docs.select("doc_id", "text").join(own.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    shingles = stored(left.mapInPandas(lean(_shingles(size)), "set long, id long, n long, h long"), "shingles")
    # shingles of one set alone make no pair, but stand first in it
    counts = stored(shingles.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "counts")
    by_set, order = Window.partitionBy("set"), Window.partitionBy("set").orderBy("df", "h")
    at = shingles.join(counts, "h").withColumn("r", F.dense_rank().over(order))
    at = at.withColumn("i", F.col("n") - F.max("r").over(by_set) + F.col("r") - 1)
    at = at.where((F.col("n") - F.col("i")) * 100 >= F.col("n") * percent).select("h", "id", "n", "i").join(own, "id")
    prefixes = stored(at, "prefixes")

    def enough(n: str, i: str, n2: str, j: str) -> Column:
        """Similar sets have as many shingles from these places on."""
        return F.least(F.col(n) - F.col(i), F.col(n2) - F.col(j)) * (100 + percent) >= percent * (F.col(n) + F.col(n2))

    # places so far back that no set with the shingle is short enough go at once
    spread = prefixes.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("n").alias("least")).where("lo < hi").select("h", "least")
    short = F.greatest(F.col("least"), (F.col("n") * percent + 99) / 100)
    front = prefixes.join(spread, "h").where((F.col("n") - F.col("i")) * (100 + percent) >= percent * (F.col("n") + F.floor(short)) - percent)
    front = stored(front.drop("least"), "front")
    # members meet components, then those of the components' members that fit
    seats = front.groupBy("h", F.col("c").alias("c2")).agg(F.min("n").alias("n2"), F.max("n").alias("most"), F.max(F.col("n") - F.col("i")).alias("room"))
    seats = seats.withColumn("j", F.col("n2") - F.col("room"))
    fit = (F.col("most") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("n2") * percent)
    meets = front.join(seats, "h").where("c < c2").where(fit & enough("n", "i", "n2", "j")).select("h", F.col("id").alias("a"), "n", "i", "c2")
    other = front.select("h", F.col("id").alias("b"), F.col("n").alias("n2"), F.col("i").alias("j"), F.col("c").alias("c2"))
    near = (F.col("n") * 100 >= F.col("n2") * percent) & (F.col("n2") * 100 >= F.col("n") * percent)
    return meets.join(other, ["h", "c2"]).where(near & enough("n", "i", "n2", "j")).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) and kept (the id is the component's)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    signed = stored(map_frames(docs, _signed(size), "doc_id long, n_shingles long, class string, sig binary"), "signatures")
    known = signed.where("doc_id is not null and n_shingles > 0")
    first = known.groupBy("class").agg(F.min("doc_id").alias("id"))
    classes = stored(known.join(first, "class").where("doc_id = id").select("id", F.col("n_shingles").alias("n"), "sig"), "classes")
    # one exchange by key: buckets of more than one id
    bucket = Window.partitionBy("key")
    keys = classes.mapInPandas(lean(_keyed), "key long, id long, n long")
    keys = keys.withColumns({"lo": F.min("id").over(bucket), "hi": F.max("id").over(bucket), "size": F.count("*").over(bucket)})
    members = stored(keys.where("lo < hi").select("key", "id", "n", "size"), "members")
    labels, links = None, None
    near = (F.col("n") * 100 >= F.col("n2") * percent) & (F.col("n2") * 100 >= F.col("n") * percent)

    def live() -> DataFrame:
        """Members of the buckets that hold more than one component, with their components."""
        at = members.select("key", "id", "n")
        at = at.withColumn("c", F.col("id")) if labels is None else at.join(labels, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
        mixed = at.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("key", "size")
        return at.join(mixed, "key")

    def close(pairs: DataFrame) -> DataFrame:
        """Pairs within LIMIT of each other."""
        of_a, of_b = classes.select(F.col("id").alias("a"), F.col("sig").alias("x")), classes.select(F.col("id").alias("b"), F.col("sig").alias("y"))
        return pairs.join(of_a, "a").join(of_b, "b").where(distance("x", "y") <= LIMIT).select("a", "b")

    def link(pairs: DataFrame) -> None:
        nonlocal labels, links
        new = stored(confirmed(pairs, docs, size, percent), "confirmed")
        if not new.isEmpty():
            links = new if links is None else labels.select(F.col("id").alias("a"), F.col("component").alias("b")).union(new)
            labels = stored(components(links), "labels")

    def tries(shared: DataFrame, n: int) -> DataFrame:
        """For each member the centres that it shares most buckets with."""
        order = Window.partitionBy("a").orderBy(F.desc("count"), "b")
        return shared.groupBy(F.col("id").alias("a"), "b").count().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).select("a", "b")

    for turn in range(ROUNDS):
        members = now = stored(live(), "live") if turn else members.withColumn("c", F.col("id"))
        if now.isEmpty():
            break
        weights = now.groupBy("id").agg(F.sum("size").alias("weight"))
        centre = now.join(weights, "id").groupBy("key").agg(F.max_by(F.struct("id", "c", "n"), F.struct("weight", "id")).alias("r"))
        shared = now.join(centre, "key").select("id", "c", "n", F.col("r.id").alias("b"), F.col("r.c").alias("c2"), F.col("r.n").alias("n2"))
        link(stored(close(tries(shared.where("c <> c2").where(near), TRIES)), "pairs"))
    own = stored(live().select("id", "c").distinct(), "rest")
    if not own.isEmpty():
        link(stored(close(prefix_pairs(docs, own, size, percent)), "pairs"))
    out = signed.join(first, "class", "left")
    out = out.withColumn("component", F.col("id")) if labels is None else out.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
