"""Line dedup: a suffix order over line-ID sequences by distributed prefix doubling.

Each text is the sequence of its lines that hold words. The name of a position at level k stands for the 2^k
lines from there on; level 0 names are line hashes, and the name at level k + 1 is made of the names at level k
of the position and of the one 2^k further on (a join by text and position). Positions of equal name are an
interval of the suffix order whose longest common prefix is at least 2^k lines. A position whose name is found
once is dropped, since no suffix shares that prefix; so each level works on repeated runs only.

A run counts as repeated from ``min_words`` words on. The shortest prefix of a suffix that has them is some L
lines, and two overlapping names at level floor(log2 L) identify it; an interval of such prefixes has its first
member in order of (doc_id, line) as the original, and every line that the other members reach is deleted.
Longer common prefixes are unions of these, so whole maximal runs go, but for their first copy. L is at most
min_words, as every line has a word: there are at most log2(min_words) + 1 levels at any input size.

Defined results: null text stays null and blank lines stay; runs never cross texts; a text may repeat itself;
rows of equal id and text are one text and lose the same lines; an empty table gives an empty result; a text all
of whose lines go becomes empty (or its blank lines); other columns are handed on, but for one named n_removed, whose place
the result takes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .tables import held, in_order, map_frames, released, stored

BLANK = " \t\n\x0b\f\r"


def _positions(min_words: int, whole: bool):
    def frame(parts: list[tuple]) -> pd.DataFrame:
        sizes = [len(p[2]) for p in parts]
        docs = pd.Series([p[1] for p in parts], dtype="Int64")
        return pd.DataFrame({
            "rid": np.repeat(np.array([p[0] for p in parts], np.int64), sizes),
            "doc_id": docs.repeat(sizes).reset_index(drop=True),
            "at": np.concatenate([np.arange(n) for n in sizes]),
            "need": np.concatenate([p[2] for p in parts]),
            "most": np.concatenate([p[3] for p in parts]),
            "name": np.fromiter((x for p in parts for x in p[4]), np.uint64, sum(sizes)).view(np.int64),
        })

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts, held = [], 0
            for rid, doc, text in zip(b["rid"], b["doc_id"], b["text"]):
                lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
                counts = np.fromiter((len(x.split()) for x in lines), np.int64, len(lines))
                at = np.flatnonzero(counts)
                if not len(at):
                    continue
                ends = np.concatenate([[0], np.cumsum(counts[at])])
                # lines that the shortest sufficient prefix takes; 0: the text ends before
                need = np.searchsorted(ends, ends[:-1] + min_words) - np.arange(len(at))
                need[ends[:-1] + min_words > ends[-1]] = 0
                # lines of the longest window of which this is the last start that will do
                most = np.append(need[1:], 0)
                most = np.where(need == 0, 0, np.maximum(need, np.where(most == 0, len(at) - np.arange(len(at)), most)))
                parts.append((rid, doc, need, most if whole else need, [xxhash.xxh3_64_intdigest(lines[i]) for i in at]))
                held += len(at)
                if held > 50_000:
                    yield frame(parts)
                    parts, held = [], 0
            if parts:
                yield frame(parts)

    return run


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("n_removed", LongType())]))
def without(text: pd.Series, runs: pd.Series) -> pd.DataFrame:
    """Texts without the lines of the runs, which count the lines that hold words."""
    out = []
    for t, r in zip(text, runs):
        if t is None or r is None:
            out.append((t, 0))
            continue
        lines = t.split("\n")
        full = np.array([i for i, x in enumerate(lines) if x.strip(BLANK)], int)
        gone = np.zeros(len(full) + 1, int)
        for x in r:
            gone[x["at"]] += 1
            gone[min(x["at"] + x["need"], len(full))] -= 1
        drop = set(full[np.cumsum(gone)[:-1] > 0].tolist())
        out.append(("\n".join(x for i, x in enumerate(lines) if i not in drop), len(drop)))
    return pd.DataFrame(out, columns=["text", "n_removed"])


def later_runs(docs: DataFrame, min_words: int, whole: bool = False) -> DataFrame:
    """(rid, at, need): lines at .. at + need - 1 of text rid have an earlier copy."""
    names = stored(map_frames(docs, _positions(min_words, whole), "rid long, doc_id long, at int, need int, most int, name long"), "lines")
    out, level = None, 0
    while True:
        # written first: a join of two plain exchanges is one whose common lines Spark can split
        repeated = stored(names.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name"), f"repeated{level}")
        names = names.join(repeated, "name")
        names = stored(names if level else names.dropDuplicates(["rid", "at"]), f"level{level}")
        step = 1 << level
        here = names.where(f"most >= {step} and need between 1 and {2 * step - 1}")
        here = here.withColumn("need", F.explode(F.expr(f"sequence(greatest(need, {step}), least(most, {2 * step - 1}))")))
        then = names.select("rid", F.col("at").alias("to"), F.col("name").alias("then"))
        prefixes = here.withColumn("to", F.col("at") + F.col("need") - step).join(then, ["rid", "to"])
        prefixes = prefixes.withColumn("place", F.struct("doc_id", "rid", "at"))
        first = prefixes.groupBy("need", "name", "then").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        later = stored(prefixes.join(first, ["need", "name", "then"]).where(~F.col("place").eqNullSafe(F.col("first"))).select("rid", "at", "need"), f"later{level}")
        out = later if out is None else out.union(later)
        if 2 * step > min_words or names.where(f"most >= {2 * step}").isEmpty():
            return out
        after = names.select("rid", (F.col("at") - step).alias("at"), F.col("name").alias("then"))
        names = names.join(after, ["rid", "at"]).withColumn("name", F.xxhash64("name", "then", F.lit(level))).drop("then")
        level += 1


#: Bits of the filter that tells texts without runs, in bitmaps of 2^15 (4 KB): 4 MB to each executor at any input size.
FILTER_BITS, BITMAP = 1 << 25, 1 << 15


def marks(runs: DataFrame) -> DataFrame:
    """(bucket, bits): a bitmap of the texts that have runs."""
    bit = F.pmod("rid", F.lit(FILTER_BITS))
    return runs.select((bit / BITMAP).cast("long").alias("bucket"), (bit % BITMAP).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def marked(rid: Column, bits: Column) -> Column:
    """Whether the bit of a text is set; true, too, for a text that shares its bit."""
    bit = F.pmod(rid, F.lit(BITMAP))
    byte = F.conv(F.hex(F.substring(bits, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))


def drop_repeated_runs(docs: DataFrame, min_words: int = 50, key: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """All columns of ``docs`` with the text rid of later copies of repeated line runs, and n_removed (lines); ``whole``:
    of all their lines, not only those in a shortest prefix. Only texts that have runs (and those few that share a bit with
    one) are moved to them; ``docs`` is read twice."""
    rid = F.xxhash64(F.col(key), F.col(text))
    slim = docs.select(rid.alias("rid"), F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    runs = stored(later_runs(slim, min_words, whole).distinct().groupBy("rid").agg(F.collect_list(F.struct("at", "need")).alias("runs")), "runs")
    bits = F.broadcast(marks(runs))  # FILTER_BITS at most
    bucket = (F.pmod(rid, F.lit(FILTER_BITS)) / BITMAP).cast("long")
    at = docs.select(held(docs, text, "n_removed").alias("row"), F.col(text).alias("text"), rid.alias("rid"), bucket.alias("bucket"))
    at = at.join(bits, "bucket", "left").withColumn("marked", marked(F.col("rid"), F.col("bits"))).drop("bits", "bucket")
    cut = at.where("marked").join(runs, "rid", "left").withColumn("cut", without("text", "runs"))
    changed = F.col("runs").isNotNull()
    new_text = F.when(changed, F.col("cut.text")).otherwise(F.col("text")).alias(text)
    n_removed = F.when(changed, F.col("cut.n_removed")).otherwise(F.lit(0)).cast("long").alias("n_removed")
    cut = cut.select(*released(docs, text, "n_removed"), new_text, n_removed)
    kept = at.where(~F.col("marked")).select(*released(docs, text, "n_removed"), F.col("text").alias(text), F.lit(0).cast("long").alias("n_removed"))
    return cut.unionByName(kept).select(*in_order(docs, "n_removed"))
