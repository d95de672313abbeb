"""Quotation linking for chats and mail, in DataFrame operations only.

Lines that begin with '>' are quoted, as deep as they have such signs. Runs of lines of one depth are quoted passages;
they and their longer lines are normalised (small letters, white space as one space) and hashed, and so are the own words
of every message: the whole and each line. The original of a passage is the first message of its scope that has it
in its own words. A message answers the latest original of its shallowest linked passages, if that came before it. Roots and
depths follow by pointer doubling over linked messages only, in as many joins as the logarithm of the longest chain.

Originals are a grouped minimum by (scope, hash) before they meet quotations, so the join gives a row for each quoted
passage at most, however common a passage is. With ``excerpts``, a passage that meets no original so is looked for as a run
of whole lines or sentences, of any length and wrapped in any way: its first letters pick the lines or sentences where it
may begin, and only there as many letters as it has are hashed and compared. Positions in a thread come from counts of buckets of TURNS turns.

Defined results: null text has no words and stays null; an unquoted message keeps its text as it is; rows of equal scope and
turn are one message for links, and each keeps its own text; a null scope or turn links to nothing and is a root; quotations
of what nobody said before link to nothing; an empty table gives an empty result; further columns are handed on, but for
those of a result's name, whose place the result takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import held, in_order, released, stored

QUOTED = r"(?m)^[ \t]*>"
MARKS = r"^[ \t]*(?:>[ \t]?)+"
#: The line above a quotation that says whose it is.
SAID = r"(?i)\b(wrote|writes|said|schrieb|schreibt|écrit|escribió)\b[^\n]*:[ \t\r]*$"
LEAST = 20  # letters of a single line that may link
#: A line or sentence ends here.
ENDS = r"\n|(?<=[.!?…])[\s ]+"
BEGINS = (1, 4, 16, 64)  # letters that a passage and an original begin with alike
TURNS = 1024


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\s ]+", " "))


def line_array(text: Column) -> Column:
    """Lines as (depth, words)."""
    def one(x: Column) -> Column:
        marks = F.regexp_extract(x, MARKS, 0)
        return F.struct(F.length(F.regexp_replace(marks, r"[^>]", "")).alias("depth"), F.substring(x, F.length(marks) + 1, F.length(x)).alias("words"))

    return F.transform(F.split(text, "\n"), one)


def parsed(messages: DataFrame, text: str) -> DataFrame:
    """``messages`` with own (words that are no quotation) and passages (depth, words)."""
    at = messages.withColumn("_quotes", F.coalesce(F.col(text).rlike(QUOTED), F.lit(False)))
    at = at.withColumn("_lines", F.when(F.col("_quotes"), line_array(F.col(text))))
    depth = lambda i: F.get("_lines", i)["depth"]
    every = F.sequence(F.lit(0), F.size("_lines") - 1)
    at = at.withColumn("_starts", F.filter(every, lambda i: (i == 0) | (depth(i) != F.coalesce(depth(i - 1), F.lit(-1)))))
    runs = F.transform(
        "_starts",
        lambda s, k: F.struct(
            depth(s).alias("depth"),
            F.array_join(F.transform(F.slice("_lines", s + 1, F.coalesce(F.get("_starts", k + 1), F.size("_lines")) - s), lambda x: x["words"]), "\n").alias("words"),
        ),
    )
    at = at.withColumn("passages", F.filter(runs, lambda r: (r["depth"] > 0) & (F.trim(r["words"]) != "")))
    mine = F.filter("_lines", lambda x, i: (x["depth"] == 0) & ~(x["words"].rlike(SAID) & (F.coalesce(depth(i + 1), F.lit(0)) > 0)))
    own = F.regexp_replace(F.array_join(F.transform(mine, lambda x: x["words"]), "\n"), r"^\s+|\s+$", "")
    return at.withColumn("own", F.when(F.col("_quotes"), own).otherwise(F.col(text))).drop("_quotes", "_lines", "_starts")


def units(words: Column) -> Column:
    """Hashes of the whole and of its longer lines."""
    lines = F.filter(F.transform(F.split(words, "\n"), normalised), lambda x: F.length(x) >= LEAST)
    whole = normalised(words)
    return F.array_distinct(F.transform(F.filter(F.concat(F.array(whole), lines), lambda x: x != ""), lambda x: F.xxhash64(x)))


def from_excerpts(loose: DataFrame, ids: DataFrame) -> DataFrame:
    """(s, t, depth, o): the first message whose own words have passage ``words`` of ``loose`` as a run of lines or sentences."""
    begin = F.greatest(*[F.when(F.length("words") >= c, F.lit(c)) for c in BEGINS])
    loose = loose.withColumns({"n": F.length("words"), "begin": begin})
    loose = stored(loose.withColumns({"key": F.xxhash64(F.col("words").substr(F.lit(1), F.col("begin"))), "h": F.xxhash64("words")}).drop("words"), "loose")
    said = ids.where(F.coalesce(F.col("own"), F.lit("")) != "").join(loose.select("s").distinct(), "s", "left_semi")
    said = said.groupBy("s", F.xxhash64("own").alias("text")).agg(F.min("t").alias("o"), F.first("own").alias("own"))
    parts = F.filter(F.transform(F.split("own", ENDS), normalised), lambda x: x != "")
    said = stored(said.select("s", "text", "o", parts.alias("parts")).where(F.size("parts") > 0), "parts")
    # each part and the blank after it are two letters at least
    heads = F.transform("parts", lambda _, i: F.array_join(F.slice("parts", i + 1, F.lit(BEGINS[-1] // 2)), " "))
    heads = said.select("s", "text", F.posexplode(heads).alias("at", "head"))
    heads = heads.select("s", "text", "at", "head", F.explode(F.array(*map(F.lit, BEGINS))).alias("begin")).where(F.length("head") >= F.col("begin"))
    heads = heads.select("s", "text", "at", "begin", F.xxhash64(F.col("head").substr(F.lit(1), F.col("begin"))).alias("key"))
    asked = heads.join(loose.select("s", "begin", "key", "n").distinct(), ["s", "begin", "key"])
    asked = asked.groupBy("s", "text").agg(F.collect_set(F.struct("at", "n")).alias("asked"))

    def run(x: Column) -> Column:
        # parts hold no line break, so one marks where they end
        rest = F.array_join(F.slice("parts", x["at"] + 1, F.floor(x["n"] / 2).cast("int") + 1), "\n")
        return F.when(rest.substr(x["n"] + 1, F.lit(1)).isin("", "\n"), F.xxhash64(F.translate(rest.substr(F.lit(1), x["n"]), "\n", " ")))

    runs = said.join(asked, ["s", "text"]).select("s", "o", F.explode(F.transform("asked", run)).alias("h")).where("h is not null")
    return loose.join(runs.groupBy("s", "h").agg(F.min("o").alias("o")), ["s", "h"]).where("o < t").select("s", "t", "depth", "o")


def linked(messages: DataFrame, scope: str = "conv_id", turn: str = "turn", text: str = "text", excerpts: bool = False) -> DataFrame:
    """``messages`` with their own words as text, n_passages, parent, root, depth and position in the thread; ``excerpts``:
    passages that are neither a whole message nor have a longer line of one may be any lines or sentences of one."""
    new = ("n_passages", "parent", "root", "depth", "position")
    at = messages.select(F.col(scope).alias("s"), F.col(turn).alias("t"), F.col(text).alias("text"), held(messages, text, *new).alias("row"))
    at = stored(parsed(at, "text"), "parsed")
    ids = at.where("s is not null and t is not null").select("s", "t", "own", "passages")
    passages = ids.where(F.size("passages") > 0).select("s", "t", F.explode("passages").alias("p")).select("s", "t", "p.depth", "p.words")
    passages = passages.withColumn("whole", F.xxhash64(normalised(F.col("words"))))
    quoted = passages.select("s", "t", "depth", "whole", F.explode(units(F.col("words"))).alias("h"))
    said = ids.where(F.coalesce(F.col("own"), F.lit("")) != "").select("s", "t", F.explode(units(F.col("own"))).alias("h"))
    first = said.groupBy("s", "h").agg(F.min("t").alias("o"))
    met = quoted.join(first, ["s", "h"]).where("o < t")
    if excerpts:
        met = stored(met, "met")
        loose = passages.withColumn("words", normalised(F.col("words"))).where("words != ''")
        loose = loose.join(met, ["s", "t", "depth", "whole"], "left_anti").select("s", "t", "depth", "words").distinct()
        met = met.select("s", "t", "depth", "o").union(from_excerpts(loose, ids))
    # the shallowest linked depth, and there the latest original
    links = stored(met.groupBy("s", "t").agg(F.max(F.struct(-F.col("depth"), "o"))["o"].alias("parent")), "links")
    up = stored(links.select("s", "t", F.col("parent").alias("root"), F.lit(1).alias("depth")), "roots")
    while True:
        on = up.select("s", F.col("t").alias("root"), F.col("root").alias("root2"), F.col("depth").alias("more"))
        if up.join(on, ["s", "root"], "left_semi").isEmpty():
            break
        up = stored(up.join(on, ["s", "root"], "left").select("s", "t", F.coalesce("root2", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "roots")
    ranks = positions(up)
    answers = up.join(links, ["s", "t"]).join(ranks, ["s", "root", "t"])
    return at.join(answers, ["s", "t"], "left").select(
        *released(messages, text, *new),
        F.col("own").alias(text),
        F.coalesce(F.size("passages"), F.lit(0)).alias("n_passages"),
        "parent",
        F.coalesce("root", "t").alias("root"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
        F.coalesce("position", F.lit(0)).cast("long").alias("position"),
    ).select(*in_order(messages, *new))


def positions(up: DataFrame) -> DataFrame:
    """Place of each answer among those of its root, in order of turns: the root is 0."""
    answers = up.select("s", "root", "t").distinct().withColumn("bucket", F.floor(F.col("t") / TURNS))
    sums = answers.groupBy("s", "root", "bucket").count()
    before = Window.partitionBy("s", "root").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("s", "root", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("s", "root", "bucket").orderBy("t"))
    return answers.withColumn("_n", inside).join(sums, ["s", "root", "bucket"]).select("s", "root", "t", (F.col("before") + F.col("_n")).alias("position"))
