"""Documents from raw to packed: toxic ones go, repeated line runs go, one of each near-duplicate group stays, sources are
mixed to target weights, and what is left is packed into windows.

STAGES are applied in order, each to all that the one before it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import line_runs, mixing, near_duplicates, packing, toxicity
from siftline.llm.queries import SEED, TREE, WEIGHTS, tree_columns
from siftline.llm.tables import held, read, released, stored

MIN_WORDS = 50
SHARE = (4, 5)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the threshold; learnt from labels of rows that are not held out."""
    open_rows = ~F.coalesce(toxicity.held_out(), F.lit(False))
    model = toxicity.fit(docs.where(open_rows), read(spark, sf_dir, "labels").where(open_rows), docs)
    at = toxicity.scored(docs.select("text", held(docs, "text").alias("row")), model)
    return at.where(F.col("score") < toxicity.THRESHOLD).select(*released(docs, "text"), "text").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs of MIN_WORDS words or more; those of which nothing is left go."""
    cut = line_runs.drop_repeated_runs(docs.select("doc_id", "text", held(docs, "text").alias("doc")), MIN_WORDS, whole=True)
    gone = (F.col("n_removed") > 0) & (F.length(F.translate("text", line_runs.BLANK, "")) == 0)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))
    kept = cut.where(~F.coalesce(gone, F.lit(False)))
    return kept.select(*released(docs, "text", "n_chars", row="doc"), "text", n_chars.alias("n_chars")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by id, of each group that shares 80 % of its five-word shingles."""
    found = near_duplicates.near_duplicates(docs, size=5, percent=80)
    return docs.join(found.where("not kept").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The share of all tokens that the weights of domain, language and source give, no document more than once."""
    tree = [c.alias(name) for c, name in zip(tree_columns(), TREE)]
    at = docs.select("doc_id", *tree, held(docs).alias("doc"))
    slim = stored(docs.select("doc_id", *tree, mixing.n_tokens(F.col("text")).alias("n_tokens")), "tokens")
    plan = mixing.leaf_plan(slim, TREE, WEIGHTS, SHARE, 1, SEED, "doc_id")
    return mixing.picked(at, plan, TREE, SEED, "doc_id").select(*released(docs, row="doc"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

#: Learnt scores and least squares have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, "stage")
    return docs
