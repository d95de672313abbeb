"""The pipeline's stages on small tables against what each has to do, and every registered query's columns."""

import pytest

import __spark_entry__
import corpus_pipeline
from siftline.llm import near_duplicates, toxicity

DATA = "/root/testdata/sf0.001"


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "MinHash near-dedup", "mixing sources to target weights", "packing"]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        out.write.parquet(f"file://{tmp_path}/{len(seen)}")
        out = spark.read.parquet(f"file://{tmp_path}/{len(seen)}")
        seen.append(out)
        if name != "packing":
            assert out.columns == columns and out.schema.simpleString() == docs.schema.simpleString()
            assert {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
            docs = out
    first, lines, near, mixed, packed = seen
    # no document of a group is left beside another of it, and one of each group is there
    assert near_duplicates.near_duplicates(near, 5, 80).where("not kept").count() == 0
    groups = near_duplicates.near_duplicates(lines, 5, 80)
    assert sorted(r.doc_id for r in groups.where("kept").collect()) == sorted(r.doc_id for r in near.collect())
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in mixed.collect()}
    whole = spark.read.parquet(f"{DATA}/documents.parquet")
    scores = toxicity.toxicity(whole, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert sorted(r.doc_id for r in scores.where("score < 0.3").collect()) == sorted(r.doc_id for r in first.collect())


def test_extra_columns_of_clashing_names_pass_through_the_stages(spark):
    extra = {"_score": "a", "_lang": "b", "row": "c", "component_id": "d", "epochs": "e", "n_removed": "f", "rid": "g"}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("*", *[f"'{v}' as {k}" for k, v in extra.items()])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        assert {tuple(r) for r in out.select(*extra).distinct().collect()} == {tuple(extra.values())}, name


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0


def test_all_queries_are_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("table", ["documents", "pages"])
def test_queries_on_empty_tables(spark, tmp_path, table):
    for name in ("documents", "labels", "pages", "conversations"):
        df = spark.read.parquet(f"{DATA}/{name}.parquet")
        (df.limit(0) if name in (table, "labels") else df.limit(20)).write.parquet(f"file://{tmp_path}/{name}.parquet")
    uses = {"pages": ("op4", "op9", "op11"), "documents": ("op1", "op2", "op5", "op6", "op7", "op8", "op10", "op12", "op13")}[table]
    for name, f in __spark_entry__.queries().items():
        if name.split("_")[0] in uses:
            assert f(spark, f"file://{tmp_path}").count() == 0, name
