import pytest

import corpus_pipeline
from pairwright.llm import registry

from .common import edited, prose, rng


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with planted toxic texts, passages, copies and benchmark items."""
    out, r = tmp_path_factory.mktemp("sf"), rng(31)
    items = [(k, prose(r, 30 + k)) for k in range(6)]
    texts = [f"{prose(r, 60)}.\n{prose(r, 40)}." for _ in range(160)]
    passage = prose(r, 70)
    base = prose(r, 200)
    toxic = list(range(0, 60, 2))
    for k in toxic:
        texts[k] = texts[k].replace(".\n", " you grobnik. such a grobnak.\n")
    for k in range(70, 80):
        texts[k] += "\n" + passage
    for k in range(80, 90):
        texts[k] = edited(r, base, k % 3)
    for k in range(90, 96):
        texts[k] = f"{prose(r, 20)} {items[k - 90][1]} {prose(r, 20)}"
    texts += [None, ""]
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(0, 69)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), toxic, passage


def test_each_stage_takes_effect(spark, folder):
    path, toxic, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, path), name)
        assert docs.columns == columns
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = set(range(100, 160)) | set(range(1, 60, 2))
    assert set(seen["toxicity"]) == set(range(162)) - set(toxic)
    assert sum(passage in (t or "") for t in seen["line_dedup"].values()) == 1
    assert len([k for k in range(80, 90) if k in seen["ngram_jaccard_join"]]) == 1
    assert not any(k in seen["decontamination"] for k in range(90, 96))
    assert clean <= set(seen["decontamination"])
    packed = corpus_pipeline.run(spark, path).collect()
    assert {r["doc_id"] for r in packed} == set(seen["decontamination"])


def test_empty_documents_pass_all_stages(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, path), "empty")
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries_run_on_the_given_tables(spark, small, name):
    assert registry.queries()[name](spark, small).count() > 0
