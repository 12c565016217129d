"""The pipeline's stages on a small folder, and held-out accuracy of the classifiers."""

import corpus_pipeline
import pytest

from shelfmark.llm import line_crf, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return {name: spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels")}


def test_stages(spark, tables, tmp_path):
    docs, kept = tables["documents"], {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r for r in tables["labels"].collect()}
    toxic = [i for i, r in labels.items() if r.toxic == 1]
    clean = [i for i, r in labels.items() if r.toxic == 0 and r.quality == 1]
    assert sum(i in kept["toxicity"] for i in toxic) <= 0.1 * len(toxic)
    assert sum(i in kept["quality"] for i in clean) >= 0.98 * len(clean)
    bad = [i for i, r in labels.items() if r.quality == 0]
    assert sum(i in kept["quality"] for i in bad) <= 0.1 * len(bad)
    alone = set(kept["near_duplicates"].values())
    assert len(alone) == len(kept["near_duplicates"])
    assert set(kept["near_duplicates"]) <= set(kept["quality"])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {p.doc_id for p in pieces} == set(kept["near_duplicates"])


def test_held_out_quality(tables):
    told = {r.doc_id: r.quality for r in tables["labels"].collect()}
    found = line_crf.classify_quality(tables["documents"], tables["labels"]).collect()
    held = [r.predicted == told[r.doc_id] for r in found if r.held_out and r.doc_id in told]
    assert sum(held) >= 0.95 * len(held) > 50


def test_toxicity_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet") for name in ("documents", "labels"))
    told = {r.doc_id: r.toxic for r in labels.where("doc_id % 2 = 0").collect()}
    found = {r.doc_id: r.is_toxic for r in toxicity.score_toxicity(docs, labels.where("doc_id % 2 = 1")).collect()}
    toxic = [found[i] for i, t in told.items() if t]
    clean = [found[i] for i, t in told.items() if not t]
    # About one toxic label in twelve is of a document without any telling word.
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.01 * len(clean)


CLASH = "doc_id long, text string, lang string, a string, z string, score string, label int, fold int, h int"


def test_stages_on_nulls_repeats_and_clashing_columns(spark, tables):
    """Filtering stages keep columns, nulls' rows and repeated rows; empty tables stay empty."""
    kept = "The old mill stood by the river, and the children walked there after school. They came home late."
    rows = [(1, kept), (1, kept), (2, kept + " It rained."), (None, "A letter came on Monday morning, and everyone read it twice."), (3, None), (4, "")]
    docs = spark.createDataFrame([(*row, *[None] * 7) for row in rows], CLASH)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).collect() == []
        if name == "near_duplicates":
            assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "1", "3", "4", "None"]  # 14 of 16 shingles of 2 are those of 1
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {str(p.doc_id) for p in pieces} == {"1", "2", "3", "4", "None"}  # tails are cut into several pieces
