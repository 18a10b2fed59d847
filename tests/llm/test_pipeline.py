"""The pipeline's stages: they chain, keep clean documents, and apply what they decide."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from wordflow.llm import near_dedup


@pytest.fixture(scope="module")
def sf(tmp_path_factory, spark):
    import random

    r = random.Random(8)
    vocab = ["".join(r.choice("aeioustrnl") for _ in range(r.randint(2, 6))) for _ in range(500)]
    passage = " ".join(r.choice(vocab) for _ in range(60))
    rows, labels = [], []
    for i in range(300):
        words = [r.choice(vocab) for _ in range(80)]
        if i % 5 == 1:
            words[r.randrange(80)] = "loathsome"
        text = " ".join(words) + (f" {passage}" if i % 30 == 7 else "")
        rows.append((i, text, "en", "s", len(text), "extra"))
        labels.append((i, 1, int(i % 5 == 1)))
    rows += [(900, rows[10][1], "en", "s", 1, None), (901, None, None, None, None, None), (902, "12 34", "en", "s", 5, "x")]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, predicted string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, kept = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept[name] = {r.doc_id: r for r in docs.collect()} if i < 4 else docs
        assert i == 4 or docs.columns == names
    clean = {i for i in range(300) if i % 5 != 1}
    assert set(kept["toxicity"]) == clean | {900, 901, 902}
    assert set(kept["language"]) == clean | {900}
    assert set(kept["near_dedup"]) == clean
    cut = [i for i in clean if kept["substring_dedup"][i].text != kept["near_dedup"][i].text]
    assert set(cut) == {i for i in clean if i % 30 == 7} - {7}
    assert all(kept["substring_dedup"][i].n_chars == len(kept["substring_dedup"][i].text) for i in cut)
    assert {r.doc_id for r in kept["packing"].select("doc_id").distinct().collect()} == clean
    assert kept["packing"].agg(F.max("length")).first()[0] <= 2048


def test_run_and_default_similarity(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert (near_dedup.SHINGLE, near_dedup.SIMILARITY) == (5, 80)
