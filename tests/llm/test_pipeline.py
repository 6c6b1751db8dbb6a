"""The pipeline's stages against what the operators' brute-force versions say."""

from collections import Counter

import corpus_pipeline
from graphloom.llm import mixing, neardup, toxicity
from graphloom.llm.common import staged

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, columns = docs, docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        after = staged(stage(spark, before, SF), f"test-{name}")
        ids, old = [r.doc_id for r in after.select("doc_id").collect()], [r.doc_id for r in before.select("doc_id").collect()]
        if name == "toxicity":
            model = toxicity.fitted(before, spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "text", "toxic")
            words = toxicity.WordWeights(model.weights)
            assert sorted(ids) == sorted(k for k in old if toxicity.noisy_or([p for _, _, p in model.sentence_scores(texts[k], words)]) < 0.7)
        elif name == "near_dedup":
            assert sorted(ids) == sorted(r.doc_id for r in neardup.classes(before).filter("kept").collect()) and len({texts[k] for k in ids}) == len(ids)
        elif name == "decontamination":
            gone = set(old) - set(ids)
            assert {k for k in old if any(b in texts[k] for b in bench)} <= gone and len(gone) < 0.2 * len(old)
        elif name == "mixing":
            assert Counter(ids) == +Counter({r.doc_id: r.copies for r in mixing.mix_table(before).collect()})
        else:
            assert Counter(ids) == Counter(old) and set(columns) < set(after.columns)
        if name != "sharding":
            assert after.columns == columns
        before = after
    again = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, again.collect())) == sorted(map(str, before.collect()))
