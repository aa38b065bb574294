"""Every stage of the pipeline against brute force on its own input."""

from __future__ import annotations

import corpus_pipeline
from corpusgraph.llm import decontaminate, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = (sorted((r.doc_id, r.text or "") for r in before.collect()), docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    before, after = kept["toxicity"]
    assert sorted(r.doc_id for r in after) == [i for i, t in before if model.score(*model.find(t)) < toxicity.THRESHOLD]
    before, after = kept["line_dedup"]
    lines = [y.strip() for r in after for y in r.text.split("\n") if y.strip()]
    assert len(lines) == len(set(lines)) and all(r.n_chars == len(r.text) for r in after)
    assert {i for i, t in before} - {r.doc_id for r in after} == {i for i, t in before if t and not any(r.doc_id == i for r in after)}
    before, after = kept["near_dedup"]
    assert {r.doc_id for r in after} <= {i for i, _ in before} and len({r.text for r in after}) == len(after)
    before, after = kept["decontamination"]
    windows = {w for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in decontaminate.item_windows(r.text)}
    for r in after:
        words = decontaminate.words_of(r.text)
        assert not any(tuple(words[k : k + 10]) in windows for k in range(len(words)))
    before, after = kept["byte_bpe"]
    import hashlib

    assert {r.doc_id: r.decoded_sha256 for r in after} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in before}
