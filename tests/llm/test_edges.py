"""Nulls, empty and long texts, repeated rows, empty tables, and columns with clashing names, for every operator."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpusgraph.llm import byte_bpe, chunk_dedup, decontaminate, line_dedup, multi_index, order_minhash, pii, token_store, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, id long, row string, keys string, score string, spans string"
LONG = "lorem ipsum dolor sit amet consectetur " * 4000
ROWS = [
    (1, "One two three four five six seven.\nSecond line here, with words.", "en", 7, "r", "k", "s", "p"),
    (1, "One two three four five six seven.\nSecond line here, with words.", "en", 7, "r", "k", "s", "p"),
    (2, None, None, None, None, None, None, None),
    (3, "", "en", 1, "", "", "", ""),
    (None, "A text without a number, of some words only.", "fr", 2, "a", "b", "c", "d"),
    (None, None, None, None, None, None, None, None),
    (4, LONG, "en", 3, "x", "y", "z", "w"),
    (1, "Another text with the same number as the first one has.", "de", 4, "q", "q", "q", "q"),
]
BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def operators(spark, docs):
    bench = spark.createDataFrame([(1, "four five six seven second line here with words"), (2, None), (None, "one two"), (3, "")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    folder = token_store.write_store(docs, WORDS)
    model = toxicity.fit(docs, labels)
    return {
        "token_store": token_store.read_store(spark, folder),
        "toxicity": toxicity.score_documents(docs, model),
        "toxicity_reject": toxicity.reject(docs, model),
        "byte_bpe": byte_bpe.digests(byte_bpe.decode_documents(byte_bpe.encode_documents(docs, BPE, public_tokenizers.PATTERN), BPE)),
        "line_report": line_dedup.report(docs),
        "line_dedup": line_dedup.dedup(docs),
        "chunks": chunk_dedup.cut_out(docs),
        "contamination": decontaminate.digests(decontaminate.contamination(docs, bench)),
        "clean": decontaminate.clean(docs, bench),
        "pii": pii.digests(pii.find_spans(docs)),
        "redact": pii.redact(docs),
        "classes": order_minhash.classes(docs),
        "keep_one": order_minhash.keep_one(docs),
    }


def test_odd_rows(spark, stored):
    docs = stored(ROWS, SCHEMA)
    out = {name: df.collect() for name, df in operators(spark, docs).items()}
    one_row_each = set(out) - {"keep_one", "clean"}
    assert {name: len(out[name]) for name in one_row_each} == dict.fromkeys(one_row_each, len(ROWS))
    assert sorted(r.n_tokens for r in out["token_store"])[:3] == [1, 1, 1]  # null and empty texts: the end id alone
    assert [r.n_tokens for r in out["byte_bpe"] if r.doc_id in (2, 3)] == [0, 0]
    assert {r.doc_id: r.class_id for r in out["classes"]}[3] == 2  # empty and null texts are copies
    assert sorted((r.doc_id or 0) for r in out["keep_one"]) == [0, 1, 1, 2, 4]
    assert all(r.text is None or "four five six" not in r.text for r in out["clean"] if r.doc_id == 1)
    lines = sorted((r.text for r in out["line_dedup"] if r.doc_id == 1), key=len)
    assert lines[0] == "" and "Second line" in "".join(lines)  # of two equal rows one keeps its lines
    assert docs.columns == [c for c in out["line_dedup"][0].asDict()] == [c for c in out["keep_one"][0].asDict()]


def test_empty_table(spark, stored):
    docs = stored([], SCHEMA)
    assert {name: df.count() for name, df in operators(spark, docs).items()} == dict.fromkeys(operators(spark, docs), 0)


@pytest.mark.parametrize("rows", [[], [(None, None), (1, None), (2, ""), (3, "no scheme"), (4, "http://A.ORG"), (4, "http://A.ORG"), (5, "x://h.com/de/" + "q" * 5000)]])
def test_urls(spark, rows):
    out = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(out) == len(rows)
    got = {r.page_id: r for r in out}
    if rows:
        assert (got[1].host, got[1].path, got[1].rule) == ("", "", None)
        assert (got[4].host, got[4].path, got[4].rule) == ("a.org", "", None)  # the rule asks for a path
        assert (got[5].rule, got[5].verdict) == ("com/de/", "block")


def test_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (100, [1.0, 0.5]), (200, [float("inf"), 1.0])]
    out = multi_index.search(spark.createDataFrame(rows, schema), F.col("vec_id") % 100 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(out)] == [(0, 1, 1), (0, 2, 100), (0, 3, 2), (100, 1, 0), (100, 2, 1), (100, 3, 2)]
    assert multi_index.search(spark.createDataFrame([], schema), F.col("vec_id") % 100 == 0).count() == 0
