from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusgraph.functions import stem as S

#: Examples of the published algorithm.
PAIRS = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit operator oper feudalism feudal decisiveness decis hopefulness hope formaliti formal triplicate triplic formative form formalize formal electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust replacement replac adoption adopt communism commun activate activ effective effect probate probat rate rate cease ceas controll control roll roll".split()


@pytest.mark.parametrize(("word", "want"), list(zip(PAIRS[::2], PAIRS[1::2], strict=True)))
def test_published_examples(word, want):
    assert S.stem(word) == want


def test_frames(spark):
    rows = spark.createDataFrame([("running",), ("running",), (None,), ("a",)], "term string")
    assert {r.term: r.stem for r in S.stemmed(rows).collect()} == {"running": "run", None: None, "a": "a"}
    out = spark.createDataFrame([(["a", "b", "a"],), ([],)], "w array<string>").select(S.hashed_embedding(F.col("w"), 8).alias("v")).collect()
    assert sum(x * x for x in out[0].v) == pytest.approx(1) and out[1].v == [0.0] * 8
