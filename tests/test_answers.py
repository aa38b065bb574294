"""Aliases, phrases, evidence, betweenness on small literals."""

from __future__ import annotations

import json
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import assembly, catalog, graph
from corpusgraph.plans import answers


def test_aliases(spark):
    targets = spark.createDataFrame([(1, "SessionParser"), (2, "x")], "id long, name string")
    found = {(r.id, r.alias): r.weight for r in catalog.aliases(targets, "id", "name", 0.9).collect()}
    assert found[1, "session parser"] == 0.9 and found[1, "session"] == pytest.approx(0.7) and found[1, "parsing"] == pytest.approx(0.66)
    assert not any(k == 2 for k, _ in found)  # one letter is no alias
    phrases = spark.createDataFrame([("q", "session parser"), ("q", "parser"), ("r", "nothing")], "query string, phrase string")
    hits = catalog.resolve(phrases, catalog.aliases(targets, "id", "name", 0.9), "id", 5).collect()
    assert [(r.query, r.id, r.weight) for r in hits] == [("q", 1, 0.9)]


def test_alias_cap(spark):
    name = " ".join(f"word{chr(97 + k)}ing" for k in range(20))
    assert catalog.aliases(spark.createDataFrame([(1, name)], "id long, name string"), "id", "name", 0.9).count() == catalog.MOST_ALIASES


def test_aliases_are_sorted_where_their_target_lies(spark, monkeypatch):
    """More targets are more tasks; their aliases aren't moved."""
    monkeypatch.setattr(catalog, "TASK_TARGETS", 10)
    targets = spark.createDataFrame([(k, f"SessionParser{k % 7}") for k in range(200)], "id long, name string")
    found = catalog.aliases(targets, "id", "name", 0.9).withColumn("part", F.spark_partition_id())
    rows = found.collect()
    per: dict[int, int] = {}
    for r in rows:
        per[r.part] = per.get(r.part, 0) + 1
    assert {r.id for r in rows} == set(range(200)) and max(per.values()) < len(rows) / 5
    assert found.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_phrases_and_evidence(spark):
    got = spark.range(1).select(assembly.phrases(F.array(*(F.lit(w) for w in "a b c".split()))).alias("p")).first().p
    assert got == ["a", "b", "c", "a b", "b c", "a b c"]
    chunks = spark.createDataFrame([(1, "# Title\n\nnothing\nlogin here\nlogin and token")], "id long, text string")
    lines = assembly.evidence_lines(chunks, "id", "text", ["login", "token"]).orderBy(F.desc("score"), "line").collect()
    assert [(r.line, r.score) for r in lines] == [(5, 40), (4, 20), (1, 10)]
    assert [r.fact for r in assembly.facts(chunks, "id", "text", "LOGIN", "([a-z]+) here").collect()] == ["login"]
    few, many = (json.loads(assembly.evidence_record(spark.createDataFrame([(n, 1.5)], "n int, value double"), "latency", 20).first().json) for n in (3, 30))
    assert few == {"metric": "latency", "status": "insufficient_evidence", "samples": 3} and many["status"] == "measured" and many["value"] == 1.5


def test_betweenness(spark):
    rng = random.Random(9)
    edges = {tuple(sorted(rng.sample(range(14), 2))) for _ in range(22)}
    near: dict[int, set[int]] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    sources, want = sorted(near)[:4], dict.fromkeys(near, 0.0)
    for s in sources:
        order, paths, level, queue = [], {s: 1.0}, {s: 0}, deque([s])
        while queue:
            u = queue.popleft()
            order.append(u)
            for v in near[u]:
                if v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
                if level[v] == level[u] + 1:
                    paths[v] = paths.get(v, 0) + paths[u]
        flow = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for u in near[v]:
                if level.get(u) == level[v] - 1:
                    flow[u] += paths[u] / paths[v] * (1 + flow[v])
            if v != s:
                want[v] += flow[v] / len(sources)
    pairs = spark.createDataFrame(sorted(edges), "a long, b long")
    got = {r.id: r.score for r in graph.betweenness(pairs, spark.createDataFrame([(s,) for s in sources], "id long"), 13).collect()}
    assert {k: pytest.approx(v) for k, v in want.items() if v} == {k: v for k, v in got.items() if v}


def test_betweenness_query_takes_the_whole_graph(spark, tmp_path):
    rng = random.Random(4)
    lines = [(1 + k // 2, 1 + (k + 1) // 2, 7 + k % 44, 1, k) for k in range(240)] + [(rng.randint(1, 120), rng.randint(1, 120), 3, 1, 900 + k) for k in range(15)]  # a long way, with short cuts
    spark.createDataFrame([(a, b, float(q), n, o) for a, b, q, n, o in lines], "l_suppkey long, l_partkey long, l_quantity double, l_linenumber int, l_orderkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    near: dict[int, set[int]] = {}
    for a, b, *_ in lines:
        near.setdefault(2 * a, set()).add(2 * b + 1)
        near.setdefault(2 * b + 1, set()).add(2 * a)
    nodes = sorted(near)
    sources, want = nodes[:: -(-len(nodes) // 100)], dict.fromkeys(nodes, 0.0)
    for s in sources:
        level, paths, order = {s: 0}, {s: 1.0}, [s]
        for u in order:
            for v in near[u]:
                if v not in level:
                    level[v] = level[u] + 1
                    order.append(v)
                if level[v] == level[u] + 1:
                    paths[v] = paths.get(v, 0) + paths[u]
        flow = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for u in near[v]:
                if level[u] == level[v] - 1:
                    flow[u] += paths[u] / paths[v] * (1 + flow[v])
            want[v] += flow[v] / len(sources) if v != s else 0
    got = {r.id: r.score for r in answers.betweenness_sampled(spark, str(tmp_path)).collect()}
    assert len(nodes) > 100 and got == {k: pytest.approx(v, abs=1e-5) for k, v in want.items()}


def test_betweenness_moves_no_edges(spark, monkeypatch):
    """Levels go to the edges, which stay where they were written; both ways of going give the same sums; pairs may repeat."""
    rng = random.Random(5)
    edges = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(90)})
    pairs = spark.createDataFrame(edges * 2, "a long, b long")
    monkeypatch.setattr(graph, "RUN", 3)
    monkeypatch.setattr(graph, "tasks", lambda rows: 5)
    ways = graph.neighbours(pairs)
    front = spark.createDataFrame([(s, u, float(1 + s + u)) for s in (1, 2) for u in range(0, 40, 3)], "s long, u long, x double")
    want: dict[tuple[int, int], float] = {}
    for a, b in edges:
        for u, v in ((a, b), (b, a)):
            for s in (1, 2):
                if u % 3 == 0:
                    want[s, v] = want.get((s, v), 0.0) + 1 + s + u
    sent = graph.gather(front, ways, 28)
    assert "hashpartitioning" not in sent._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(graph, "SENT", 0)
    dealt = graph.gather(front, ways, 28)
    for found in (sent, dealt):
        assert {(r.s, r.u): r.x for r in found.collect()} == want
    sources = spark.createDataFrame([(0,), (7,)], "id long")
    twice, once = ({r.id: r.score for r in graph.betweenness(p, sources).collect()} for p in (pairs, pairs.distinct()))
    assert twice == {k: pytest.approx(v) for k, v in once.items()} and any(once.values())
