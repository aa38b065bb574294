"""Operators on small literals."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusgraph.functions import text as T
from corpusgraph.operators import expansion, fusion, graph, memory, quality
from corpusgraph.sources import repository
from corpusgraph.streaming import changes


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text(spark):
    words = lambda s: value(spark, T.boundary_tokens(F.lit(s)))
    assert value(spark, T.split_identifiers(F.lit("saveFlowToDatabase"))) == "save flow to database"
    assert words("HTTPServer_errorCode-2") == ["http", "server", "error", "code", "2"]
    assert value(spark, T.camel(T.boundary_tokens(F.lit("save_flow to-db")))) == "saveFlowToDb"
    assert set(value(spark, T.term_variants(F.lit("embedding")))) == {"embedding", "embedd", "embedder", "embe"}
    assert set(value(spark, T.term_variants(F.lit("authentication")))) == {"authentication", "authenticat", "authenticate", "auth"}
    assert set(value(spark, T.morph_aliases(F.lit("parser")))) == {"pars", "parsing"}
    assert value(spark, T.one_line(F.lit("a  b\n c" + "d" * 20), 10)) == "a b cdd..."
    assert value(spark, T.common_prefix(F.lit("src/a/b.ts"), F.lit("src/a/c.ts"))) == 2
    assert value(spark, T.matches_term(F.lit("src/userSession.ts"), F.lit("session")))
    assert not value(spark, T.matches_term(F.lit("obsession"), F.lit("session")))
    assert value(spark, T.is_test_path(F.lit("src/tests/a.ts"))) and not value(spark, T.is_test_path(F.lit("src/latest/a.ts")))
    assert all(value(spark, T.is_test_path(F.lit(x))) for x in ("e2e/a.ts", "a/b.e2e.ts", "x/Demo.py", "a/b.spec.ts", "examples/x"))
    assert not any(value(spark, T.is_test_path(F.lit(x))) for x in ("a/mytests.ts", "a/spec.ts", "demos/x.ts", ""))
    assert value(spark, T.salient_terms(F.lit("How does the 'saveFlow' work in src/a.ts?"))) == ["saveflow", "work", "src/a.ts"]


@pytest.mark.parametrize(("at", "want"), [("2024-04-01", 1.0), ("2024-02-16", 0.5), ("2023-09-01", 0.0), (None, None)])
def test_recency(spark, at, want):
    assert value(spark, T.recency(F.lit(at).cast("timestamp"), F.lit("2024-04-01"))) == want


def test_fusion(spark):
    vector = spark.createDataFrame([("a", 1), ("b", 2)], "id string, rank int")
    keyword = spark.createDataFrame([("b", 1)], "id string, rank int")
    for k in (60, 0, -1, float("inf")):
        got = {r.id: r.score for r in fusion.rrf(vector, keyword, "id", (0.5, 0.3), k).collect()}
        assert got == pytest.approx({"a": 0.5 / 61, "b": 0.5 / 62 + 0.3 / 61})
    penalty = lambda n: value(spark, fusion.length_penalty(F.lit(1.0), F.lit(n)))
    assert penalty(80) == 1 and penalty(160) == pytest.approx(80 / 144)
    boost = value(spark, fusion.attribute_boost(F.lit(1.0), F.lit(False), F.lit(False), F.lit(True), F.lit(True)))
    assert boost == pytest.approx(0.15)


def test_fusion_ignores_row_order(spark):
    rng = random.Random(1)
    rows = [(f"d{k}", k + 1) for k in range(30)]
    shuffled = rng.sample(rows, len(rows))
    results = [sorted(map(tuple, fusion.rrf(spark.createDataFrame(x, "id string, rank int").repartition(n), spark.createDataFrame(x[:9], "id string, rank int"), "id", (0.5, 0.5)).select("id", "score").collect())) for x, n in ((rows, 1), (rows, 7))]
    assert results[0] == results[1] and len(shuffled) == 30


def test_budget_passes_over_what_does_not_fit(spark):
    items = spark.createDataFrame([(1, k, c) for k, c in enumerate([40, 50, 30, 10, 20])] + [(2, 9, 500)], "q long, k long, cost long")
    assert sorted(map(tuple, fusion.within_budget(items, "q", ["k"], "k", "cost", 100).collect())) == [(1, 0, 40), (1, 1, 90), (1, 3, 100)]


def test_metrics(spark):
    rows = [("t", k + 1, g, 3) for k, g in enumerate([3, 2, 0, 1, 0])] + [("z", k + 1, 0, 0) for k in range(3)] + [("m", k + 1, g, 2) for k, g in enumerate([0, 0, 3, 1])]
    out = {r.q: r for r in quality.graded_metrics(spark.createDataFrame(rows, "q string, rank int, grade int, n_relevant int"), "q", 5).collect()}
    assert out["t"].dcg == pytest.approx(9.324, abs=1e-3)
    assert (round(out["t"].ndcg, 3), round(out["t"].ap, 3), out["t"].p_at_k, out["t"].r_at_k) == (0.993, 0.917, 0.6, 1.0)
    assert out["m"].mrr == pytest.approx(1 / 3, abs=1e-6) and (out["z"].ndcg, out["z"].mrr, out["z"].ap) == (0, 0, 0)


def test_latency(spark):
    out = quality.latency_summary(spark.createDataFrame([("a", float(k)) for k in range(1, 21)], "k string, ms double"), ["k"], "ms").first()
    assert (out.p50, out.p95, out.n) == (11, 20, 20)


def test_naming(spark):
    names = [("f", n) for n in ("getUser", "setUser", "loadAll", "Snake", "a_b")]
    x = spark.createDataFrame(names, "k string, name string").select("k", T.naming_style(F.col("name")).alias("s"))
    assert quality.majority_style(x, ["k"], "s").first().style == "camelCase"


def barbell(spark):
    clique = lambda a: [(a + i, a + j) for i in range(4) for j in range(i)]
    return spark.createDataFrame([*clique(0), *clique(10), (3, 10), (3, 3)], "src long, dst long")


def test_graph(spark):
    pairs = graph.undirected(barbell(spark))
    labels = {r.id: r.community for r in graph.propagate(pairs, 5).collect()}
    assert len(set(labels.values())) == 2 and len({labels[i] for i in range(4)}) == 1
    members = spark.createDataFrame([(i, 0) for i in range(4)] + [(99, 1)], "id long, community int")
    three = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "a long, b long")
    got = {r.community: r.cohesion for r in graph.cohesion(three, members).collect()}
    assert got == {0: 0.5, 1: 1.0}
    assert {r.id: r.level for r in graph.levels(barbell(spark), spark.createDataFrame([(13,)], "id long"), 2).collect()} == {13: 0, 12: 1, 11: 1, 10: 1}
    ring = spark.createDataFrame([(i, (i + 1) % 5) for i in range(5)], "src long, dst long")
    assert {r.degree for r in graph.degrees(graph.undirected(ring)).collect()} == {2}


def test_memory_rank(spark):
    score = lambda accesses, kind: value(spark, memory.rank_score(F.lit(1), F.lit(0.0), F.lit(accesses), F.lit(kind), F.lit(0.0), memory.type_boost(F.lit("feedback"))))
    base = 0.6 / 61
    assert score(0, "rule") == pytest.approx((base + 0.08) * 1.3)
    assert score(10, "fact") == pytest.approx((base * 0.75 + 0.03) * 1.3)
    assert score(20, "episode") == pytest.approx((base * 0.5 + 0.01) * 1.3)


DEMO = {
    "src/auth.py": "from session import issue\n\ndef login(user):\n    \"Log in.\"\n    return issue(user)\n\nclass Store:\n    def get(self, key):\n        return login(key)\n",
    "src/session.py": "def issue(user):\n    return user\n",
    "src/broken.py": "def (\n",
    "src/app.ts": "import { a } from './lib/a.js'\nimport b from \"../b\"\nimport x from 'react'\n",
    "src/lib/a.ts": "export const a = 1\n",
    "b/index.ts": "export default 1\n",
    "node_modules/x.py": "x = 1\n",
    "empty.py": "",
}


def test_repository(spark, tmp_path):
    for path, content in DEMO.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(content)
    (tmp_path / "binary.py").write_bytes(b"a\0b")
    files = repository.scan(spark, str(tmp_path))
    assert {r.file_path for r in files.collect()} == set(DEMO) - {"node_modules/x.py", "empty.py"}
    chunks = {(r.name, r.kind, r.start_line, r.parent_name): r for r in repository.chunk(files).collect()}
    assert set(chunks) >= {("login", "function", 3, None), ("Store", "class", 7, None), ("get", "method", 8, "Store"), ("issue", "function", 1, None), ("src/broken.py", "file", 1, None)}
    assert chunks["login", "function", 3, None].calls == ["issue"] and chunks["login", "function", 3, None].docstring == "Log in."
    found = repository.imports(files)
    assert {(r.file_path, r.module) for r in found.collect()} == {("src/auth.py", "session"), ("src/app.ts", "./lib/a.js"), ("src/app.ts", "../b"), ("src/app.ts", "react")}
    assert {r.module: r.resolved for r in repository.resolve_imports(found, files).collect()} == {"./lib/a.js": "src/lib/a.ts", "../b": "b/index.ts"}


def test_memory_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\nname: \"first\"\ntype: rule\ndescription: how to\n---\nBody.\n")
    (tmp_path / "b.md").write_text("no front matter")
    (tmp_path / "MEMORY.md").write_text("---\nname: x\ntype: rule\n---\n")
    assert [(r.name, r.type, r.content) for r in repository.memory_files(spark, str(tmp_path)).collect()] == [("first", "rule", "Body.")]


def test_changes_delete_before_upsert(spark):
    current = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "path string, v int")
    batch = spark.createDataFrame([("a", 9, 1, "change"), ("a", None, 2, "delete"), ("b", None, 1, "delete"), ("b", 7, 2, "add"), ("d", 4, 1, "add")], "path string, v int, seq int, op string")
    assert sorted(map(tuple, changes.apply_changes(current, batch, "path", ["seq"], "op").collect())) == [("b", 7), ("c", 3), ("d", 4)]
    again, dead = changes.retry_or_dead_letter(spark.createDataFrame([("a", 0), ("b", 2)], "path string, attempts int"))
    assert [r.path for r in again.collect()] == ["a"] and [r.path for r in dead.collect()] == ["b"]


def test_stream_keeps_a_table_current(spark, tmp_path):
    schema = "path string, v int, seq int, op string"
    table, source = str(tmp_path / "table"), str(tmp_path / "in")
    spark.createDataFrame([("a", 1), ("b", 2)], "path string, v int").write.parquet(table + "/0")
    state = {"at": 0}

    def write(df, batch_id):
        state["at"] += 1
        df.write.mode("overwrite").parquet(f"{table}/{state['at']}")

    spark.createDataFrame([("a", 5, 1, "change"), ("b", None, 1, "delete"), ("c", 3, 1, "add")], schema).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    changes.run_upserts(stream, lambda: spark.read.parquet(f"{table}/{state['at']}"), write, "path", ["seq"], "op", str(tmp_path / "check")).awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(f"{table}/{state['at']}").collect())) == [("a", 5), ("c", 3)]


def test_debounce_and_windows(spark):
    rows = [("a", f"2024-01-01 00:00:{s:02d}") for s in (0, 1, 2, 3, 4, 5, 6, 20)]
    events = spark.createDataFrame(rows, "path string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    out = sorted((r.n, r.flushes) for r in changes.debounced(events, "path", "ts").collect())
    assert out == [(1, 1), (7, 2)]
    assert {r.n for r in changes.windowed_counts(events, "ts", "path", "10 seconds", "1 minute").collect()} == {7, 1}


def test_coverage_and_rate_limit(spark):
    from corpusgraph.operators import quality
    from corpusgraph.streaming import changes

    trees = spark.createDataFrame([(1, 3, 1), (2, 0, 0), (3, 2, 2)], "k int, up int, down int")
    assert [tuple(r)[3:] for r in quality.coverage(trees, 9).orderBy("k").collect()] == [(0.5, 0.5, 0.5), (0.0, 0.0, 0.0), (0.5, 1.0, 0.65)]
    at = [0, 1, 2, 9, 10, 11, 12]  # two in ten seconds: 2 and 9 are refused and don't count; at 10 that of 0 is out
    events = spark.createDataFrame([("a", k, t) for k, t in enumerate(at)] + [("b", 9, 1)], "user string, id int, t int").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.id: r.allowed for r in changes.allowed(events, "user", "ts", "id", 2, 10).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True, 6: False, 9: True}


def test_pairs_within_crowded_groups(spark, monkeypatch):
    """A group of any size is met by many tasks, each pair once; nulls meet nobody."""
    monkeypatch.setattr(expansion, "BLOCK", 20)
    monkeypatch.setattr(expansion, "TASK_PAIRS", 500)
    rows = [(k, "a") for k in range(150)] + [(k, "b") for k in range(150, 160)] + [(160, "b"), (160, "b"), (161, "c"), (162, None), (163, None), (None, "b")]
    met = expansion.pairs_within(spark.createDataFrame(rows, "id long, g string"), "id", ["g"]).withColumn("part", F.spark_partition_id()).collect()
    want = sorted((a, b) for a, g in rows for b, h in rows if g is not None and g == h and None not in (a, b) and a != b)
    assert sorted((r.id, r.other) for r in met) == want
    assert max(Counter(r.part for r in met).values()) < len(met) / 10


def test_pairs_are_dealt_out_by_their_number(spark, monkeypatch):
    """More edges are more tasks, not larger ones; nothing is gathered in a table before that."""
    monkeypatch.setattr(graph, "tasks", lambda rows: rows // 100)
    rng = random.Random(6)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(3000)]
    pairs = graph.undirected(spark.createDataFrame(edges, "src long, dst long"))
    got = pairs.withColumn("part", F.spark_partition_id()).collect()
    assert sorted((r.a, r.b) for r in got) == sorted({(min(e), max(e)) for e in edges if e[0] != e[1]})
    assert max(Counter(r.part for r in got).values()) < len(got) / 10
    want = Counter(x for p in {(min(e), max(e)) for e in edges if e[0] != e[1]} for x in p)
    assert {r.id: r.degree for r in graph.degrees(pairs).collect()} == want


def test_propagation_moves_no_neighbours(spark, monkeypatch):
    monkeypatch.setattr(graph, "RUN", 4)
    rng = random.Random(8)
    edges = sorted({tuple(sorted(rng.sample(range(50), 2))) for _ in range(120)})
    label = {x: x for e in edges for x in e}
    for _ in range(3):
        votes = {x: Counter([label[x]]) for x in label}
        for a, b in edges:
            votes[a][label[b]] += 1
            votes[b][label[a]] += 1
        label = {x: min(v, key=lambda c: (-v[c], c)) for x, v in votes.items()}
    found = graph.propagate(spark.createDataFrame([e[::-1] if k % 3 else e for k, e in enumerate(edges * 2)], "a long, b long"), 3)  # repeated, either way round
    assert {r.id: r.community for r in found.collect()} == label


def test_cross_matrix_sorts_no_edges(spark):
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (3, 1), (4, 1)], "src long, dst long")
    members = spark.createDataFrame([(1, 7), (2, 8), (3, 7)], "id long, community long")
    found = graph.cross_matrix(edges, members)
    assert sorted(tuple(r) for r in found.collect()) == [(7, 8, 2), (8, 7, 1)]
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
