"""Functions and operators of query understanding and evidence, on small rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgraph.functions import understanding as U
from corpusgraph.operators import evidence


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_surfaces_and_layers_of_nothing(spark):
    none = F.lit(None).cast("string")
    assert one(spark, U.execution_surfaces(none, none, none)) == ["shared"]
    assert one(spark, U.workflow_layers(none, none)) == ["core"]


def test_surfaces_by_path_and_words(spark):
    assert one(spark, U.execution_surfaces(F.lit("src/pages/login.tsx"), F.lit("useSession"), F.lit(""))) == ["ui", "state"]
    assert one(spark, U.execution_surfaces(F.lit("a.ts"), F.lit("toolRegistration"), F.lit("x" * 400 + " router"))) == ["mcp"]
    assert one(spark, U.workflow_layers(F.lit("src/api/x.ts"), F.lit("routeGuard"))) == ["routing", "backend"]


def test_surfaces_look_words_up(spark):
    """A text is parted into words once, and its words are looked up; rules give what their patterns give."""
    texts = ["tool registration", "the tooling bridge.", "atool registration", "tool registrations", "toolRegistration", "pages", "page_x", "webpage", "HTTPServer", "stores", "x\nhook-y", "", "mcp", "éapi", "bearer"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in (*U.SURFACES, *(x for x in U.LAYERS if x.label != "state")):
        both = rows.select(r.holds(F.lit("a"), U.normalized(F.col("text"))).alias("a"), r.holds_among(F.lit("a"), U.identifier_tokens(F.col("text"))).alias("b")).collect()
        assert [x.a for x in both] == [x.b for x in both]
    plan = rows.select(U.execution_surfaces(F.lit("a"), F.lit("b"), F.col("text")).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_tags(spark):
    assert one(spark, U.auto_tags(F.lit("Passed SOC2; GDPR next"))) == ["security", "compliance", "audit", "privacy"]
    assert one(spark, U.auto_tags(F.lit("collinear precise"))) == []
    assert one(spark, U.auto_tags(F.lit(None).cast("string"))) == []


def test_tags_match_only_what_may_match(spark):
    """A text is lowered once; rules are tried where their first letters stand, and give what their patterns give."""
    texts = ["Passed SOC\n2", "CI", "the cd-drive", "pipeline", "PR", "pull request", "pull\nrequest", "a feature flag", "rate limit", "generate limit", "precise", "Encrypted", "reencrypt", "console.log", "console-log", "x_sql", "no-sql!", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for p, _ in U.TAGS:
        begins = U._begins(p)
        assert begins and not [r for r in rows.where(F.lower("text").rlike(p)).collect() if not any(b in r.text.lower() for b in begins)]
    tags = {r.text: r.t for r in rows.select("text", U.auto_tags(F.col("text")).alias("t")).collect()}
    for t in texts:
        plain = rows.where(F.col("text") == t).select(*(F.lower("text").rlike(p) for p, _ in U.TAGS)).first()
        assert tags[t] == list(dict.fromkeys(x for hit, (_, names) in zip(plain, U.TAGS, strict=True) if hit for x in names.split()))
    plan = rows.select(U.auto_tags(F.col("text")).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1 and plan.lower().count("contains(") >= len(U.TAGS)


def test_synonyms(spark):
    assert one(spark, U.synonyms(F.lit("what are the security audit rules"))) == ["compliance", "encryption", "vulnerability", "auth"]
    assert one(spark, U.synonyms(F.lit("a pr for me"))) == []  # two letters: too short to have synonyms
    assert one(spark, U.synonyms(F.lit(None).cast("string"))) == []


def test_query_matches(spark):
    assert one(spark, U.query_matches(["authentication", "db", "zzz"], F.lit("auth_db"), F.lit(None).cast("string"))) == 2


def test_weights(spark):
    none = F.lit(None).cast("double")
    assert tuple(one(spark, U.search_weights(F.lit(True), F.lit(0.9), none, none))) == (0.0, 0.3, 0.2)
    assert tuple(one(spark, U.search_weights(F.lit(False), none, F.lit(0.1), none))) == (0.5, 0.1, 0.2)


def test_confidence_and_strength(spark):
    rows = [("lookup", None, 1, 1, 1, None), ("trace", None, 5, 6, 2, None), ("bug", None, 3, 2, 1, None), ("change", None, 9, 5, 3, None), ("change", None, 9, 5, 3, 0.7), ("bug", "summary_only", 3, 3, 1, None), ("trace", None, 0, 0, 0, None)]
    d = spark.createDataFrame(rows, "mode string, delivery string, chunks long, files long, surfaces long, family double")
    c = {x: F.col(x) for x in d.columns}
    d = d.withColumn("c", evidence.evidence_confidence(*c.values()))
    out = d.select("c", evidence.context_strength(c["mode"], c["delivery"], c["chunks"], c["files"], F.lit(1), F.col("c")).alias("s")).collect()
    assert [tuple(r) for r in out] == [(0.9, "sufficient"), (0.92, "sufficient"), (0.72, "partial"), (0.835, "sufficient"), (0.7, "partial"), (0.35, "weak"), (0.0, "weak")]


def test_pruning_keeps_the_best_of_each_mode(spark):
    rows = [(q, m, 10 + k % 3, k) for q, m in ((1, "trace"), (2, "lookup"), (3, "bug")) for k in range(9)]
    got = evidence.prune_files(spark.createDataFrame(rows, "q long, mode string, score long, order long"), "q").collect()
    count = lambda q: sum(r["q"] == q for r in got)
    assert (count(1), count(2), count(3)) == (5, 9, 8)
    assert sorted(r["order"] for r in got if r["q"] == 1) == [1, 2, 4, 5, 8]  # three of score 12, then two of 11 by place


def test_corroboration_counts_each_family_file_once(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "file string")
    imports = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "b"), ("c", "a")], "src string, dst string")
    got = evidence.corroboration(nodes, nodes.where("file in ('a', 'b')"), imports)
    assert {tuple(r) for r in got.collect()} == {("a", 2), ("b", 2), ("c", 1), ("d", 0)}


def test_dominant_family(spark):
    terms = spark.createDataFrame([(1, "logging", 1.0), (1, "auth", 0.8), (2, "logging", 1.0), (3, "auth", 0.5), (3, "storage", 0.5)], "q long, family string, weight double")
    none = spark.createDataFrame([(3, 1, "storage", "backend", 1.0, False, False), (3, 13, "auth", "backend", 9.0, False, False)], "q long, place long, family string, layer string, score double, utility boolean, noise boolean")
    got = evidence.dominant_family(terms, none, "q", F.lit(False))
    assert {tuple(r) for r in got.collect()} == {(1, "auth"), (2, "logging"), (3, "storage")}


def test_named_family(spark):
    assert one(spark, evidence.named_family(F.lit("Upload after checkout"))) == "billing"
    assert one(spark, evidence.named_family(F.lit("authors"))) is None
