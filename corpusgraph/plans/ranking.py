"""Field-weighted search, boosts, expansions, filters and hydration of ranked lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import expansion
from ..tables import chunks, links, memories, table
from .registry import query
from .relational import CHUNKS
from .retrieval import GRAPH

TERMS = ("ation", "enes", "ing", "src1")
FIELDS = {"name": 10.0, "file_path": 5.0, "content": 0.1}


def _fields_sql() -> str:
    words = {f: f"list_filter(regexp_split_to_array(lower(coalesce({f}, '')), '[^a-z0-9]+'), lambda w: length(w) >= 1)" for f in FIELDS}
    held = ", ".join(f"{w} AS w_{f}" for f, w in words.items())
    tf = ", ".join(" + ".join(f"{x} * len(list_filter(w_{f}, lambda w: w = '{t}'))" for f, x in FIELDS.items()) + f" AS tf_{k}" for k, t in enumerate(TERMS))
    facts = ", ".join(f"count(*) FILTER (tf_{k} > 0) AS df_{k}" for k in range(len(TERMS)))
    parts = " + ".join(f"CASE WHEN tf_{k} > 0 THEN greatest(ln((docs - df_{k} + 0.5) / (df_{k} + 0.5)), 1e-6) * tf_{k} * 2.2 / (tf_{k} + 1.2 * (0.25 + 0.75 * n / mean)) ELSE 0 END" for k in range(len(TERMS)))
    return f"""WITH h AS (SELECT id, {held} FROM {CHUNKS}), c AS (SELECT id, {" + ".join(f"len(w_{f})" for f in FIELDS)} AS n, {tf} FROM h), s AS (SELECT count(*) AS docs, avg(n) AS mean, {facts} FROM c)
SELECT id, round({parts}, 6) AS score, CAST({" + ".join(f"(tf_{k} > 0)::INTEGER" for k in range(len(TERMS)))} AS INTEGER) AS matched FROM c, s WHERE {" OR ".join(f"tf_{k} > 0" for k in range(len(TERMS)))}"""


@query(_fields_sql())
def bm25_fields(spark, sf):
    return expansion.weighted_bm25(chunks(spark, sf), "id", FIELDS, list(TERMS)).select("id", F.round("score", 6).alias("score"), "matched")


NOW = "1998-08-02 00:00:00"


@query(f"SELECT o_orderkey, round(ln(o_totalprice) + 0.2 * least(1.0, greatest(0.0, 1 - (epoch_us(TIMESTAMP '{NOW}') - epoch_us(o_orderdate)) / 86400000000.0 / 90)), 6) AS score FROM orders")
def recency_boost(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.round(expansion.recency_boost(F.log("o_totalprice"), F.col("o_orderdate"), F.lit(NOW), 0.2), 6).alias("score"))


@query(f"""WITH r AS (SELECT src AS id, CAST(count(*) AS DOUBLE) AS score FROM {GRAPH} GROUP BY src ORDER BY score DESC, id LIMIT 20), h AS (SELECT * FROM r ORDER BY score DESC, id LIMIT 10),
n AS (SELECT seed, score, id, row_number() OVER (PARTITION BY side, seed ORDER BY id) AS n FROM (SELECT DISTINCT 1 AS side, h.id AS seed, score, dst AS id FROM {GRAPH} g JOIN h ON g.src = h.id UNION ALL SELECT DISTINCT 2, h.id, score, src FROM {GRAPH} g JOIN h ON g.dst = h.id))
SELECT id, score FROM r UNION ALL SELECT id, max(score) * 0.6 FROM n WHERE n <= 5 AND id NOT IN (SELECT id FROM r) GROUP BY id""")
def graph_expansion(spark, sf):
    edges = links(spark, sf)
    ranked = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").cast("double").alias("score")).orderBy(F.desc("score"), "id").limit(20)
    return expansion.by_graph(ranked, edges)


@query(f"""WITH r AS (SELECT id, CAST(size AS DOUBLE) AS score FROM {CHUNKS} ORDER BY size DESC, id LIMIT 20), h AS (SELECT r.id AS seed, score, name AS parent FROM r JOIN {CHUNKS} c USING (id) ORDER BY score DESC, r.id LIMIT 5),
n AS (SELECT seed, score, c.id, row_number() OVER (PARTITION BY seed ORDER BY c.id) AS n FROM {CHUNKS} c JOIN h ON c.name = h.parent WHERE c.id <> seed)
SELECT id, score FROM r UNION ALL SELECT id, max(score * 0.4) FROM n WHERE n <= 5 AND id NOT IN (SELECT id FROM r) GROUP BY id""")
def sibling_expansion(spark, sf):
    c = chunks(spark, sf)
    ranked = c.select("id", F.col("size").cast("double").alias("score")).orderBy(F.desc("score"), "id").limit(20)
    return expansion.by_parent(ranked, c.select("id", F.col("name").alias("parent")))


FOLDERS = ("src/", "test/", "latest/", "examples/x/", "__tests__/", "a/spec/", "a/specs/")
NAMES = ("main.ts", "main.test.ts", "demo.py", "mydemo.py", "x.e2e.js", "spec.ts")
PATH = f"list_extract([{', '.join(map(repr, FOLDERS))}], 1 + CAST(event_id % 7 AS INTEGER)) || list_extract([{', '.join(map(repr, NAMES))}], 1 + CAST(event_id % 6 AS INTEGER))"


def _paths(spark, sf):
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % n + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", F.concat(pick(FOLDERS, 7), pick(NAMES, 6)).alias("path"), F.lit(1.0).alias("score"))


TEST = f"(regexp_matches(p, '{T.TEST_FOLDERS}') OR regexp_matches(p, '{T.TEST_ENDINGS}') OR regexp_matches(p, '{T.TEST_NAMES}'))"


@query(f"SELECT event_id, {TEST} AS test FROM (SELECT event_id, lower({PATH}) AS p FROM events)")
def test_paths(spark, sf):
    return _paths(spark, sf).select("event_id", T.is_test_path(F.col("path")).alias("test"))


@query(f"SELECT event_id, CASE WHEN {TEST} THEN 0.3 ELSE 1.0 END::DOUBLE AS score FROM (SELECT event_id, lower({PATH}) AS p FROM events)")
def test_penalty(spark, sf):
    return expansion.without_tests(_paths(spark, sf), "path").select("event_id", "score")


@query(f"SELECT event_id FROM (SELECT event_id, lower({PATH}) AS p FROM events) WHERE NOT {TEST}")
def test_exclusion(spark, sf):
    return expansion.without_tests(_paths(spark, sf), "path", "exclude").select("event_id")


@query(f"""SELECT doc_id, list_aggregate(list_filter(list_filter(list_transform(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '["''`]', '', 'g'), '[^a-z0-9_./-]+'), lambda w: regexp_replace(w, '^[_./-]+|[_./-]+$', '', 'g')), lambda w: length(w) >= 2), lambda w: w NOT IN ({', '.join(map(repr, T.STOP_WORDS))})), 'string_agg', '|') AS terms FROM documents""".replace("list_aggregate(", "coalesce(list_aggregate(", 1).replace("'string_agg', '|')", "'string_agg', '|'), '')", 1))
def salient_terms(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.salient_terms(F.coalesce("text", F.lit(""))), "|").alias("terms"))


@query("SELECT conv_id * 1000 + turn AS id, CASE WHEN role = 'system' THEN 'rule' WHEN role = 'user' THEN 'fact' ELSE 'episode' END AS class, least(1.0, turn * 3 / 10.0)::DOUBLE AS confidence FROM conversations WHERE role IN ('system', 'user') AND turn * 3 / 10.0 >= 0.25")
def memory_filters(spark, sf):
    """Memories of the classes asked for, from a least confidence on."""
    m = memories(spark, sf).withColumn("confidence", F.least(F.lit(1.0), F.col("access_count") / 10))
    return m.where(F.col("class").isin("rule", "fact") & (F.col("confidence") >= 0.25)).select("id", "class", "confidence")


@query(f"SELECT c.id, file_path, name, row_number() OVER (ORDER BY size DESC, c.id) AS place FROM {CHUNKS} c ORDER BY size DESC, c.id LIMIT 50")
def hydration(spark, sf):
    """The rows of a ranked list of ids, each with its place."""
    c = chunks(spark, sf)
    ids = c.orderBy(F.desc("size"), "id").limit(50).agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("s"), "id"))).alias("ids"))  # 50 rows
    placed = ids.select(F.posexplode("ids").alias("place", "x")).select((F.col("place") + 1).cast("long").alias("place"), F.col("x.id").alias("id"))
    return c.select("id", "file_path", "name").join(F.broadcast(placed), "id")  # 50 rows


@query(f"""WITH e AS (SELECT src, dst FROM {GRAPH}), p AS (SELECT p_partkey * 2 + 1 AS id FROM part WHERE p_size >= 10)
SELECT src, dst, CASE WHEN p.id IS NULL THEN 'unresolved' ELSE 'resolved' END AS state, count(*) AS weight FROM e LEFT JOIN p ON e.dst = p.id WHERE src <> dst GROUP BY ALL""")
def endpoint_resolution(spark, sf):
    """Edges with one row a pair of ends, counted first, and whether the target is a known node."""
    known = table(spark, sf, "part").where("p_size >= 10").select((F.col("p_partkey") * 2 + 1).alias("dst"), F.lit("resolved").alias("state"))
    pairs = links(spark, sf).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))
    return pairs.join(known, "dst", "left").select("src", "dst", F.coalesce("state", F.lit("unresolved")).alias("state"), "weight")
