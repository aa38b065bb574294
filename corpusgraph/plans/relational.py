"""Scans, predicates, joins, aggregates, windows, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import expansion
from ..operators import quality as Q
from ..tables import call_edges, chunks, memories, table
from .registry import query

CHUNKS = "(SELECT doc_id AS id, source || '/' || doc_id || '.txt' AS file_path, lang AS language, source AS name, text AS content, n_chars AS size FROM documents)"
EDGES = "(SELECT l_suppkey * 2 AS src, l_partkey * 2 + 1 AS dst, l_linenumber AS line, l_quantity AS weight, l_orderkey AS \"order\" FROM lineitem)"


@query("SELECT language, count(*) AS n FROM " + CHUNKS + " GROUP BY language")
def language_histogram(spark, sf):
    return chunks(spark, sf).groupBy("language").agg(F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM documents) AS chunks, (SELECT count(DISTINCT source) FROM documents) AS files, (SELECT count(*) FROM lineitem) AS edges")
def store_counts(spark, sf):
    c = chunks(spark, sf).agg(F.count("*").alias("chunks"), F.count_distinct("name").alias("files"))
    return c.crossJoin(call_edges(spark, sf).agg(F.count("*").alias("edges")))  # one row each


@query("SELECT id, file_path, name, language, size FROM " + CHUNKS + " WHERE size > 500")
def light_projection(spark, sf):
    return chunks(spark, sf).select("id", "file_path", "name", "language", "size").where("size > 500")


@query("SELECT id, name FROM " + CHUNKS + " WHERE id = 17")
def point_lookup(spark, sf):
    return chunks(spark, sf).where("id = 17").select("id", "name")


@query("SELECT id, language FROM " + CHUNKS + " WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def batched_lookup(spark, sf):
    return chunks(spark, sf).join(table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("id")), "id", "left_semi").select("id", "language")


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE 'par%' OR lower(p_brand) LIKE 'brand#1%'")
def prefix_match(spark, sf):
    return table(spark, sf, "part").where(F.lower("p_name").startswith("par") | F.lower("p_brand").startswith("brand#1")).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_brand, p_size FROM part WHERE p_brand = 'Brand#11' AND p_size < 10")
def file_members(spark, sf):
    return table(spark, sf, "part").where("p_brand = 'Brand#11' and p_size < 10").select("p_partkey", "p_brand", "p_size")


@query("SELECT a.p_partkey AS id, b.p_partkey AS sibling FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey")
def siblings(spark, sf):
    return expansion.pairs_within(table(spark, sf, "part"), "p_partkey", ["p_brand", "p_type", "p_size"]).select(F.col("p_partkey").alias("id"), F.col("other").alias("sibling"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_returnflag = 'R' OR l_discount >= 0.09) AND NOT (l_linestatus = 'O') AND l_quantity > 45")
def predicate_scan(spark, sf):
    return table(spark, sf, "lineitem").where(((F.col("l_returnflag") == "R") | (F.col("l_discount") >= 0.09)) & ~(F.col("l_linestatus") == "O") & (F.col("l_quantity") > 45)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT p.p_partkey AS part, l.l_suppkey AS caller, l.l_linenumber AS line FROM part p LEFT JOIN lineitem l ON l.l_partkey = p.p_partkey AND l.l_quantity >= 48")
def callers_left_join(spark, sf):
    l = table(spark, sf, "lineitem").where("l_quantity >= 48").select("l_partkey", "l_suppkey", "l_linenumber")
    p = table(spark, sf, "part").select("p_partkey")
    return p.join(l, p["p_partkey"] == l["l_partkey"], "left").select(F.col("p_partkey").alias("part"), F.col("l_suppkey").alias("caller"), F.col("l_linenumber").alias("line"))


@query("SELECT s.s_name AS caller, p.p_name AS callee, count(*) AS calls FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1, 2")
def callees_inner(spark, sf):
    l = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("calls"))
    s, p = table(spark, sf, "supplier"), table(spark, sf, "part")
    x = l.join(s, l["l_suppkey"] == s["s_suppkey"]).join(p, l["l_partkey"] == p["p_partkey"])
    return x.groupBy(F.col("s_name").alias("caller"), F.col("p_name").alias("callee")).agg(F.sum("calls").alias("calls"))


@query("""SELECT o_orderkey, o_custkey, place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, o_orderdate, o_orderkey) AS place
FROM orders WHERE o_orderstatus = 'O' OR o_orderstatus IS NULL) t WHERE place <= 2""")
def callers_exact_first(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'O' or o_orderstatus is null")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(1), "o_orderdate", "o_orderkey"))
    return o.withColumn("place", place).where("place <= 2").select("o_orderkey", "o_custkey", "place")


@query("SELECT p.p_partkey, n.n_name AS alias FROM part p JOIN nation n ON p.p_size = n.n_nationkey WHERE n.n_name IN ('FRANCE', 'GERMANY', 'JAPAN', 'NATION_1', 'NATION_2')")
def alias_join(spark, sf):
    n = table(spark, sf, "nation").where(F.col("n_name").isin("FRANCE", "GERMANY", "JAPAN", "NATION_1", "NATION_2"))
    p = table(spark, sf, "part")
    return p.join(F.broadcast(n), p["p_size"] == n["n_nationkey"]).select("p_partkey", F.col("n_name").alias("alias"))  # nations are a fixed set


@query("""SELECT o.o_orderkey AS id, coalesce(CASE WHEN l.l_returnflag = 'R' THEN 'import:' || l.l_partkey END, CASE WHEN l.l_linestatus = 'F' THEN 'same_file:' || l.l_suppkey END, 'alias:' || o.o_custkey) AS target
FROM orders o LEFT JOIN (SELECT * FROM lineitem WHERE l_linenumber = 1) l ON l.l_orderkey = o.o_orderkey""")
def resolution_cascade(spark, sf):
    """The first source that knows a target wins: import, same file, alias."""
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem").where("l_linenumber = 1")
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    target = F.coalesce(F.when(F.col("l_returnflag") == "R", name("import:", "l_partkey")), F.when(F.col("l_linestatus") == "F", name("same_file:", "l_suppkey")), name("alias:", "o_custkey"))
    return o.join(l, o["o_orderkey"] == l["l_orderkey"], "left").select(F.col("o_orderkey").alias("id"), target.alias("target"))


@query("""SELECT a.user_id, a.event_id AS outer_id, b.event_id AS inner_id FROM (SELECT user_id, event_id, CAST(value AS BIGINT) AS s, CAST(value AS BIGINT) + 5 AS e FROM events WHERE event_type = 'purchase') a
JOIN (SELECT user_id, event_id, CAST(value AS BIGINT) AS s, CAST(value AS BIGINT) + 2 AS e FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.s <= b.e AND a.e >= b.s""".replace("CAST(value AS BIGINT)", "CAST(floor(value) AS BIGINT)"))
def interval_overlap(spark, sf):
    """Intervals of one file that touch: an equi-join on the file with the range as its residue."""
    e = table(spark, sf, "events")
    start = F.floor("value").cast("long")
    a = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("outer_id"), start.alias("s1"), (start + 5).alias("e1"))
    b = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("inner_id"), start.alias("s2"), (start + 2).alias("e2"))
    return a.join(b, "user_id").where("s1 <= e2 and e1 >= s2").select("user_id", "outer_id", "inner_id")


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_deleted(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT DISTINCT l_suppkey AS importer FROM lineitem WHERE l_partkey = 7")
def reverse_imports(spark, sf):
    return table(spark, sf, "lineitem").where("l_partkey = 7").select(F.col("l_suppkey").alias("importer")).distinct()


@query("SELECT n FROM (SELECT l_suppkey AS n FROM lineitem WHERE l_partkey = 7 UNION SELECT l_partkey FROM lineitem WHERE l_suppkey = 7) WHERE n <> 7")
def import_neighbours(spark, sf):
    l = table(spark, sf, "lineitem")
    return l.where("l_partkey = 7").select(F.col("l_suppkey").alias("n")).union(l.where("l_suppkey = 7").select("l_partkey")).distinct().where("n <> 7")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3")
def top_targets(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(3)


@query("""SELECT event_type, max(n) AS n, round(avg(value), 6) AS mean, max(CASE WHEN pos = CAST(floor(n * 0.5) AS BIGINT) THEN value END) AS p50, max(CASE WHEN pos = least(CAST(floor(n * 0.95) AS BIGINT), n - 1) THEN value END) AS p95
FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type""")
def latency_percentiles(spark, sf):
    return Q.latency_summary(table(spark, sf, "events"), ["event_type"], "value")


@query("SELECT event_type, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95, min(value) AS lo, max(value) AS hi, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def endpoint_summary(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT user_id, CAST(sum(d) AS BIGINT) AS counter FROM (SELECT user_id, 1 AS d FROM events UNION ALL SELECT o_custkey, 10 FROM orders) GROUP BY user_id")
def counter_upsert(spark, sf):
    a = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("d"))
    b = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg((F.count("*") * 10).alias("d"))
    return a.union(b).groupBy("user_id").agg(F.sum("d").alias("counter"))


STYLE = "CASE WHEN regexp_matches(p_name, '^[a-z][a-zA-Z0-9]*$') THEN 'camelCase' WHEN regexp_matches(p_name, '^_?[a-z][a-z0-9_]*$') AND contains(p_name, '_') THEN 'snake_case' WHEN regexp_matches(p_name, '^[A-Z][a-zA-Z0-9]*$') THEN 'PascalCase' END"


@query(f"""SELECT p_brand, camel, snake, pascal, CASE WHEN camel + snake + pascal = 0 THEN 'mixed' WHEN camel / (camel + snake + pascal) >= 0.6 THEN 'camelCase' WHEN snake / (camel + snake + pascal) >= 0.6 THEN 'snake_case'
WHEN pascal / (camel + snake + pascal) >= 0.6 THEN 'PascalCase' ELSE 'mixed' END AS style FROM (SELECT p_brand, count(*) FILTER (s = 'camelCase') AS camel, count(*) FILTER (s = 'snake_case') AS snake, count(*) FILTER (s = 'PascalCase') AS pascal
FROM (SELECT p_brand, {STYLE.replace('p_name', "replace(replace(p_name, ' ', '_'), '#', '')")} AS s FROM part) GROUP BY p_brand)""")
def naming_majority(spark, sf):
    name = F.replace(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("#"), F.lit(""))
    return Q.majority_style(table(spark, sf, "part").select("p_brand", T.naming_style(name).alias("s")), ["p_brand"], "s")


@query("SELECT lang, round(100.0 * count(*) FILTER (n_chars > 2000) / count(*), 4) AS coverage, round(avg(n_chars), 4) AS mean_len, round(quantile_cont(n_chars, 0.5), 4) AS median_len FROM documents GROUP BY lang")
def docstring_coverage(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupBy("lang").agg(F.round(100.0 * F.count_if(F.col("n_chars") > 2000) / F.count("*"), 4).alias("coverage"), F.round(F.avg("n_chars"), 4).alias("mean_len"), F.round(F.percentile("n_chars", 0.5), 4).alias("median_len"))


@query("""SELECT l_orderkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned, bool_or(l_linestatus = 'O') AS open, bool_and(l_quantity > 5) AS large, max(l_quantity) AS most
FROM lineitem GROUP BY l_orderkey""")
def file_rollup(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum((F.col("l_returnflag") == "R").cast("int")).alias("returned"), F.bool_or(F.col("l_linestatus") == "O").alias("open"), F.bool_and(F.col("l_quantity") > 5).alias("large"), F.max("l_quantity").alias("most"))


@query("SELECT l_suppkey, count(*) AS callees, count(*) FILTER (l_shipdate >= TIMESTAMP '1996-01-01') AS recent, count(DISTINCT l_partkey) AS targets FROM lineitem GROUP BY l_suppkey")
def callee_counts(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("callees"), F.count_if(F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz")).alias("recent"), F.count_distinct("l_partkey").alias("targets"))


@query("SELECT p_brand, p_type, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_size DESC, length(p_name) DESC, p_partkey) AS rn FROM part) WHERE rn = 1")
def alias_dedupe(spark, sf):
    w = Window.partitionBy("p_brand", "p_type").orderBy(F.desc("p_retailprice"), F.desc("p_size"), F.desc(F.length("p_name")), "p_partkey")
    return table(spark, sf, "part").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("p_brand", "p_type", "p_partkey", "p_retailprice")


@query("SELECT p_brand, p_partkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn <= 24")
def alias_cap(spark, sf):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, sf, "part").withColumn("rn", F.row_number().over(w)).where("rn <= 24").select("p_brand", "p_partkey", "rn")


@query("SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 200")
def latency_ring(spark, sf):
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf, "events").withColumn("rn", F.row_number().over(w)).where("rn <= 200").select("event_type", "event_id", "value")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def newest_samples(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(1000)


@query("SELECT p_brand, p_partkey, CAST(later AS INTEGER) AS later FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) > 1 AS later FROM part)")
def diversity_order(spark, sf):
    from ..operators.fusion import diversify

    return diversify(table(spark, sf, "part"), "p_brand", "p_partkey", "p_retailprice").select("p_brand", "p_partkey", "later")


@query("""SELECT l_suppkey, l_partkey, q FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY q DESC, l_partkey) AS k FROM (SELECT * FROM (SELECT l_suppkey, l_partkey, max(l_quantity) AS q, l_returnflag, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY max(l_quantity) DESC, l_partkey) AS rn
FROM lineitem GROUP BY l_suppkey, l_partkey, l_returnflag) WHERE rn = 1)) WHERE k <= 2""")
def best_per_file(spark, sf):
    """Two stacked windows: the best caller of each file, then the best of those for each node."""
    best = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey", "l_returnflag").agg(F.max("l_quantity").alias("q"))
    one = best.withColumn("rn", F.row_number().over(Window.partitionBy("l_suppkey", "l_returnflag").orderBy(F.desc("q"), "l_partkey"))).where("rn = 1")
    return one.withColumn("k", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("q"), "l_partkey"))).where("k <= 2").select("l_suppkey", "l_partkey", "q")


@query("SELECT p_brand, p_partkey, round(p_retailprice / max(p_retailprice) OVER (PARTITION BY p_brand), 6) AS share FROM part")
def share_of_top(spark, sf):
    p = table(spark, sf, "part").select("p_brand", "p_partkey", "p_retailprice")
    return p.join(p.groupBy("p_brand").agg(F.max("p_retailprice").alias("top")), "p_brand").select("p_brand", "p_partkey", F.round(F.col("p_retailprice") / F.col("top"), 6).alias("share"))


@query("SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, max(p_retailprice) OVER (PARTITION BY p_brand) AS best FROM part) WHERE p_retailprice >= 0.85 * best")
def score_floor(spark, sf):
    from ..operators.fusion import score_floor as floor

    return floor(table(spark, sf, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], 0.85, "p_retailprice")


@query("SELECT o_custkey, max(v) AS v FROM (SELECT o_custkey, o_totalprice AS v FROM orders WHERE o_orderstatus = 'O' UNION SELECT c_custkey, c_acctbal FROM customer) GROUP BY o_custkey")
def union_max(spark, sf):
    a = table(spark, sf, "orders").where("o_orderstatus = 'O'").select("o_custkey", F.col("o_totalprice").alias("v"))
    return a.unionByName(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("v"))).groupBy("o_custkey").agg(F.max("v").alias("v"))


@query("SELECT id FROM (SELECT doc_id AS id FROM documents INTERSECT SELECT doc_id FROM labels WHERE toxic = 1) EXCEPT SELECT item_id FROM benchmark")
def set_operations(spark, sf):
    d, l, b = (table(spark, sf, t) for t in ("documents", "labels", "benchmark"))
    return d.select(F.col("doc_id").alias("id")).intersect(l.where("toxic = 1").select("doc_id")).subtract(b.select("item_id"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS rn FROM events WHERE event_type = 'error') WHERE rn % 10 = 0")
def stride_sample(spark, sf):
    """Every tenth row in order. Places come from partition counts, so no single task numbers all rows."""
    e = table(spark, sf, "events").where("event_type = 'error'").select("event_id").repartitionByRange(8, "event_id").sortWithinPartitions("event_id")
    e = e.withColumn("part", F.spark_partition_id()).withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("event_id")) - 1)
    sizes = e.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return e.join(F.broadcast(before.select("part", "before")), "part").where("(before + at) % 10 = 0").select("event_id")  # a row a partition


@query("SELECT coalesce(o.o_custkey, l.l_suppkey) AS k, CASE WHEN o.n IS NULL THEN 'added' WHEN l.n IS NULL THEN 'deleted' WHEN o.n <> l.n THEN 'modified' ELSE 'same' END AS change FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o FULL JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) l ON o.o_custkey = l.l_suppkey")
def change_detection(spark, sf):
    from ..sources.repository import changes

    old = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("hash"))
    new = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("hash"))
    return changes(old, new, "k")


@query("""SELECT id, CASE WHEN rn > 1 THEN 'superseded' WHEN class = 'episode' AND turn < 2 THEN 'archived' ELSE 'active' END AS status FROM (SELECT conv_id * 1000 + turn AS id, turn, CASE role WHEN 'system' THEN 'rule' WHEN 'user' THEN 'fact' ELSE 'episode' END AS class,
row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY turn DESC, conv_id * 1000 + turn) AS rn FROM conversations)""")
def memory_compact(spark, sf):
    w = Window.partitionBy("fingerprint").orderBy(F.desc("turn"), "id")
    m = memories(spark, sf).withColumn("rn", F.row_number().over(w))
    return m.select("id", F.when(F.col("rn") > 1, "superseded").when((F.col("class") == "episode") & (F.col("turn") < 2), "archived").otherwise("active").alias("status"))


@query("""SELECT id, round((0.6 / (60 + rank) + CASE WHEN a > 8 AND a <= 15 THEN 0 WHEN a <= 8 THEN 0.25 * least(1.0, a / 10.0) / 61 ELSE 0 END) * CASE WHEN a > 15 THEN 0.5 WHEN a > 8 THEN 0.75 ELSE 1 END + CASE class WHEN 'rule' THEN 0.08 WHEN 'fact' THEN 0.03 ELSE 0.01 END, 9) AS score
FROM (SELECT conv_id * 1000 + turn AS id, turn * 3 AS a, CASE role WHEN 'system' THEN 'rule' WHEN 'user' THEN 'fact' ELSE 'episode' END AS class, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rank FROM conversations)""")
def memory_rank(spark, sf):
    from ..operators.memory import rank_score

    m = memories(spark, sf).withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc(F.length("content")), "turn")))
    return m.select("id", F.round(rank_score(F.col("rank"), F.lit(0.0), F.col("access_count"), F.col("class"), F.lit(0.0), F.lit(1.0)), 9).alias("score"))
