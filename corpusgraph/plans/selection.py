"""Selections and roll-ups over candidates: modes, merges, staleness, coverage, JSON fields, token savings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import quality
from ..tables import table
from .registry import query
from .retrieval import WORDS


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn FROM events GROUP BY 1, 2)
SELECT a.user_id, CASE WHEN b.n = a.n THEN 'mixed' ELSE a.event_type END AS surface FROM c a LEFT JOIN c b ON a.user_id = b.user_id AND b.rn = 2 WHERE a.rn = 1""")
def dominant_surface(spark, sf):
    """The commonest label of each key; `mixed` if two are as common."""
    n = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    best = n.groupBy("user_id").agg(F.max("n").alias("best"))
    top = n.join(best, "user_id").where("n = best").groupBy("user_id").agg(F.count("*").alias("ties"), F.min("event_type").alias("one"))
    return top.select("user_id", F.when(F.col("ties") > 1, "mixed").otherwise(F.col("one")).alias("surface"))


@query("""WITH d AS (SELECT p_brand, p_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY p_brand) AS total, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS rn FROM part GROUP BY 1, 2)
SELECT p_brand, CASE WHEN n > 0.4 * total THEN p_type ELSE 'mixed' END AS label, round(n / total, 6) AS share FROM d WHERE rn = 1""")
def dominant_label(spark, sf):
    n = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    total = n.groupBy("p_brand").agg(F.sum("n").alias("total"), F.max(F.struct("n", F.lit(0))).alias("m"), F.min_by("p_type", F.struct(-F.col("n"), "p_type")).alias("kind"))
    return total.select("p_brand", F.when(F.col("m.n") > 0.4 * F.col("total"), F.col("kind")).otherwise("mixed").alias("label"), F.round(F.col("m.n") / F.col("total"), 6).alias("share"))


@query(f"SELECT w AS term, files FROM (SELECT w, count(DISTINCT source) AS files FROM (SELECT source, unnest({WORDS}) AS w FROM documents) GROUP BY w) WHERE files >= 2")
def family_terms(spark, sf):
    """Tokens that at least two files hold."""
    d = table(spark, sf, "documents").select("source", F.explode(F.array_distinct(T.tokens(F.coalesce("text", F.lit(""))))).alias("term"))
    return d.groupBy("term").agg(F.count_distinct("source").alias("files")).where("files >= 2")


@query("SELECT o_custkey, max_by(o_orderkey, (o_totalprice, -o_orderkey)) AS best, max(o_totalprice) AS price FROM orders GROUP BY o_custkey".replace("max_by(o_orderkey, (o_totalprice, -o_orderkey))", "arg_max(o_orderkey, row(o_totalprice, -o_orderkey))"))
def max_by_key(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best"), F.max("o_totalprice").alias("price"))


@query("SELECT n_nationkey, n_name, list_position(['FRANCE', 'NATION_3', 'NATION_1', 'GERMANY'], n_name) AS place FROM nation WHERE list_contains(['FRANCE', 'NATION_3', 'NATION_1', 'GERMANY'], n_name)".replace("list_position(", "CAST(list_position(").replace(", n_name) AS place", ", n_name) AS BIGINT) AS place"))
def concept_order(spark, sf):
    """Symbols in the order of a given list."""
    wanted = F.array(*(F.lit(x) for x in ("FRANCE", "NATION_3", "NATION_1", "GERMANY")))
    return table(spark, sf, "nation").where(F.array_contains(wanted, F.col("n_name"))).select("n_nationkey", "n_name", F.array_position(wanted, F.col("n_name")).alias("place"))


@query("""SELECT id, min(pos) AS pos FROM (SELECT doc_id AS id, 0 AS pos FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 1 FROM labels WHERE quality = 0) GROUP BY id""")
def ordered_merge(spark, sf):
    """Originals first, then expansions that aren't among them."""
    l = table(spark, sf, "labels")
    both = l.where("toxic = 1").select(F.col("doc_id").alias("id"), F.lit(0).alias("pos")).union(l.where("quality = 0").select("doc_id", F.lit(1)))
    return both.groupBy("id").agg(F.min("pos").alias("pos"))


@query("""SELECT o_custkey, len(list_intersect(a, b)) > 0 AS stale FROM (SELECT o_custkey, list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'O') AS a, list(DISTINCT o_orderpriority) FILTER (o_orderstatus <> 'O') AS b FROM orders GROUP BY o_custkey) WHERE a IS NOT NULL AND b IS NOT NULL""")
def page_staleness(spark, sf):
    """Pages whose files are among the changed ones."""
    pick = lambda c: F.collect_set(F.when(c, F.col("o_orderpriority")))
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(pick(F.col("o_orderstatus") == "O").alias("a"), pick(F.col("o_orderstatus") != "O").alias("b"))
    return o.where("size(a) > 0 and size(b) > 0").select("o_custkey", F.arrays_overlap("a", "b").alias("stale"))


@query("""SELECT l_suppkey, round(utilization, 3) AS utilization, round(balance, 3) AS balance, round(0.7 * utilization + 0.3 * balance, 3) AS overall FROM (SELECT l_suppkey, (least(1 + count(*), 2000) - 1) / 1999 AS utilization,
1 - CAST(abs(count(*) FILTER (l_returnflag = 'R') - count(*) FILTER (l_returnflag <> 'R')) AS DOUBLE) / count(*) AS balance FROM lineitem GROUP BY l_suppkey)""")
def coverage_score(spark, sf):
    """How well trees of at most 2,000 nodes are filled: 0.7 of use and 0.3 of balance between callers and callees."""
    up, down = F.count_if(F.col("l_returnflag") == "R"), F.count_if(F.col("l_returnflag") != "R")
    sides = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(up.alias("up"), down.alias("down"))
    return quality.coverage(sides, 2000).select("l_suppkey", "utilization", "balance", "overall")


@query("SELECT event_id, json_extract_string(props, '$.page') AS page, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.get_json_object("props", "$.page").alias("page"), F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("""SELECT lang, round(quantile_cont(1 - least(1.0, used / CAST(greatest(base, 1) AS DOUBLE)), 0.5), 6) AS median_reduction, CAST(sum(base) AS BIGINT) AS base, CAST(sum(used) AS BIGINT) AS used
FROM (SELECT lang, CAST(ceil(length(text) / 4.0) AS BIGINT) AS base, least(CAST(ceil(length(text) / 4.0) AS BIGINT), 500) AS used FROM documents) GROUP BY lang""")
def token_savings(spark, sf):
    base = T.token_estimate(F.col("text"))
    d = table(spark, sf, "documents").select("lang", base.alias("base"), F.least(base, F.lit(500)).alias("used"))
    saved = 1 - F.least(F.lit(1.0), F.col("used") / F.greatest(F.col("base"), F.lit(1)))
    return d.groupBy("lang").agg(F.round(F.percentile(saved, 0.5), 6).alias("median_reduction"), F.sum("base").alias("base"), F.sum("used").alias("used"))


@query("SELECT a.page_id, b.page_id AS other FROM (SELECT page_id, split_part(url, '/', -1) AS base, url FROM pages) a JOIN (SELECT page_id, split_part(url, '/', -1) AS base, url FROM pages) b ON a.base = b.base AND a.page_id < b.page_id AND a.base <> ''")
def path_suffix_join(spark, sf):
    """Paths that end alike: an equi-join on the last segment."""
    p = table(spark, sf, "pages").select("page_id", T.basename(F.col("url")).alias("base")).where("base <> ''")
    return p.join(p.withColumnRenamed("page_id", "other"), "base").where("page_id < other").select("page_id", "other")


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '(^|[^a-z])(error|bug|fail|broken)') THEN 'bug' WHEN regexp_matches(lower(text), '^(how|explain|what)') THEN 'architecture' WHEN regexp_matches(lower(text), '(^|[^a-z])(where|find|show)') THEN 'lookup' WHEN length(trim(text)) < 3 THEN 'skip' ELSE 'trace' END AS mode FROM conversations""")
def rule_chain(spark, sf):
    """Ordered rules, the first that fits decides."""
    low = F.lower("text")
    mode = F.when(low.rlike("(^|[^a-z])(error|bug|fail|broken)"), "bug").when(low.rlike("^(how|explain|what)"), "architecture").when(low.rlike("(^|[^a-z])(where|find|show)"), "lookup").when(F.length(F.trim("text")) < 3, "skip").otherwise("trace")
    return table(spark, sf, "conversations").select("conv_id", "turn", mode.alias("mode"))


@query("SELECT p_partkey, p_brand, round(avg(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS smoothed FROM part")
def ring_average(spark, sf):
    w = Window.partitionBy("p_brand").orderBy("p_partkey").rowsBetween(-4, 0)
    return table(spark, sf, "part").select("p_partkey", "p_brand", F.round(F.avg("p_retailprice").over(w), 6).alias("smoothed"))
