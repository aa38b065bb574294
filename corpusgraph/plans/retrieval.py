"""Text functions, full-text and vector search, fusion, quality metrics, graphs, event windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import fusion, graph, lexical, quality
from ..tables import call_edges, chunks, links, table
from .registry import query
from .relational import CHUNKS, EDGES

SPLIT = "regexp_replace(regexp_replace({0}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: length(w) >= 1)"
NAME = "(p_name || 'FooBar_' || p_brand || '-' || p_type)"


def _name():
    return F.concat("p_name", F.lit("FooBar_"), "p_brand", F.lit("-"), "p_type")


@query(f"SELECT p_partkey, lower(regexp_replace({SPLIT.format(NAME)}, '[_\\-./]', ' ', 'g')) AS words FROM part")
def split_identifiers(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.split_identifiers(_name()).alias("words"))


@query(f"SELECT p_partkey, list_aggregate(list_filter(string_split(trim(lower(regexp_replace({SPLIT.format(NAME)}, '[^a-zA-Z0-9]+', ' ', 'g'))), ' '), lambda w: w <> ''), 'string_agg', '|') AS words FROM part")
def boundary_tokens(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(T.boundary_tokens(_name()), "|").alias("words"))


@query("SELECT page_id, list_aggregate(list_filter(list_transform(regexp_split_to_array(regexp_replace(lower(url), '[\"''`]', '', 'g'), '[^a-z0-9_./-]+'), lambda w: regexp_replace(w, '^[_./-]+|[_./-]+$', '', 'g')), lambda w: length(w) >= 2), 'string_agg', '|') AS terms FROM pages")
def query_terms(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(T.query_terms(F.col("url")), "|").alias("terms"))


VARIANTS = f"""list_distinct(list_filter([CASE WHEN w <> '' THEN w END, CASE WHEN contains(w, '_') THEN replace(w, '_', '') END, CASE WHEN suffix(w, 'ing') AND length(w) >= 4 THEN left(w, length(w) - 3) END,
CASE WHEN suffix(w, 'ing') AND length(w) >= 6 THEN left(w, length(w) - 3) || 'er' END, CASE WHEN suffix(w, 'er') AND length(w) >= 5 THEN left(w, length(w) - 2) || 'ing' END, CASE WHEN suffix(w, 'ion') AND length(w) >= 5 THEN left(w, length(w) - 3) END,
CASE WHEN suffix(w, 'ation') AND length(w) >= 6 THEN left(w, length(w) - 5) || 'ate' END, CASE WHEN length(w) >= 6 AND regexp_matches(w, '{T.SHORTENED}') THEN left(w, 4) END, CASE WHEN suffix(w, 'ies') AND length(w) >= 5 THEN left(w, length(w) - 3) || 'y' END, CASE WHEN suffix(w, 'es') AND length(w) >= 5 THEN left(w, length(w) - 2) END,
CASE WHEN suffix(w, 's') AND NOT suffix(w, 'ss') AND length(w) >= 4 THEN left(w, length(w) - 1) END], lambda v: v IS NOT NULL))"""
TERMS = f"(SELECT DISTINCT unnest({WORDS}) AS w FROM documents )"


def _terms(spark, sf):
    return table(spark, sf, "documents").select(F.explode(T.tokens(F.coalesce("text", F.lit("")))).alias("w")).distinct()


@query(f"SELECT w, list_aggregate(list_sort({VARIANTS}), 'string_agg', '|') AS variants FROM {TERMS}")
def term_variants(spark, sf):
    return _terms(spark, sf).select("w", F.array_join(F.array_sort(T.term_variants(F.col("w"))), "|").alias("variants"))


@query(f"""SELECT w, coalesce(list_aggregate(list_sort(list_distinct(list_filter([CASE WHEN suffix(w, 'ing') AND length(w) >= 6 THEN left(w, length(w) - 3) END, CASE WHEN suffix(w, 'er') AND length(w) >= 5 THEN left(w, length(w) - 2) END,
CASE WHEN suffix(w, 'er') AND length(w) >= 5 THEN left(w, length(w) - 2) || 'ing' END, CASE WHEN suffix(w, 'ion') AND length(w) >= 6 THEN left(w, length(w) - 3) END], lambda v: v IS NOT NULL))), 'string_agg', '|'), '') AS aliases FROM {TERMS}""")
def morph_aliases(spark, sf):
    return _terms(spark, sf).select("w", F.array_join(F.array_sort(T.morph_aliases(F.col("w"))), "|").alias("aliases"))


@query("SELECT p_partkey, lower(replace(p_type, ' ', '-')) AS kebab, lower(replace(p_type, ' ', '_')) AS snake, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part WHERE NOT regexp_matches(p_type, '[^A-Za-z ]')")
def case_builders(spark, sf):
    words = F.split(F.lower("p_type"), " ")
    return table(spark, sf, "part").where(~F.col("p_type").rlike("[^A-Za-z ]")).select("p_partkey", T.kebab(words).alias("kebab"), T.snake(words).alias("snake"), T.slug(F.col("p_name")).alias("slug"))


@query("SELECT doc_id, CASE WHEN length(t) > 80 THEN left(t, 77) || '...' ELSE t END AS line, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM (SELECT doc_id, text, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) AS t FROM documents)")
def one_line_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.one_line(F.col("text"), 80).alias("line"), T.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT id, split_part(file_path, '/', 1) AS top, split_part(file_path, '/', 2) AS base, regexp_replace(split_part(file_path, '/', 2), '\\.[^.]*$', '') AS stem, CAST(CASE WHEN split_part(file_path, '/', 1) = 'src1' THEN 1 ELSE 0 END AS INTEGER) AS shared FROM " + CHUNKS)
def path_parts(spark, sf):
    p = F.col("file_path")
    return chunks(spark, sf).select("id", T.top_dir(p).alias("top"), T.basename(p).alias("base"), T.stem(p).alias("stem"), T.common_prefix(p, F.lit("src1/other")).alias("shared"))


@query("SELECT o_orderkey, round(least(1.0, greatest(0.0, 1 - epoch_us(TIMESTAMP '1998-08-02') / 86400000000.0 / 90 + epoch_us(o_orderdate) / 86400000000.0 / 90)), 6) AS recency FROM orders")
def recency_decay(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.round(T.recency(F.col("o_orderdate"), F.lit("1998-08-02 00:00:00")), 6).alias("recency"))


def _subject_sql() -> str:
    parts = ", ".join(f"CASE WHEN regexp_matches(t, '{T.word_pattern(words)}') THEN '{name}' END" for name, words in T.SUBJECTS.items())
    return f"SELECT event_id, coalesce(list_aggregate(list_filter([{parts}], lambda v: v IS NOT NULL), 'string_agg', '|'), '') AS tags FROM (SELECT event_id, lower(event_type || ' check ' || props || CASE WHEN event_id % 3 = 0 THEN ' token' ELSE ' file link' END) AS t FROM events)"


@query(_subject_sql())
def subject_tags(spark, sf):
    e = table(spark, sf, "events")
    t = F.concat("event_type", F.lit(" check "), "props", F.when(F.col("event_id") % 3 == 0, " token").otherwise(" file link"))
    return e.select("event_id", F.array_join(T.labels(t, T.SUBJECTS), "|").alias("tags"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, 'th[a-z]')) AS INTEGER) AS branches, CAST(len(regexp_extract_all(text, '[.]\\n')) AS INTEGER) AS returns, len(string_split(text, chr(10))) AS lines FROM documents".replace("len(string_split(text, chr(10)))", "CAST(len(string_split(text, chr(10))) AS INTEGER)"))
def regex_features(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.regexp_count("text", F.lit("th[a-z]")).alias("branches"), F.regexp_count("text", F.lit("[.]\\n")).alias("returns"), F.size(F.split("text", "\n")).alias("lines"))


QUERY = ("ation", "enes", "ing", "oner")
BM25 = f"""(SELECT doc, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 0.000001) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / mean_len))) AS score, count(*) AS matched
FROM (SELECT doc_id AS doc, t.w AS term, count(*) AS tf, max(len(words)) AS doc_len FROM (SELECT doc_id, {WORDS} AS words FROM documents), unnest(words) AS t(w) WHERE t.w IN {QUERY} GROUP BY 1, 2) p
JOIN (SELECT w AS term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({WORDS}) AS w FROM documents) GROUP BY 1) USING (term)
CROSS JOIN (SELECT count(*) AS n, avg(len({WORDS})) AS mean_len FROM documents) GROUP BY doc)"""


def _bm25(spark, sf):
    docs = table(spark, sf, "documents")
    terms = spark.createDataFrame([(w,) for w in QUERY], "term string")
    posted = lexical.postings(docs, "doc_id", "text", terms)
    return lexical.bm25(posted, lexical.frequencies(posted), lexical.corpus_size(docs, "text"))


@query(f"SELECT doc, round(score, 6) AS score, matched FROM {BM25}")
def bm25_scores(spark, sf):
    return _bm25(spark, sf).select("doc", F.round("score", 6).alias("score"), "matched")


@query(f"SELECT doc, round(score, 6) AS score FROM {BM25} ORDER BY score DESC, doc LIMIT 50")
def bm25_topk(spark, sf):
    return lexical.top(_bm25(spark, sf).select("doc", F.round("score", 6).alias("score")), 50)


@query(f"SELECT term, df FROM (SELECT w AS term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({WORDS}) AS w FROM documents) WHERE w IN {QUERY} GROUP BY 1) WHERE df <= 0.15 * (SELECT count(*) FROM documents) ORDER BY df, term LIMIT 1")
def rarest_anchor(spark, sf):
    docs = table(spark, sf, "documents")
    posted = lexical.postings(docs, "doc_id", "text", spark.createDataFrame([(w,) for w in QUERY], "term string"))
    return lexical.rarest(lexical.frequencies(posted), lexical.corpus_size(docs, "text"))


def _stages(words: list[str]) -> str:
    has = [f"contains(x, ' {w} ')" for w in words]
    return f"""WITH s AS (SELECT doc_id AS doc, CASE WHEN contains(x, ' {' '.join(words)} ') THEN 1 WHEN {' AND '.join(has)} THEN 2 WHEN {' OR '.join(has)} THEN 3 END AS stage
FROM (SELECT doc_id, ' ' || coalesce(list_aggregate({WORDS}, 'string_agg', ' '), '') || ' ' AS x FROM documents))
SELECT doc, CAST(stage AS INTEGER) AS stage FROM s WHERE stage = (SELECT min(stage) FROM s)"""


@query(_stages(["of", "the", "ation"]))
def fts_cascade(spark, sf):
    return lexical.cascade(table(spark, sf, "documents"), "doc_id", "text", ["of", "the", "ation"])


DISTANCE = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2])))"


@query(f"SELECT b.vec_id, round({DISTANCE}, 6) AS d2, round(1 / (1 + {DISTANCE}), 6) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id = 0 ORDER BY {DISTANCE}, b.vec_id LIMIT 50")
def knn_l2_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    q = F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1))  # one query vector
    d = e.crossJoin(q).select("vec_id", T.squared_distance(F.col("embedding"), F.col("q")).alias("d"))
    return d.orderBy("d", "vec_id").limit(50).select("vec_id", F.round("d", 6).alias("d2"), F.round(T.similarity(F.col("d")), 6).alias("similarity"))


RANKED = f"(SELECT doc, row_number() OVER (ORDER BY round(score, 6) DESC, doc) AS rank FROM {BM25} ORDER BY rank LIMIT 50)"
SECOND = "(SELECT doc_id AS doc, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents ORDER BY rank LIMIT 50)"


def _lists(spark, sf):
    first = lexical.ranked(lexical.top(_bm25(spark, sf).withColumn("score", F.round("score", 6)), 50), [F.desc("score"), "doc"])
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "n_chars").orderBy(F.desc("n_chars"), "doc").limit(50)
    return first, lexical.ranked(d, [F.desc("n_chars"), "doc"])


@query(f"SELECT coalesce(a.doc, b.doc) AS doc, round(coalesce(0.5 / (60 + a.rank), 0) + coalesce(0.3 / (60 + b.rank), 0), 9) AS score FROM {RANKED} a FULL JOIN {SECOND} b ON a.doc = b.doc")
def rrf_fusion(spark, sf):
    return fusion.rrf(*_lists(spark, sf), "doc", (0.5, 0.3)).select("doc", F.round("score", 9).alias("score"))


@query(f"""SELECT doc, round(CASE WHEN lines > 80 THEN s * 80 / (lines * 0.8 + 16) ELSE s END, 9) AS score FROM (SELECT coalesce(a.doc, b.doc) AS doc, coalesce(0.5 / (60 + a.rank), 0) + coalesce(0.3 / (60 + b.rank), 0) AS s FROM {RANKED} a FULL JOIN {SECOND} b ON a.doc = b.doc)
JOIN (SELECT doc_id AS doc, len(string_split(text, chr(10))) AS lines FROM documents) USING (doc) ORDER BY 2 DESC, doc LIMIT 10""")
def hybrid_rrf(spark, sf):
    """The flagship: two rankings fused, attributes joined on for the few that are left, long ones damped, top ten."""
    fused = fusion.rrf(*_lists(spark, sf), "doc", (0.5, 0.3))
    lines = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.size(F.split("text", "\n")).alias("lines"))
    scored = lines.join(F.broadcast(fused), "doc").select("doc", F.round(fusion.length_penalty(F.col("score"), F.col("lines")), 9).alias("score"))  # 100 rows at most
    return lexical.top(scored, 10)


@query("""WITH r AS (SELECT l_linenumber - 1 AS variant, l_partkey AS doc, l_quantity AS score, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_quantity DESC, l_partkey, l_orderkey) AS rank FROM lineitem WHERE l_linenumber <= 4),
t AS (SELECT * FROM r WHERE rank <= 100), o AS (SELECT variant, doc, max(score) AS score, min(rank) AS rank FROM t GROUP BY 1, 2), b AS (SELECT variant, max(score) AS best FROM o GROUP BY 1)
SELECT doc, round(sum(greatest(0.55, 1 - 0.15 * variant) * (score / best + 0.2 / rank)) + 0.18 * (count(*) - 1), 6) AS score, count(*) AS appearances FROM o JOIN b USING (variant) GROUP BY doc""")
def variant_merge(spark, sf):
    l = table(spark, sf, "lineitem").where("l_linenumber <= 4")
    w = Window.partitionBy("l_linenumber").orderBy(F.desc("l_quantity"), "l_partkey", "l_orderkey")
    t = l.withColumn("rank", F.row_number().over(w)).where("rank <= 100")
    o = t.groupBy((F.col("l_linenumber") - 1).alias("variant"), F.col("l_partkey").alias("doc")).agg(F.max("l_quantity").alias("score"), F.min("rank").alias("rank"))
    return fusion.merge_variants(o, "doc").select("doc", F.round("score", 6).alias("score"), "appearances")


@query("""WITH RECURSIVE o AS (SELECT o_custkey AS q, o_orderkey AS k, CAST(ceil(o_totalprice / 100) AS BIGINT) AS cost, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos FROM orders),
f AS (SELECT q, k, pos, CASE WHEN cost <= 4000 THEN cost ELSE 0 END AS spent, cost <= 4000 AS taken FROM o WHERE pos = 1 UNION ALL SELECT o.q, o.k, o.pos, CASE WHEN f.spent + o.cost <= 4000 THEN f.spent + o.cost ELSE f.spent END, f.spent + o.cost <= 4000 FROM f JOIN o ON o.q = f.q AND o.pos = f.pos + 1)
SELECT q, k, spent FROM f WHERE taken""")
def greedy_budget(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("k"), "o_orderdate", F.ceil(F.col("o_totalprice") / 100).alias("cost"))
    return fusion.within_budget(o, "q", ["o_orderdate"], "k", "cost", 4000)


@query("SELECT count(*) AS files, CAST(least(6000, greatest(2000, floor(1500 + 2.5 * count(*)))) AS BIGINT) AS budget FROM documents")
def context_budget(spark, sf):
    n = F.count("*")
    return table(spark, sf, "documents").agg(n.alias("files"), F.least(F.lit(6000), F.greatest(F.lit(2000), F.floor(1500 + 2.5 * n))).cast("long").alias("budget"))


GRADED = """(SELECT lang AS q, quality * 2 + toxic AS grade, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank, count(*) FILTER (quality * 2 + toxic > 0) OVER (PARTITION BY lang) AS n_relevant FROM documents JOIN labels USING (doc_id))"""


@query(f"""WITH g AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY grade DESC, rank) AS ideal, sum(CASE WHEN grade > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY q ORDER BY rank) AS hits FROM {GRADED}),
s AS (SELECT q, sum(CASE WHEN rank <= 10 THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN ideal <= 10 THEN (pow(2, grade) - 1) / log2(ideal + 1) ELSE 0 END) AS idcg, coalesce(max(CASE WHEN grade > 0 THEN 1.0 / rank END), 0) AS mrr,
sum(CASE WHEN grade > 0 THEN hits / rank ELSE 0 END) AS ps, count(*) FILTER (rank <= 10 AND grade > 0) AS found, max(n_relevant) AS n FROM g GROUP BY q)
SELECT q, round(dcg, 6) AS dcg, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) AS ndcg, round(mrr, 6) AS mrr, round(CASE WHEN n > 0 THEN ps / n ELSE 0 END, 6) AS ap, round(found / 10.0, 6) AS p_at_k, round(CASE WHEN n > 0 THEN found / n ELSE 0 END, 6) AS r_at_k FROM s""".replace("found / 10.0", "CAST(found AS DOUBLE) / 10").replace("1.0 / rank", "1.0 / CAST(rank AS DOUBLE)"))
def retrieval_quality(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    grade = F.col("quality") * 2 + F.col("toxic")
    x = d.select(F.col("lang").alias("q"), grade.alias("grade"), F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")).alias("rank"), F.count_if(grade > 0).over(Window.partitionBy("lang")).alias("n_relevant"))
    return quality.graded_metrics(x, "q", 10)


GRAPH = "(SELECT l_suppkey * 2 AS src, l_partkey * 2 + 1 AS dst FROM lineitem)"
PAIRS = f"(SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {GRAPH} WHERE src <> dst)"
WAYS = f"(SELECT a AS u, b AS v FROM {PAIRS} UNION ALL SELECT b, a FROM {PAIRS})"
MEMBERS = f"(SELECT DISTINCT u AS id, u % 7 AS community FROM {WAYS})"


def _ends(edges):
    """The ends of edges as pairs, which may repeat, without loops."""
    return edges.where("src <> dst").toDF("a", "b")


def _members(pairs):
    return graph.ends(pairs).select("id", (F.col("id") % 7).alias("community"))


@query(f"SELECT u AS id, count(*) AS degree FROM {WAYS} GROUP BY u")
def degree(spark, sf):
    return graph.degrees(graph.undirected(links(spark, sf)))


@query(f"SELECT u AS id, count(*) AS degree FROM {WAYS} GROUP BY u ORDER BY degree DESC, id LIMIT 10")
def hubs_topk(spark, sf):
    return graph.hubs(graph.undirected(links(spark, sf)), 10)


@query(f"""SELECT community, n, coalesce(i, 0) AS inner, CASE WHEN n <= 1 THEN 1.0 ELSE round(2 * coalesce(i, 0) / (n * (n - 1)), 2) END AS cohesion FROM (SELECT community, count(*) AS n FROM {MEMBERS} GROUP BY 1)
LEFT JOIN (SELECT x.community, count(*) AS i FROM {PAIRS} p JOIN {MEMBERS} x ON p.a = x.id JOIN {MEMBERS} y ON p.b = y.id WHERE x.community = y.community GROUP BY 1) USING (community)""".replace("AS inner", 'AS "inner"'))
def cohesion(spark, sf):
    pairs = graph.undirected(links(spark, sf))
    return graph.cohesion(pairs, _members(pairs))


@query(f"SELECT x.community AS from_community, y.community AS to_community, count(*) AS n FROM {GRAPH} g JOIN {MEMBERS} x ON g.src = x.id JOIN {MEMBERS} y ON g.dst = y.id WHERE x.community <> y.community GROUP BY 1, 2")
def cross_matrix(spark, sf):
    edges = links(spark, sf)
    return graph.cross_matrix(edges, _members(_ends(edges)))


@query(f"""WITH d AS (SELECT u AS id, count(*) AS degree, u % 7 AS community, u % 3 AS dir FROM {WAYS} GROUP BY u)
SELECT a, b, score FROM (SELECT p.a, p.b, CAST((p.a + p.b) % 3 + CASE WHEN x.dir <> y.dir THEN 2 ELSE 0 END + CASE WHEN x.community <> y.community THEN 1 ELSE 0 END + CASE WHEN least(x.degree, y.degree) <= 2 AND greatest(x.degree, y.degree) >= 5 THEN 1 ELSE 0 END AS BIGINT) AS score
FROM {PAIRS} p JOIN d x ON p.a = x.id JOIN d y ON p.b = y.id WHERE x.degree <= 15 AND y.degree <= 15) WHERE score > 0""")
def surprise_edges(spark, sf):
    pairs = graph.undirected(links(spark, sf))
    nodes = graph.both_ways(pairs).select(F.col("u").alias("id"), (F.col("u") % 3).alias("dir"), (F.col("u") % 7).alias("community")).distinct()
    return graph.surprise(pairs.withColumn("resolved", (F.col("a") + F.col("b")) % 3), graph.degrees(pairs), nodes)


@query(f"""WITH RECURSIVE w AS (SELECT * FROM {WAYS}), r AS (SELECT CAST(2 AS BIGINT) AS id, 0 AS level UNION SELECT w.v, r.level + 1 FROM r JOIN w ON w.u = r.id WHERE r.level < 3) SELECT id, CAST(min(level) AS INTEGER) AS level FROM r GROUP BY id""")
def bfs_levels(spark, sf):
    ways = graph.both_ways(graph.undirected(links(spark, sf))).toDF("src", "dst")
    return graph.levels(ways, spark.createDataFrame([(2,)], "id long"), 3)


def _rounds(n: int) -> str:
    ctes = [f"w0 AS (SELECT u, v FROM {WAYS} UNION ALL SELECT DISTINCT u, u FROM {WAYS})", "l0 AS (SELECT DISTINCT u AS id, u AS community FROM w0)"]
    for k in range(1, n + 1):
        ctes.append(f"l{k} AS (SELECT u AS id, community FROM (SELECT u, community, row_number() OVER (PARTITION BY u ORDER BY count(*) DESC, community) AS rn FROM w0 JOIN l{k - 1} ON w0.v = l{k - 1}.id GROUP BY u, community) WHERE rn = 1)")
    return "WITH " + ", ".join(ctes) + f" SELECT id, community FROM l{n}"


@query(_rounds(3))
def communities_lpa(spark, sf):
    return graph.propagate(_ends(links(spark, sf)), 3)


@query("""WITH r AS (SELECT src, dst, count(*) AS w, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, dst) AS rn FROM """ + EDGES + """ GROUP BY src, dst), b AS (SELECT * FROM r WHERE rn <= 3), one AS (SELECT 2 AS parent, dst AS child FROM b WHERE src = 2)
SELECT CAST(parent AS BIGINT) AS parent, child, 1 AS level FROM one""")
def call_tree(spark, sf):
    edges = call_edges(spark, sf).groupBy("src", "dst").agg(F.count("*").alias("w"))
    return graph.bounded_tree(edges, spark.createDataFrame([(2,)], "id long"), 2, 3, F.col("w"))


@query("""SELECT user_id, epoch_us(min(ts)) AS begin_us, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def session_ttl(spark, sf):
    from ..streaming.changes import sessions

    s = sessions(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "4 hours")
    return s.select("user_id", F.unix_micros("begin").alias("begin_us"), "n")


@query("SELECT user_id, event_type AS kind, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def coalesce_last_op(spark, sf):
    from ..streaming.changes import last_operation

    return last_operation(table(spark, sf, "events"), "user_id", ["ts", "event_id"], ["event_type", "event_id"]).select("user_id", F.col("event_type").alias("kind"), "event_id")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, event_id, n, [t] AS taken, true AS allowed FROM e WHERE n = 1 UNION ALL
SELECT e.user_id, e.event_id, e.n, CASE WHEN len(list_filter(taken, lambda x: x > t - 3600000000)) < 2 THEN list_append(list_filter(taken, lambda x: x > t - 3600000000), t) ELSE list_filter(taken, lambda x: x > t - 3600000000) END,
len(list_filter(taken, lambda x: x > t - 3600000000)) < 2 FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1) SELECT event_id, allowed FROM f""")
def rate_limit(spark, sf):
    from ..streaming.changes import allowed

    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return allowed(e, "user_id", "ts", "event_id", 2, 3600)


@query("SELECT count(*) AS n, CASE WHEN count(*) = 0 THEN 'empty' WHEN max(o_orderdate) < TIMESTAMP '1998-08-03' THEN 'fresh' ELSE 'stale' END AS state FROM orders")
def freshness(spark, sf):
    return table(spark, sf, "orders").agg(F.count("*").alias("n"), F.when(F.count("*") == 0, "empty").when(F.max("o_orderdate") < F.lit("1998-08-03").cast("timestamp_ntz"), "fresh").otherwise("stale").alias("state"))


@query("SELECT page_id, coalesce(list_aggregate(list_sort(list_distinct(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1))), 'string_agg', '|'), '') AS links FROM pages")
def wiki_links(spark, sf):
    links = F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))))
    return table(spark, sf, "pages").select("page_id", F.array_join(links, "|").alias("links"))


@query("SELECT link, count(*) AS pages FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1)) AS link FROM pages) GROUP BY link")
def backlinks(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1)))).alias("link")).groupBy("link").agg(F.count("*").alias("pages"))
