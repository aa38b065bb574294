"""Surfaces, layers, tags, synonyms, matches, and the evidence of assembled contexts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import understanding as U
from ..operators import assembly, evidence
from ..tables import links, table
from .answers import RUNS
from .registry import query
from .retrieval import GRAPH

FOLDERS = ("src/pages/", "hooks/", "src/server/api/", "cli/", "mcp/", "src/daemon/", "lib/", "Middleware/", "a/views/x/", "plain/", "")
NAMES = ("useSession", "routeGuard", "HTTPHandler", "errorHelper", "mainModal", "tool_registration", "x", "saveFile")


def _sql_pick(values: tuple[str, ...], n: str) -> str:
    return f"list_extract([{', '.join(map(repr, values))}], CAST(1 + {n} % {len(values)} AS INTEGER))"


def _pick(values: tuple[str, ...], n: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.expr(n) % len(values) + 1).cast("int"))


def _words_sql(x: str) -> str:
    parted = rf"regexp_replace(regexp_replace({x}, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')"
    return f"list_filter(regexp_split_to_array(lower({parted}), '[^a-z0-9]+'), lambda w: w <> '')"


def _normal_sql(x: str) -> str:
    return f"array_to_string({_words_sql(x)}, ' ')"


def _rules_sql(rules: tuple[U.Rule, ...], otherwise: str) -> str:
    parts = []
    for r in rules:
        tests = [f"regexp_matches(p, '{r.path}')"] * bool(r.path) + [f"regexp_matches({'n' if r is U.LAYERS[1] else 't'}, '{T.word_pattern(list(r.words))}')"] * bool(r.words)
        parts.append(f"CASE WHEN {' OR '.join(tests)} THEN '{r.label}' END")
    return f"coalesce(nullif(concat_ws(',', {', '.join(parts)}), ''), '{otherwise}')"


_PLACED = f"SELECT doc_id, {_sql_pick(FOLDERS, 'doc_id')} || doc_id || '.ts' AS path, {_sql_pick(NAMES, 'doc_id')} AS name, text FROM documents"


@query(f"SELECT doc_id, {_rules_sql(U.SURFACES, 'shared')} AS surfaces FROM (SELECT doc_id, lower(path) AS p, {_normal_sql(f"path || ' ' || name || ' ' || substr(coalesce(text, ''), 1, {U.SURFACE_CHARS})")} AS t FROM ({_PLACED}))")
def execution_surfaces(spark, sf):
    path = F.concat(_pick(FOLDERS, "doc_id"), F.col("doc_id").cast("string"), F.lit(".ts"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(U.execution_surfaces(path, _pick(NAMES, "doc_id"), F.col("text")), ",").alias("surfaces"))


@query(f"SELECT event_id, {_rules_sql(U.LAYERS, 'core')} AS layers FROM (SELECT event_id, lower(path) AS p, lower(name) AS n, {_normal_sql("path || ' ' || name")} AS t FROM (SELECT event_id, {_sql_pick(FOLDERS, 'event_id')} || event_type || '.ts' AS path, {_sql_pick(NAMES, 'event_id')} AS name FROM events))")
def workflow_layers(spark, sf):
    path = F.concat(_pick(FOLDERS, "event_id"), "event_type", F.lit(".ts"))
    return table(spark, sf, "events").select("event_id", F.array_join(U.workflow_layers(path, _pick(NAMES, "event_id")), ",").alias("layers"))


#: What memories and searches of their own hold: added to turns, whose words are invented.
NOTES = ("SOC 2 audit of OAuth", "rate-limit on Redis", "a pull request for CI", "console.log in tests", "what are the security requirements", "deploy the API", "test error log", "")
_TURNS = f"SELECT conv_id, turn, coalesce(text, '') || ' ' || {_sql_pick(NOTES, '(conv_id + turn)')} AS note FROM conversations"


def _notes(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), _pick(NOTES, "conv_id + turn")).alias("note"))


def _sorted_sql(lists: list[str]) -> str:
    return f"array_to_string(list_sort(list_distinct({' || '.join(lists)})), ',')"


@query(f"SELECT conv_id, turn, {_sorted_sql([f"CASE WHEN regexp_matches(lower(note), '{p}') THEN {tags.split()} ELSE [] END" for p, tags in U.TAGS])} AS tags FROM ({_TURNS})")
def auto_tags(spark, sf):
    return _notes(spark, sf).select("conv_id", "turn", F.array_join(F.array_sort(U.auto_tags(F.col("note"))), ",").alias("tags"))


@query(f"SELECT conv_id, turn, array_to_string(list_sort(list_filter(list_distinct({' || '.join(f"CASE WHEN list_contains(ws, '{k}') THEN {v} ELSE [] END" for k, v in U.SYNONYMS.items() if len(k) >= U.SYNONYM_CHARS)}), lambda s: NOT contains(low, s))), ',') AS more FROM (SELECT conv_id, turn, lower(note) AS low, regexp_split_to_array(lower(note), '[ \\t\\r\\n]+') AS ws FROM ({_TURNS}))")
def memory_synonyms(spark, sf):
    return _notes(spark, sf).select("conv_id", "turn", F.array_join(F.array_sort(U.synonyms(F.col("note"))), ",").alias("more"))


MATCHED = ("authentication", "ation", "the", "src1", "ing")


@query(f"SELECT doc_id, CAST({' + '.join(f"contains(h, '{t[:4] if len(t) >= 6 else t}')::INTEGER" for t in MATCHED)} AS INTEGER) AS matches FROM (SELECT doc_id, regexp_replace(lower(concat_ws(' ', source, text)), '[_-]', ' ', 'g') AS h FROM documents)")
def query_match_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", U.query_matches(list(MATCHED), F.col("source"), F.col("text")).alias("matches"))


VARIANTS = ("en", "html", "example", "ation")


@query(f"SELECT page_id, v AS variant, CASE WHEN length(v) <= 4 THEN list_contains({_words_sql('url')}, v) ELSE contains(lower(url), v) END AS matches FROM pages, (SELECT unnest([{', '.join(map(repr, VARIANTS))}]) AS v)")
def variant_match(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url", F.explode(F.array(*map(F.lit, VARIANTS))).alias("variant"))
    return p.select("page_id", "variant", U.variant_matches(F.col("variant"), F.col("url")).alias("matches"))


@query(f"SELECT page_id, {_normal_sql('url')} AS target FROM pages")
def normalized_targets(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.normalized(F.col("url")).alias("target"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE coalesce(CASE WHEN event_id % 2 = 0 THEN value END, 0.5) END::DOUBLE AS vector, coalesce(CASE WHEN event_id % 5 = 0 THEN value END, 0.3)::DOUBLE AS keyword, 0.2::DOUBLE AS recency FROM events")
def weight_resolution(spark, sf):
    asked = lambda n: F.when(F.col("event_id") % n == 0, F.col("value"))
    return table(spark, sf, "events").select("event_id", U.search_weights(F.col("event_id") % 3 == 0, asked(2), asked(5), F.lit(None)).alias("w")).select("event_id", "w.*")


MODES = ("lookup", "trace", "bug", "architecture", "change", "skip")
_CONTEXTS = f"""SELECT o_orderkey, {_sql_pick(MODES, 'o_orderkey')} AS mode, CASE WHEN o_orderkey % 7 = 0 THEN 'summary_only' END AS delivery, CASE WHEN o_custkey % 2 = 0 THEN 0.7 END AS family, chunks, files, surfaces, selected
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS chunks, count(DISTINCT l_partkey) AS files, count(DISTINCT l_returnflag) AS surfaces, count(*) FILTER (l_quantity > 25) AS selected FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey"""
_CONFIDENCE = """CASE WHEN coalesce(chunks, 0) = 0 THEN 0 WHEN delivery = 'summary_only' THEN 0.35 ELSE round(least(family, CASE
WHEN mode = 'lookup' THEN 0.9
WHEN mode IN ('trace', 'bug') THEN CASE WHEN files = 1 THEN 0.62 WHEN files = 2 THEN 0.72 ELSE least(0.92, 0.78 + least(3, files - 3) * 0.04 + CASE WHEN surfaces >= 2 THEN 0.02 ELSE 0 END) END
WHEN mode IN ('architecture', 'change') THEN CASE WHEN files <= 2 THEN 0.62 WHEN files = 3 OR surfaces < 2 THEN 0.72 ELSE least(0.92, 0.78 + least(3, files - 4) * 0.035 + least(2, surfaces - 2) * 0.02) END
ELSE 0 END), 3) END::DOUBLE"""


@query(f"""SELECT o_orderkey, confidence, CASE WHEN coalesce(chunks, 0) = 0 OR delivery = 'summary_only' THEN 'weak' WHEN mode = 'lookup' THEN CASE WHEN selected >= 1 THEN 'sufficient' ELSE 'partial' END
WHEN mode IN ('trace', 'bug') THEN CASE WHEN confidence >= 0.75 THEN 'sufficient' ELSE 'partial' END
WHEN mode IN ('architecture', 'change') AND confidence >= 0.75 AND files >= 4 THEN 'sufficient' WHEN selected > 0 THEN 'partial' ELSE 'weak' END AS strength FROM (SELECT *, {_CONFIDENCE} AS confidence FROM ({_CONTEXTS}))""")
def context_strength(spark, sf):
    """Orders as contexts, their lines as chunks."""
    held = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("chunks"), F.count_distinct("l_partkey").alias("files"), F.count_distinct("l_returnflag").alias("surfaces"), F.count_if(F.col("l_quantity") > 25).alias("selected"))
    o = table(spark, sf, "orders").select("o_orderkey", _pick(MODES, "o_orderkey").alias("mode"), F.when(F.col("o_orderkey") % 7 == 0, "summary_only").alias("delivery"), F.when(F.col("o_custkey") % 2 == 0, 0.7).alias("family"))
    columns = {c: F.col(c) for c in ("mode", "delivery", "chunks", "files", "surfaces", "selected", "family")}
    x = o.join(held, "o_orderkey", "left")
    x = x.withColumn("confidence", evidence.evidence_confidence(*(columns[c] for c in ("mode", "delivery", "chunks", "files", "surfaces", "family"))))
    return x.select("o_orderkey", "confidence", evidence.context_strength(*(columns[c] for c in ("mode", "delivery", "chunks", "files", "selected")), F.col("confidence")).alias("strength"))


PICKED = ("direct_match", "mandatory_flow_step", "trace_hint")


@query(f"""SELECT l_orderkey, l_linenumber, score FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, place) AS n, CASE mode WHEN 'trace' THEN 5 WHEN 'bug' THEN 8 WHEN 'architecture' THEN 6 WHEN 'change' THEN 6 ELSE 2147483647 END AS most FROM
(SELECT l_orderkey, l_linenumber, l_linenumber - 1 AS place, {_sql_pick(MODES, 'l_orderkey')} AS mode, CAST(24 * (l_quantity % 3) + greatest(0, 18 - 2 * (l_linenumber - 1)) + list_extract([28, 46, 6], CAST(1 + l_suppkey % 3 AS INTEGER)) - CASE WHEN l_partkey % 11 = 0 THEN 100 ELSE 0 END AS BIGINT) AS score FROM lineitem)) WHERE n <= most""")
def pruned_files(spark, sf):
    """Lines as the selected files of an order."""
    l = table(spark, sf, "lineitem").withColumn("order", F.col("l_linenumber") - 1).withColumn("mode", _pick(MODES, "l_orderkey"))
    score = evidence.file_score(F.col("l_quantity") % 3, F.col("order"), _pick(PICKED, "l_suppkey"), F.col("l_partkey") % 11 == 0)
    return evidence.prune_files(l.withColumn("score", score.cast("long")), "l_orderkey").select("l_orderkey", "l_linenumber", "score")


@query(f"""WITH f AS (SELECT id FROM (SELECT src AS id FROM {GRAPH} UNION SELECT dst FROM {GRAPH}) ORDER BY id LIMIT 12), m AS (SELECT src AS file, dst AS other FROM {GRAPH} UNION SELECT dst, src FROM {GRAPH} UNION SELECT id, id FROM f)
SELECT c.file, count(f.id) AS n FROM (SELECT DISTINCT src AS file FROM {GRAPH} UNION SELECT DISTINCT dst FROM {GRAPH}) c LEFT JOIN m USING (file) LEFT JOIN f ON m.other = f.id GROUP BY c.file""")
def import_corroboration(spark, sf):
    """A family of twelve files against all."""
    edges = links(spark, sf)
    nodes = edges.select(F.col("src").alias("file")).union(edges.select("dst")).distinct()
    return evidence.corroboration(nodes, nodes.orderBy("file").limit(12), edges)


@query(f"SELECT phrase, count(*) AS pages FROM (SELECT DISTINCT item_id, phrase FROM ({RUNS})) GROUP BY phrase")
def phrase_frequency(spark, sf):
    found = table(spark, sf, "benchmark").select("item_id", F.explode(F.array_distinct(assembly.phrases(T.tokens(F.coalesce("text", F.lit("")))))).alias("phrase"))
    return found.distinct().groupBy("phrase").agg(F.count("*").alias("pages"))


LAYER = ("backend", "ui", "shared", "core")
FAMILY = ("auth", "billing", "logging", "storage", "routing")


@query(f"""SELECT l_partkey AS file, CAST(max(l_linenumber) AS INTEGER) AS anchors, array_to_string(list_sort(list(DISTINCT {_sql_pick(LAYER, 'l_suppkey')})), ',') AS layers, array_to_string(list_sort(list(DISTINCT {_sql_pick(FAMILY, 'l_orderkey')})), ',') AS families,
bool_and(l_returnflag = 'N') AS utility, bool_or(l_linestatus = 'F') AS noise, max(l_quantity) AS score FROM lineitem GROUP BY 1""")
def candidate_rollup(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("file"), F.col("l_linenumber").alias("anchors"), _pick(LAYER, "l_suppkey").alias("layer"), _pick(FAMILY, "l_orderkey").alias("family"), (F.col("l_returnflag") == "N").alias("utility"), (F.col("l_linestatus") == "F").alias("noise"), F.col("l_quantity").alias("score"))
    return evidence.file_rollup(l).withColumns({c: F.array_join(c, ",") for c in ("layers", "families")})


@query(f"""WITH v AS (SELECT o_orderkey AS query, {_sql_pick(FAMILY, 'o_custkey')} AS family, 1.5::DOUBLE AS weight, 0 AS backing FROM orders UNION ALL
SELECT l_orderkey, {_sql_pick(FAMILY, 'l_partkey')}, l_quantity * 0.15::DOUBLE, CASE WHEN l_suppkey % 4 = 0 AND l_returnflag <> 'N' AND l_linestatus <> 'F' THEN 1 ELSE 0 END FROM lineitem WHERE l_linenumber <= 12),
s AS (SELECT query, family, sum(weight) AS score, sum(backing) AS backing, count(*) OVER (PARTITION BY query) AS families FROM v GROUP BY query, family)
SELECT query, family FROM (SELECT query, family, row_number() OVER (PARTITION BY query ORDER BY round(score * CASE WHEN family = 'logging' AND families > 1 THEN 0.72::DOUBLE ELSE 1 END + CASE WHEN query % 2 = 0 THEN backing * 0.55::DOUBLE ELSE 0 END, 9) DESC, family) AS n FROM s) WHERE n = 1""")
def dominant_family(spark, sf):
    """Orders as queries, their lines as candidates, in order of their numbers."""
    terms = table(spark, sf, "orders").select(F.col("o_orderkey").alias("query"), _pick(FAMILY, "o_custkey").alias("family"), F.lit(1.5).alias("weight"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_linenumber").alias("place"), _pick(FAMILY, "l_partkey").alias("family"), _pick(LAYER, "l_suppkey").alias("layer"), F.col("l_quantity").alias("score"), (F.col("l_returnflag") == "N").alias("utility"), (F.col("l_linestatus") == "F").alias("noise"))
    return evidence.dominant_family(terms, lines, "query", F.col("query") % 2 == 0)


ASKED = ("render the invoice", "follow the upload", "nothing named", "the oauth session", "a protected route")


@query(f"SELECT event_id, CASE {' '.join(f"WHEN regexp_matches(q, '{T.word_pattern(words)}') THEN '{family}'" for family, words in evidence.NAMED)} END AS family FROM (SELECT event_id, {_sql_pick(ASKED, 'event_id')} AS q FROM events)")
def named_family(spark, sf):
    return table(spark, sf, "events").select("event_id", evidence.named_family(_pick(ASKED, "event_id")).alias("family"))
