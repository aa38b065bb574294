"""URL filter by a ratio of character language models, with DataFrame functions only.

Two variable-order Markov models over URL characters are fitted to the URLs that rules accept and reject. Each order's
estimate is interpolated with the next lower one by Witten-Bell smoothing, so a context counts as far as it was seen
and the longest seen context leads. A URL's score is the difference of the two log-likelihoods divided by its length.
The threshold is calibrated on a held-out fifth of the rule-decided URLs: the one of best balanced accuracy.

Characters are folded to 32 classes, so there are at most 32^4 distinct grams: that bounds the model that is broadcast.

Edge cases: a null URL, or one without `://`, has an empty host and path and is scored as it stands; an empty URL
scores 0. Without accepted or without rejected URLs the threshold is 0 and unseen models score 0: allow. Repeated rows
each get a row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

ORDER = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: 26 letters, 0 for digits, `.`, `/`, `-`, `?` for other marks of a URL, `~` for the rest; a start mark is `/`.
FOLD_FROM, FOLD_TO = UPPER + "123456789" + "_%=&#:+,;@!$'()*", LOWER + "0" * 9 + "-" + "?" * 15
MAX_GRAMS = 32 ** (ORDER + 1)
HELD_OUT = 5
BINS = 200  # a unit of score


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as `host/path`, and its verdict; null where none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:]))
    fits = lambda r: ((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2])
    pick = lambda value: reduce(lambda rest, r: F.when(fits(r), F.lit(value(r))).otherwise(rest), reversed(ordered), F.lit(None).cast("string"))
    return pick(lambda r: r[1] + r[2]), pick(lambda r: r[0])


def folded(url: Column) -> Column:
    """What the models read: the URL after `://`, in 32 classes."""
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(url)
    return F.regexp_replace(F.translate(F.coalesce(after, F.lit("")), FOLD_FROM, FOLD_TO), r"[^a-z0./?-]", "~")


def grams(seen: Column, order: int = ORDER) -> Column:
    """A gram of order + 1 classes for each character."""
    padded = F.concat(F.lit("/" * order), seen)
    return F.when(F.length(seen) > 0, F.transform(F.sequence(F.lit(1), F.length(seen)), lambda i: F.substr(padded, i, F.lit(order + 1)))).otherwise(F.expr("cast(array() as array<string>)"))


def fit(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, ratio: log P(accepted) - log P(rejected) of its last class after the ones before it.

    `counts` (gram, accepted, rejected) has every gram to be scored, with zeros where a model never saw it.
    """
    model = counts.select("gram", F.lit(1 / 32).alias("p_accepted"), F.lit(1 / 32).alias("p_rejected"))
    for k in range(order + 1):
        tail = F.substring("gram", order + 1 - k, k + 1)
        own = counts.groupBy(tail.alias("tail")).agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
        after = own.groupBy(F.substring("tail", 1, k).alias("context") if k else F.lit("").alias("context")).agg(*(f(c).alias(f"{n}_{c}") for c in ("accepted", "rejected") for n, f in (("n", F.sum), ("t", lambda c: F.count_if(F.col(c) > 0)))))
        model = (
            model.withColumn("tail", tail).withColumn("context", F.substring("tail", 1, k) if k else F.lit(""))
            .join(own, "tail").join(after, "context")
            .select("gram", *(F.when(F.col(f"n_{c}") > 0, (F.col(c) + F.col(f"t_{c}") * F.col(f"p_{c}")) / (F.col(f"n_{c}") + F.col(f"t_{c}"))).otherwise(F.col(f"p_{c}")).alias(f"p_{c}") for c in ("accepted", "rejected")))
        )
    return model.select("gram", (F.log("p_accepted") - F.log("p_rejected")).alias("ratio"))


def score(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, ruled (the rule's verdict), held_out, score; written once, whole."""
    host, path = parts(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", host.alias("host"), path.alias("path"))
    urls = urls.select("row", "page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), (F.crc32(F.coalesce("url", F.lit("")).cast("binary")) % HELD_OUT == 0).alias("held_out"), grams(folded(F.col("url"))).alias("grams"))
    learns = lambda v: F.sum(F.when((F.col("ruled") == v) & ~F.col("held_out"), 1).otherwise(0))
    counts = durable(urls.select("ruled", "held_out", F.explode("grams").alias("gram")).groupBy("gram").agg(learns("allow").alias("accepted"), learns("block").alias("rejected")), "grams")
    model = durable(fit(counts), "model")
    if (n := model.count()) > MAX_GRAMS:
        raise ValueError(f"{n} grams; {MAX_GRAMS} at most can arise")
    each = urls.select("row", F.struct("page_id", "host", "path", "rule", "ruled", "held_out").alias("page"), F.explode_outer("grams").alias("gram"))
    scored = each.join(F.broadcast(model), "gram", "left").groupBy("row").agg(F.any_value("page").alias("page"), F.coalesce(F.avg("ratio"), F.lit(0.0)).alias("score"))
    return durable(scored.select("page.*", "score"), "scores")


def threshold(scores: DataFrame) -> float:
    """The score that best separates held-out accepted from rejected URLs, to a bin; 0 if either is missing.

    At most a row for each bin in which a score falls comes to the driver; scores are bounded by the log of the
    smallest smoothed probability.
    """
    rows = scores.where("ruled is not null and held_out").groupBy(F.floor(F.col("score") * BINS).alias("bin")).agg(F.count_if(F.col("ruled") == "allow").alias("a"), F.count_if(F.col("ruled") == "block").alias("b")).orderBy("bin").collect()
    accepted, rejected = sum(r["a"] for r in rows), sum(r["b"] for r in rows)
    if not accepted or not rejected:
        return 0.0
    best, below_a, below_b, low = (-1.0, 0.0, 0.0), 0, 0, float("-inf")
    for a, b, high in [*((r["a"], r["b"], r["bin"] / BINS) for r in rows), (0, 0, float("inf"))]:
        edge = min(max(0.0, low), high)  # anything from the last score below to the first above does; nearest to 0
        best = max(best, ((accepted - below_a) / accepted + below_b / rejected, -abs(edge), edge))
        below_a, below_b, low = below_a + a, below_b + b, high + 1 / BINS
    return best[2]


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict (the rule's, else the models'), score."""
    scores = score(pages, rules)
    edge = threshold(scores)
    return scores.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= edge, "allow").otherwise("block")).alias("verdict"), "score")


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
