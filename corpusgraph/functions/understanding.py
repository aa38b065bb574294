"""What a query, a file or a memory is about: surfaces, layers, tags, synonyms, matches."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T


def identifier_tokens(text: Column) -> Column:
    """Words of an identifier, a path or a text: changes of case, `_ . : / -` and all but a-z and 0-9 separate."""
    parted = F.regexp_replace(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return T.tokens(parted)


def normalized(text: Column) -> Column:
    return F.array_join(identifier_tokens(text), " ")


@dataclass(frozen=True)
class Rule:
    """A label that a file gets by its path, or by words of its normalized text."""

    label: str
    path: str = ""
    words: tuple[str, ...] = ()

    def holds(self, path: Column, text: Column) -> Column:
        return T.any_of([path.rlike(self.path)] * bool(self.path) + [text.rlike(T.word_pattern(list(self.words)))] * bool(self.words))

    def holds_among(self, path: Column, words: Column) -> Column:
        """The same for the words of a normalized text, which are looked up; phrases stand between spaces."""
        single, phrases = [w for w in self.words if " " not in w], [w for w in self.words if " " in w]
        met = [F.arrays_overlap(words, F.array(*map(F.lit, single)))] * bool(single)
        met += [F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")).contains(f" {w} ") for w in phrases]
        return T.any_of([path.rlike(self.path)] * bool(self.path) + met)


#: Folders and words that tell where a file is executed.
SURFACES = (
    Rule("ui", r"(^|/)(pages|components|screens|views|app)/", tuple("page pages screen screens view views modal dialog component components layout ui".split())),
    Rule("routing", "middleware", tuple("route routes router routing redirect redirects callback callbacks protected guard guards navigation navigate pending destination handoff return".split())),
    Rule("state", r"(^|/)(hooks|store|stores|state|context|providers?)/", tuple("hook hooks state store stores session sessions context provider providers".split())),
    Rule("backend", r"(^|/)(api|server|controllers?|handlers?|functions?|supabase|backend)/", tuple("api endpoint endpoints request requests response responses server servers function functions handler handlers controller controllers webhook bearer header headers upload uploads bucket storage".split())),
    Rule("cli", r"(^|/)(cli|commands?)/", tuple("cli command commands terminal shell".split())),
    Rule("mcp", r"(^|/)(mcp|mcp-server)/", ("mcp", "stdio", "transport", "tool registration", "tooling bridge")),
    Rule("infra", r"(^|/)(daemon|bridge|protocol|transports?)/", tuple("daemon socket http worker scheduler runtime transport protocol bridge hook hooks".split())),
    Rule("shared", r"(^|/)(lib|shared|core|utils?|helpers?)/"),
)
#: Characters of a chunk's content that its surfaces are told by (a fixed value of the rule).
SURFACE_CHARS = 400

#: Folders and words that tell the layer of a workflow; words of `state` stand in the name alone.
LAYERS = (
    Rule("ui", r"(^|/)(pages|components|screens|views|app)/", tuple("page modal dialog screen view layout".split())),
    Rule("state", r"(^|/)(hooks|store|state|session|context|providers?)/", tuple("use[a-z] provider session state context".split())),
    Rule("routing", "", tuple("route router routing redirect callback guard protected middleware".split())),
    Rule("backend", r"(^|/)(api|server|controllers?|handlers?|functions?|supabase|backend)/", tuple("api server handler request controller service".split())),
    Rule("shared", r"(^|/)(lib|shared|core|utils?)/", tuple("error util helper type".split())),
)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), for which a row's value is made once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _labels(rules: tuple[Rule, ...], holds: list[Column], otherwise: str) -> Column:
    found = F.array_compact(F.array(*(F.when(h, r.label) for r, h in zip(rules, holds, strict=True))))
    return _once(found, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit(otherwise))))


def execution_surfaces(path: Column, name: Column, content: Column) -> Column:
    """Where a chunk is executed, of eight surfaces, in their order; `shared` if nothing tells. Nulls count as empty."""
    path, name, content = (F.coalesce(x, F.lit("")) for x in (path, name, content))
    words = identifier_tokens(F.concat_ws(" ", path, name, F.substr(content, F.lit(1), F.lit(SURFACE_CHARS))))
    return _once(words, lambda w: _labels(SURFACES, [r.holds_among(F.lower(path), w) for r in SURFACES], "shared"))


def workflow_layers(path: Column, name: Column) -> Column:
    """Layers of a workflow that a file belongs to; `core` if nothing tells. Nulls count as empty."""
    path, name = F.coalesce(path, F.lit("")), F.coalesce(name, F.lit(""))
    words = identifier_tokens(F.concat_ws(" ", path, name))
    return _once(words, lambda w: _labels(LAYERS, [r.holds(F.lower(path), F.lower(name)) if r.label == "state" else r.holds_among(F.lower(path), w) for r in LAYERS], "core"))


_B, _E = "(^|[^a-z0-9_])", "($|[^a-z0-9_])"
#: What a memory's lower-case text holds, and the tags that this gives.
TAGS = (
    (f"{_B}soc[ \\t\\r\\n]*2{_E}", "security compliance audit"),
    (f"{_B}gdpr{_E}", "security compliance privacy"),
    (f"{_B}owasp{_E}", "security vulnerability"),
    (f"{_B}jwt{_E}", "auth authentication token security"),
    (f"{_B}oauth{_E}", "auth authentication security"),
    (f"{_B}bcrypt{_E}", "auth password security encryption"),
    (f"{_B}encrypt", "security encryption"),
    (f"{_B}rate[^\\n]?limit", "performance security throttle"),
    (f"{_B}migration", "database schema"),
    (f"{_B}sql{_E}", "database query"),
    (f"{_B}redis{_E}", "database cache performance"),
    (f"{_B}pino{_E}", "logging observability"),
    (f"{_B}console[.]log{_E}", "logging"),
    (f"{_B}(ci|cd|pipeline){_E}", "deploy ci"),
    (f"{_B}deploy", "deploy release"),
    (f"{_B}linear{_E}", "tracking ticket issue"),
    (f"{_B}jira{_E}", "tracking ticket issue"),
    (f"{_B}grafana{_E}", "monitoring observability dashboard"),
    (f"{_B}latency{_E}", "performance monitoring"),
    (f"{_B}test", "testing"),
    (f"{_B}mock", "testing mock"),
    (f"{_B}integration{_E}", "testing integration"),
    (f"{_B}(pr{_E}|pull[^\\n]?request)", "review pr workflow"),
    (f"{_B}feature[^\\n]?flag", "deploy release feature"),
)


def _begins(pattern: str) -> list[str]:
    """Letters that whatever a pattern of TAGS matches begins with: a text without any of them needn't be matched."""
    return re.findall(r"(?:^|\|)\(?([a-z]+)", pattern.removeprefix(_B).replace(_E, ""))


def auto_tags(text: Column) -> Column:
    """Tags that a memory's text gives, each once, in the rules' order; none for null."""

    def found(low: Column) -> Column:
        hits = (T.any_of([low.contains(b) for b in _begins(p)]) & low.rlike(p) for p, _ in TAGS)
        return F.array_distinct(F.flatten(F.array_compact(F.array(*(F.when(h, F.array(*map(F.lit, tags.split()))) for h, (_, tags) in zip(hits, TAGS, strict=True))))))

    return _once(F.lower(F.coalesce(text, F.lit(""))), found)


#: Words that a search in memories takes as well.
SYNONYMS = {
    "security": ["compliance", "encryption", "audit", "vulnerability", "auth"],
    "test": ["testing", "spec", "coverage", "mock", "integration"],
    "testing": ["test", "spec", "coverage", "mock", "integration"],
    "error": ["exception", "throw", "catch", "fault", "failure"],
    "log": ["logging", "logger", "pino", "console"],
    "logging": ["log", "logger", "pino", "console"],
    "style": ["convention", "format"],
    "convention": ["style", "format"],
    "track": ["tracking", "ticket", "issue", "jira", "linear"],
    "bug": ["issue", "defect", "error", "fault"],
    "deploy": ["deployment", "release", "ship", "publish"],
    "auth": ["authentication", "authorization", "login", "session", "token", "security"],
    "performance": ["latency", "speed", "optimization", "profiling", "benchmark"],
    "database": ["db", "sql", "query", "migration", "schema"],
    "api": ["endpoint", "route", "handler", "request", "response"],
    "pr": ["pull request", "review", "merge", "branch"],
}
#: Characters that a word of a query has at least, to have synonyms (a fixed value).
SYNONYM_CHARS = 3


def synonyms(query: Column) -> Column:
    """Synonyms of a query's words that the query doesn't hold yet, in order of its words, each once; none for null."""
    low = F.lower(F.coalesce(query, F.lit("")))
    known = F.create_map(*(x for k, v in SYNONYMS.items() if len(k) >= SYNONYM_CHARS for x in (F.lit(k), F.array(*map(F.lit, v)))))
    more = F.flatten(F.transform(F.filter(F.split(low, "[ \\t\\r\\n]+"), lambda w: F.map_contains_key(known, w)), lambda w: F.element_at(known, w)))
    return F.filter(F.array_distinct(more), lambda s: ~F.contains(low, s))


def query_matches(terms: list[str], *texts: Column) -> Column:
    """How many of the lower-case terms stand in the texts, or of those of six characters or more their first four."""
    hay = F.regexp_replace(F.lower(F.concat_ws(" ", *texts)), "[_-]", " ")
    return sum((hay.contains(t[:4] if len(t) >= 6 else t).cast("int") for t in terms), F.lit(0))


def variant_matches(variant: Column, text: Column) -> Column:
    """A variant of up to four characters must be a token of the text; a longer one may stand anywhere."""
    return F.when(F.length(variant) <= 4, F.array_contains(T.boundary_tokens(text), variant)).otherwise(F.contains(F.lower(text), variant))


def search_weights(keyword_mode: Column, vector: Column, keyword: Column, recency: Column) -> Column:
    """Weights of a search: asked for or 0.5, 0.3 and 0.2 (fixed values); without vectors in keyword mode."""
    own = F.when(keyword_mode, 0.0).otherwise(F.coalesce(vector, F.lit(0.5)))
    return F.struct(own.alias("vector"), F.coalesce(keyword, F.lit(0.3)).alias("keyword"), F.coalesce(recency, F.lit(0.2)).alias("recency"))
