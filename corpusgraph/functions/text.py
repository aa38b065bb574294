"""Text and path functions on columns; ASCII rules, so every engine agrees on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _camel(text: Column) -> Column:
    text = F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")
    return F.regexp_replace(text, "([A-Z]+)([A-Z][a-z])", "$1 $2")


def split_identifiers(text: Column) -> Column:
    """`saveFlowToDb`, `save_flow-to.db` -> words with single separators turned into spaces, lower case."""
    return F.lower(F.regexp_replace(_camel(text), r"[_\-./]", " "))


def boundary_tokens(text: Column) -> Column:
    """Words of an identifier or text: case changes and anything but letters and digits separate."""
    plain = F.trim(F.lower(F.regexp_replace(_camel(text), "[^a-zA-Z0-9]+", " ")))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def tokens(text: Column, least: int = 1) -> Column:
    """Lower-case runs of a-z and 0-9 of at least `least` characters."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) >= least)


def query_terms(text: Column) -> Column:
    """Terms of a query: quotes go, `_ . / -` stay inside a term and are trimmed at its ends, two characters at least."""
    plain = F.regexp_replace(F.lower(text), "[\"'`]", "")
    trimmed = F.transform(F.split(plain, "[^a-z0-9_./-]+"), lambda w: F.regexp_replace(w, "^[_./-]+|[_./-]+$", ""))
    return F.filter(trimmed, lambda w: F.length(w) >= 2)


def _some(*pairs: tuple[Column, Column]) -> Column:
    return F.array_distinct(F.array_compact(F.array(*(F.when(c, v) for c, v in pairs))))


def _cut(word: Column, n: int) -> Column:
    return F.substr(word, F.lit(1), F.length(word) - n)


#: Endings (fixed values) of terms that code shortens to four letters: authentication, auth.
SHORTENED = "(tion|sion|ment|ance|ence|ality|ity|ing|izer|iser|able|ible)$"


def term_variants(term: Column) -> Column:
    """Forms under which a query term may stand in code: without underscores, other endings, singular."""
    w = F.trim(F.lower(term))
    ends = lambda s, n: w.endswith(s) & (F.length(w) >= n)
    return _some(
        (w != "", w),
        (w.contains("_"), F.replace(w, F.lit("_"), F.lit(""))),
        (ends("ing", 4), _cut(w, 3)),
        (ends("ing", 6), F.concat(_cut(w, 3), F.lit("er"))),
        (ends("er", 5), F.concat(_cut(w, 2), F.lit("ing"))),
        (ends("ion", 5), _cut(w, 3)),
        (ends("ation", 6), F.concat(_cut(w, 5), F.lit("ate"))),
        ((F.length(w) >= 6) & w.rlike(SHORTENED), F.substr(w, F.lit(1), F.lit(4))),
        (ends("ies", 5), F.concat(_cut(w, 3), F.lit("y"))),
        (ends("es", 5), _cut(w, 2)),
        (ends("s", 4) & ~w.endswith("ss"), _cut(w, 1)),
    )


def morph_aliases(token: Column) -> Column:
    """Stems of -ing, -er and -ion words, and -ing for -er."""
    w = F.lower(token)
    ends = lambda s, n: w.endswith(s) & (F.length(w) >= n)
    return _some((ends("ing", 6), _cut(w, 3)), (ends("er", 5), _cut(w, 2)), (ends("er", 5), F.concat(_cut(w, 2), F.lit("ing"))), (ends("ion", 6), _cut(w, 3)))


def kebab(words: Column) -> Column:
    return F.array_join(words, "-")


def snake(words: Column) -> Column:
    return F.array_join(words, "_")


def camel(words: Column) -> Column:
    upper = F.transform(words, lambda w, i: F.when(i == 0, w).otherwise(F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2)))))
    return F.array_join(upper, "")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def one_line(text: Column, most: int) -> Column:
    """White space collapsed; cut to `most` characters, the last three of them dots."""
    flat = F.trim(F.regexp_replace(text, "[ \\t\\r\\n]+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substr(flat, F.lit(1), F.lit(most - 3)), F.lit("..."))).otherwise(flat)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def top_dir(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def common_prefix(a: Column, b: Column) -> Column:
    """Leading path segments that two paths share."""
    same = F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + (s["on"] & x).cast("int")).alias("n"), (s["on"] & x).alias("on")))["n"]


def recency(at: Column, as_of: Column, days: float = 90) -> Column:
    """1 for now, falling to 0 after `days`; null for a missing time."""
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 86_400_000_000
    return F.when(age.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - age / days)))


def similarity(squared: Column) -> Column:
    """1 / (1 + squared distance); 0 if it isn't finite."""
    fine = squared.isNotNull() & ~F.isnan(squared) & (squared < float("inf"))
    return F.when(fine, 1 / (1 + squared)).otherwise(0.0)


def squared_distance(a: Column, b: Column) -> Column:
    diff = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y))
    return F.aggregate(diff, F.lit(0.0), lambda s, x: s + x)


def word_pattern(words: list[str]) -> str:
    """Any of some words or phrases, not within a longer run of letters, digits or underscores."""
    return f"(^|[^A-Za-z0-9_])({'|'.join(words)})($|[^A-Za-z0-9_])"


def labels(text: Column, rules: dict[str, list[str]]) -> Column:
    """Names of the rules of which a word stands in the text, in the rules' order."""
    return F.array_compact(F.array(*(F.when(F.lower(text).rlike(word_pattern(words)), name) for name, words in rules.items())))


#: Words that tag a chunk's subject.
SUBJECTS = {
    "auth": ["auth", "login", "signin", "signout", "oauth", "session", "token", "credential"],
    "routing": ["route", "router", "redirect", "navigation", "callback", "protected"],
    "billing": ["billing", "checkout", "subscription", "invoice", "payment", "credit", "portal", "stripe"],
    "storage": ["storage", "upload", "bucket", "media", "file", "signed url", "blob"],
    "generation": ["generate", "generation", "image", "render", "queue", "worker", "thumbnail", "preview"],
    "validation": ["validate", "validation", "check", "assert", "verify", "guard"],
    "permissions": ["permission", "role", "policy", "allow", "deny", "reject", "protect"],
    "connection": ["connect", "connection", "edge", "handle", "link"],
    "schema": ["schema", "compat", "compatible", "type matrix"],
}


#: Folders, endings and file names (fixed values) that mark tests and samples.
TEST_FOLDERS = "(^|/)(test|tests|spec|__tests__|__fixtures__|fixtures|benchmark|examples|e2e|cypress|playwright|integration)/"
TEST_ENDINGS = r"[.](test|spec|e2e)[.][^.]+$"
TEST_NAMES = r"(^|/)(benchmark|demo)[.][^/]+$"


def is_test_path(path: Column) -> Column:
    """Whether a file lies in a test folder, ends like a test, or is a benchmark or demo."""
    low = F.lower(path)
    return low.rlike(TEST_FOLDERS) | low.rlike(TEST_ENDINGS) | low.rlike(TEST_NAMES)


#: Words (fixed values) that queries are searched without.
STOP_WORDS = (
    "the is are was were be been being have has had do does did will would could should may might shall can need dare ought used to "
    "of in for on with at by from as into through during before after above below between out off over under again further then once "
    "here there when where why how all each every both few more most other some such no nor not only own same so than too very just "
    "because but and if or while about what which who whom this that these those am an a it its my your his her our their return list"
).split()


def salient_terms(text: Column) -> Column:
    """The terms of a query without stop words."""
    return F.filter(query_terms(text), lambda w: ~w.isin(*STOP_WORDS))


def naming_style(name: Column) -> Column:
    """camelCase, snake_case or PascalCase of one name; null for others."""
    return F.when(name.rlike("^[a-z][a-zA-Z0-9]*$"), "camelCase").when(name.rlike("^_?[a-z][a-z0-9_]*$") & name.contains("_"), "snake_case").when(name.rlike("^[A-Z][a-zA-Z0-9]*$"), "PascalCase")


def matches_term(text: Column, term: Column) -> Column:
    """Whether a variant of the term is a token of the text, or, with eight characters or more, stands in its compact form."""
    words = boundary_tokens(text)
    compact = F.array_join(words, "")
    return F.exists(term_variants(term), lambda v: F.array_contains(words, v) | ((F.length(F.regexp_replace(v, "[^a-z0-9]+", "")) >= 8) & F.contains(compact, F.regexp_replace(v, "[^a-z0-9]+", ""))))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
