"""Personal data, with DataFrame functions only: patterns propose spans, checksums confirm, context adjusts the score.

Each kind has a pattern, a validity test of the matched string, a prior score, and context words that raise the score
when they stand just before the span. Spans below the threshold go. The four base kinds (email, ip, card, phone)
have priors above it, so context orders them but never removes one; `iban` (mod-97) and `ssn` are kept by checksum
or by context.

Positions are code points, end exclusive. They come from the pieces between matches: the same pattern splits the text
and extracts its matches, so lengths add up to positions.

Patterns hold possessive repeats, and look-behinds that let a match begin only where a run of its first class begins
(or where the last match ended): a run's inner starts would match in the same cases, and long runs stay linear. An IBAN
has the length of its country, so that it ends before a word or number that follows; codes that aren't in the registry
take all that could belong to one.

Edge cases: a null or empty text has no spans; a null doc_id is kept; repeated rows each get a row; matches that fail
their test are dropped without another try, and still end the search before them, as leftmost matching asks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

THRESHOLD = 0.5
CONTEXT_CHARS, CONTEXT_GAIN = 48, 0.25


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    n = F.length(_digits(match))
    return (n >= 16) & (n <= 19) & F.call_function("luhn_check", _digits(match))


def _octets(match: Column) -> Column:
    return match.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")


def _phone(match: Column) -> Column:
    return F.length(_digits(match)).between(8, 15)


def _mod97(match: Column) -> Column:
    """Country and check digits go last, letters count from 10 on; the number must leave 1 when divided by 97."""
    s = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda acc, c: F.pmod(acc * F.when(c.between("0", "9"), 10).otherwise(100) + value(c), F.lit(97))
    return F.length(s).between(15, 34) & (F.aggregate(F.split(turned, ""), F.lit(0), step) == 1)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    valid: Callable[[Column], Column]
    prior: float
    context: str
    #: Texts without this can't hold a match.
    needs: Callable[[Column], Column]


#: Characters of an IBAN by country, as the registry has them.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_BY_COUNTRY = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}+" for n, c in IBAN_LENGTHS.items())
_OTHERS = rf"(?!{'|'.join(IBAN_LENGTHS.values()).replace(' ', '|')})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}+"
LOCAL, LABEL = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
KINDS = (
    Kind("email", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++", lambda m: F.lit(True), 0.7, r"(?i)(mail|contact|write|from|to|cc)\W", lambda t: t.contains("@")),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _octets, 0.6, r"(?i)(ip|host|server|address|login)\W", lambda t: t.rlike(r"[0-9]\.[0-9]")),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", _luhn, 0.7, r"(?i)(card|visa|credit|debit|payment|karte|carte|tarjeta)\W", lambda t: t.rlike("[0-9]")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _phone, 0.6, r"(?i)(phone|tel|call|mobile|fax|whatsapp)\W", lambda t: t.contains("+")),
    Kind("iban", rf"(?<![A-Za-z0-9])(?:{_BY_COUNTRY}|{_OTHERS})(?![A-Za-z0-9])", _mod97, 0.7, r"(?i)(iban|account|konto|compte|cuenta|bank)\W", lambda t: t.rlike("[A-Z]{2}[0-9]{2}")),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda m: ~m.rlike("^(000|666|9)|-00-|-0000$"), 0.3, r"(?i)(ssn|social security)\W", lambda t: t.rlike("[0-9]-[0-9]{2}-[0-9]")),
)
BASE = ("email", "ip", "card", "phone")
SPAN = "struct<kind:string,start:int,end:int,value:string,score:double>"


def _spans(kind: Kind) -> Column:
    """Array of spans of one kind, from the columns `m_<kind>` (its matches) and `text`."""
    matches = F.col(f"m_{kind.name}")
    cut = F.zip_with(
        F.slice(F.split("text", kind.pattern, -1), F.lit(1), F.size(matches)),
        matches,
        lambda piece, match: F.struct(F.length(piece).alias("gap"), F.length(match).alias("n"), match.alias("value"), kind.valid(match).alias("ok")),
    )
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        one = F.array(F.struct(start.alias("start"), (start + x["n"]).alias("end"), x["value"].alias("value")))
        return F.struct((start + x["n"]).alias("at"), F.when(x["ok"], F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    placed = F.aggregate(cut, F.struct(F.lit(0).alias("at"), none.alias("found")), step)["found"]

    def scored(x: Column) -> Column:
        before = F.substr(F.col("text"), F.greatest(x["start"] + 1 - CONTEXT_CHARS, F.lit(1)), F.least(x["start"], F.lit(CONTEXT_CHARS)))
        score = F.round(kind.prior + F.when(F.concat(before, F.lit(" ")).rlike(kind.context), CONTEXT_GAIN).otherwise(0.0), 2)
        return F.struct(F.lit(kind.name).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), score.alias("score"))

    kept = F.filter(F.transform(placed, scored), lambda s: s["score"] >= THRESHOLD)
    return F.when(F.size(matches) > 0, kept).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def find_spans(docs: DataFrame, *kept: str) -> DataFrame:
    """doc_id and, for each kind, an array of spans {kind, start, end, value, score}, ordered by start; `text` on request."""
    none = F.expr("cast(array() as array<string>)")
    matched = texts(docs).select("doc_id", "text", *(F.when(k.needs(F.col("text")), F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0))).otherwise(none).alias(f"m_{k.name}") for k in KINDS))
    return matched.select("doc_id", *kept, *(_spans(k).alias(k.name) for k in KINDS))


def redact(docs: DataFrame) -> DataFrame:
    """doc_id, text with every span replaced by its kind in angle brackets; of overlapping spans the first one's kind
    stands for all that they cover. Nothing outside of spans changes."""
    spans = F.array_sort(F.transform(F.concat(*(k.name for k in KINDS)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc: Column, x: Column) -> Column:
        piece = F.substr(F.col("text"), acc["at"] + 1, x["start"] - acc["at"])
        more = F.concat(acc["out"], F.array(piece, F.concat(F.lit("<"), x["kind"], F.lit(">"))))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], more).otherwise(acc["out"]).alias("out"))

    whole = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(F.col("text"), acc["at"] + 1))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    return find_spans(docs, "text").select("doc_id", F.aggregate(spans, start, step, whole).alias("text"))


def _joined(*kinds: str) -> Column:
    spans = F.concat(*(F.col(k) for k in kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE), F.sha2(_joined(*BASE), 256).alias("base_sha256"), _joined(*(k.name for k in KINDS)).alias("spans"))
