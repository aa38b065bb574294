"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows that tell quotation from abuse.

The lexicon is learned from labelled texts: words, and stems (word beginnings) that occur at all or often, that toxic
documents hold and clean ones don't. Whole words lie in a trie, stems in another. A token's Levenshtein automaton runs
over them: its state is the set of (position, errors) that are still open, and a branch ends when none is. A stem is met
as soon as its letters are read. One error is allowed in words and stems of five letters or more. Each term has a chance of
abuse by how often it was hit beyond what its rate in clean texts lets expect, estimated on the training rows. Misspelled
hits have one of their own, the share of toxic ones among the distinct tokens that met the term: a new misspelling is a
new token. Tokens that clean training texts hold are no misspellings. A hit in quotation marks, or near words of reporting and none of address, counts in
part. A document's score is the noisy-or over its terms.

The classifier is fitted on at most `TRAIN_ROWS` labelled rows, those of least hash; scoring reads whole texts.

Edge cases: a null text is an empty one and scores like a text without hits; a null label isn't used; labels that
contradict each other on a doc_id all count; without toxic or clean training rows the lexicon is empty and all
score the same; a null doc_id is scored, but never trains; repeated rows each get a row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FORGET, arrow_rows, bounded, durable, prepare, texts
from .lsh import Union
from .order_minhash import SEEDS, WordHash, shingles, word_hashes

THRESHOLD = 0.7
#: Labelled rows that the classifier sees.
TRAIN_ROWS = 20_000
#: A term must have at least this share of toxic rows among those that hold it, and be in this share of toxic rows.
PRECISION, SUPPORT, LEAST_ROWS = 0.8, 0.01, 3
#: Precision from which a feature is taken for itself; classes of copies a row that a feature must be found with.
PURE, DIVERSE = 0.97, 0.3
#: Keys by which near copies among the training rows are told.
BANDS = 8
#: Distinct tokens that a worker remembers as matched or not.
SEEN = 200_000
#: Chance features that a lexicon may hold.
CHANCE = 0.3
#: Hits of a stem in a text that count as often; hits beyond which more make no difference; weight of pooled estimates.
OFTEN, MOST_HITS, POOLED = 3, 4, 4
STEM_LENGTHS = range(4, 9)
FUZZY_LENGTH = 5
WINDOW = 6
QUOTES = "\"'“”„«»‘’"
REPORTING = frozenset("said says quote quoted quotes word words term called calling wrote writes reported dit mot mots sagte wort wörter dijo palabra palabras".split())
ADDRESS = frozenset("you your yours youre du dein dir euch tu toi vous votre tú usted eres".split())
QUOTED_WEIGHT = 0.4
TOKEN = re.compile(r"[^\W_]+")


# ---------------------------------------------------------------- automaton and trie


@dataclass
class Node:
    next: dict[str, Node] = field(default_factory=dict)
    word: str | None = None


class Lexicon:
    """Words in a trie, stems by their letters; a term that ends in `*` is a stem."""

    def __init__(self, terms: list[str]):
        self.root, self.stem_root = Node(), Node()
        self.exact: dict[str, str] = {}
        self.stems: dict[str, str] = {}
        self.heads: dict[int, set[str]] = {}
        self.tails: set[tuple[int, str]] = set()
        for term in terms:
            stem, letters = term.endswith("*"), term.rstrip("*")
            (self.stems if stem else self.exact)[letters] = term
            if len(letters) < FUZZY_LENGTH:
                continue
            node = self.stem_root if stem else self.root
            for c in letters:
                node = node.next.setdefault(c, Node())
            node.word = term
            half = len(letters) // 2
            self.heads.setdefault(half, set()).add(letters[:half])
            for at in (half - 1, half, half + 1):
                self.tails.add((at, letters[half:]))
        self.tail_lengths = sorted({(at, len(x)) for at, x in self.tails})
        self.stem_lengths = sorted({len(x) for x in self.stems})

    def near(self, token: str) -> bool:
        """One error leaves one half of a term whole: whether some half stands where it could."""
        return any(token[:n] in heads for n, heads in self.heads.items()) or any((at, token[at : at + n]) in self.tails for at, n in self.tail_lengths)

    def match(self, token: str) -> tuple[str, int] | None:
        """The nearest term of a token and its errors (0 or 1)."""
        if token in self.exact:
            return self.exact[token], 0
        for n in self.stem_lengths:
            if token[:n] in self.stems:
                return self.stems[token[:n]], 0
        if len(token) < FUZZY_LENGTH - 1 or not self.near(token):
            return None
        return self.walk(self.root, self.start(token), token) or self.walk(self.stem_root, self.start(token), token)

    @staticmethod
    def start(token: str) -> frozenset[tuple[int, int]]:
        return frozenset({(0, 0), (1, 1)} if token else {(0, 0)})

    @staticmethod
    def step(state: frozenset[tuple[int, int]], c: str, token: str) -> frozenset[tuple[int, int]]:
        """The automaton of `token` within one error reads a letter of the trie: match, substitution, insertion, omission."""
        out = set()
        for i, e in state:
            if i < len(token) and token[i] == c:
                out.add((i + 1, e))
            if e == 0:
                out.add((i, 1))
                if i < len(token):
                    out.add((i + 1, 1))
                if i + 1 < len(token) and token[i + 1] == c:
                    out.add((i + 2, 1))
        return frozenset(out)

    def walk(self, node: Node, state: frozenset[tuple[int, int]], token: str) -> tuple[str, int] | None:
        if node.word and (node.word.endswith("*") or any(i == len(token) or (e == 0 and i == len(token) - 1) for i, e in state)):
            return node.word, 1
        for c, below in node.next.items():
            if (after := self.step(state, c, token)) and (found := self.walk(below, after, token)):
                return found
        return None


@dataclass
class Model:
    """chance: for (term, errors) the chance of abuse after 1, 2, ... hits; rate: each term's hits a token in clean texts;
    known: tokens that are no misspellings; base: the chance without a hit."""

    chance: dict[tuple[str, int], tuple[float, ...]]
    rate: dict[str, float] = field(default_factory=dict)
    known: frozenset[str] = frozenset()
    base: float = 0.0

    def __post_init__(self) -> None:
        self.lexicon = Lexicon(sorted({t for t, _ in self.chance}))
        self.hits: dict[str, tuple[str, int]] = {}
        self.seen: set[str] = set()

    def __reduce__(self):
        return Model, (self.chance, self.rate, self.known, self.base)

    def tokens_hit(self, tokens: set[str]) -> set[str]:
        """Those of the tokens that match a term; each distinct token meets the trie once."""
        if new := tokens - self.seen:
            if len(self.seen) > SEEN:
                self.seen, self.hits, new = set(), {}, tokens
            self.seen |= new
            for t in new:
                if (found := self.lexicon.match(t)) and not (found[1] and t in self.known):
                    self.hits[t] = found
        return tokens & self.hits.keys()

    def find(self, text: str) -> tuple[int, list[tuple[str, int, bool]]]:
        """Tokens of a text, and (term, errors, quoted) of each hit."""
        lowered = text.lower()
        tokens = TOKEN.findall(lowered)
        hit = self.tokens_hit(set(tokens))
        if not hit:
            return len(tokens), []
        out = []
        spans = [m.span() for m in TOKEN.finditer(lowered)]
        for k, t in enumerate(tokens):
            if t in hit:
                out.append((*self.hits[t], self.quoted(lowered, tokens, spans, k)))
        return len(tokens), out

    @staticmethod
    def quoted(text: str, tokens: list[str], spans: list[tuple[int, int]], k: int) -> bool:
        """Quotation marks on both sides within the window, or reporting words near and no word of address."""
        lo, hi = max(0, k - WINDOW), min(len(tokens), k + WINDOW + 1)
        before, after = text[spans[lo][0] - (spans[lo][0] > 0) : spans[k][0]], text[spans[k][1] : spans[hi - 1][1] + 1]
        mark = lambda s: any(c in QUOTES[:1] + QUOTES[2:-1] for c in s)  # noqa: E731  an apostrophe alone is no quotation
        near = set(tokens[lo:hi])
        return (mark(before) and mark(after)) or bool(near & REPORTING and not near & ADDRESS)

    def score(self, size: int, hits: list[tuple[str, int, bool]]) -> float:
        weights: Counter[tuple[str, int]] = Counter()
        for term, errors, quoted in hits:
            weights[term, errors] += QUOTED_WEIGHT if quoted else 1
        rest = 1 - self.base
        for (term, errors), weight in weights.items():
            if level := hits_beyond(weight, size, self.rate.get(term, 0)):
                rest *= 1 - self.chance[term, errors][level - 1] * min(1, weight)
        return 1 - rest


def hits_beyond(weight: float, size: int, rate: float) -> int:
    """Hits beyond those that a clean text of this size lets expect, rounded; at least 1 if one was expected of none."""
    return min(MOST_HITS, int(weight - size * rate + 0.5)) if weight >= 1 else int(size * rate < 0.5)


# ---------------------------------------------------------------- learning


def remainder(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3, F.lit(-1))


def features(text: str) -> set[str]:
    """Words; stems with one star; stems that occur often with two."""
    out: set[str] = set()
    often: Counter[str] = Counter()
    for w, n in Counter(TOKEN.findall(text.lower())).items():
        if len(w) >= 3:
            out.add(w)
            for k in STEM_LENGTHS:
                if k < len(w):
                    often[w[:k] + "*"] += n
    out.update(often)
    out.update(f + "*" for f, n in often.items() if n >= OFTEN)
    return out


def _counts(rows: DataFrame, wanted: frozenset[str] | None) -> DataFrame:
    """(feature, n): rows that hold each feature, summed within batches before they are dealt out."""

    def run(batches):
        for (bodies,) in arrow_rows(batches, "text"):
            for k in range(0, len(bodies), 500):
                seen: Counter[str] = Counter()
                for x in bodies[k : k + 500]:
                    seen.update(features(x) if wanted is None else features(x) & wanted)
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["feature", "n"])

    return rows.select("text").mapInArrow(bounded(run), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def closed(counts: dict[str, int]) -> set[str]:
    """Features of which no longer one has as many rows: `idiot` rather than `idio*`, `vequ*` rather than `veq*`."""
    best: Counter[str] = Counter()
    for f, n in counts.items():
        letters, stars = f.rstrip("*"), max(1, f.count("*"))
        for k in STEM_LENGTHS:
            if k < len(letters) or not f.endswith("*"):
                best[letters[:k] + "*" * stars] = max(best[letters[:k] + "*" * stars], n)
    return {f for f, n in counts.items() if not f.endswith("*") or best[f] < n}


def bands(text: str) -> list[int]:
    """Keys that near copies of a text are likely to share: pairs of minima over the five-word shingles of all of it."""
    mixed = shingles(word_hashes(text.lower(), WordHash()))
    minima = [int((mixed * f).min()) for f in SEEDS[: 2 * BANDS]]
    return [xxhash.xxh64_intdigest(f"{k} {x} {y}") >> 1 for k, (x, y) in enumerate(zip(minima[::2], minima[1::2], strict=True))]


def copy_classes(keys: list[list[int]]) -> list[int]:
    """A class for each text: those that share a key, directly or through others, are copies of each other."""
    first: dict[int, int] = {}
    union = Union(len(keys))
    for k, mine in enumerate(keys):
        for key in mine:
            a, b = union.find(first.setdefault(key, k)), union.find(k)
            if a != b:
                union.join(a, b)
    return [union.find(k) for k in range(len(keys))]


def surprise(c: int, d: int, share: float) -> float:
    """Chernoff exponent of finding c of c + d rows toxic when `share` of all rows are: log of 1 / chance, at least."""
    n, p = c + d, c / (c + d)
    if p <= share:
        return 0.0
    return n * (p * math.log(p / share) + (math.log((1 - p) / (1 - share)) * (1 - p) if d else 0.0))


def precise(toxic: dict[str, int], clean: dict[str, int], least: int, share: float) -> frozenset[str]:
    """Closed features that are precise and that chance doesn't explain."""
    enough = math.log(max(1, len(toxic)) / CHANCE)
    return frozenset(f for f in closed(toxic) if (c := toxic[f]) >= least and c >= PRECISION * (c + clean.get(f, 0)) and surprise(c, clean.get(f, 0), share) >= enough)


def cover(rows: list[tuple[set[str], int]], clean: dict[str, int], share: float, features: int) -> list[str]:
    """A lexicon from toxic rows (features held, class of copies), most frequent features first, clean rows
    held against them. Words that merely come along with copies of one toxic text are told by few classes of copies: a
    feature's must be many and beyond chance by themselves. Those of `PURE` precision are taken, others only if they are
    in at least `LEAST_ROWS` rows that no feature before them explains."""
    holds: dict[str, set[int]] = {}
    for k, (held, _) in enumerate(rows):
        for f in held:
            holds.setdefault(f, set()).add(k)
    enough, open_, picked = math.log(max(1, features) / CHANCE), set(range(len(rows))), set()
    for f in sorted(holds, key=lambda f: (5 * clean.get(f, 0) - len(holds[f]), f)):
        letters, mine = f.rstrip("*"), holds[f]
        distinct = len({rows[k][1] for k in mine})
        if distinct < DIVERSE * len(mine) or surprise(distinct, 0, share) < enough or any(letters[:k] + "*" in picked for k in STEM_LENGTHS):
            continue
        if len(mine) >= PURE * (len(mine) + clean.get(f, 0)) or len(mine & open_) >= LEAST_ROWS:
            picked.add(letters + "*" * f.endswith("*"))
            open_ -= mine
    return sorted(picked)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from labelled rows outside the held-out fold (crc32 of doc_id modulo 3 is 1)."""
    prepare(docs.sparkSession)
    marked = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(remainder(F.col("doc_id")) != 1)
    sample = F.broadcast(marked.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(train_rows))  # bounded by train_rows
    train = durable(texts(docs).join(sample, "doc_id").select("text", "toxic"), "train")
    sizes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Model({})
    toxic_rows, clean_rows = train.where("toxic = 1"), train.where("toxic = 0")
    least = max(LEAST_ROWS, math.ceil(SUPPORT * sizes[1]))
    toxic = {r["feature"]: r["n"] for r in _counts(toxic_rows, None).where(F.col("n") >= least).collect()}  # a hundred times the features of a training row at most
    clean = {r["feature"]: r["n"] for r in _counts(clean_rows, frozenset(toxic)).collect()}
    share = sizes[1] / (sizes[0] + sizes[1])
    wanted = precise(toxic, clean, least, share)

    def held(batches):
        for (bodies,) in arrow_rows(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array([sorted(features(x) & wanted) for x in bodies], pa.list_(pa.string())), pa.array([bands(x) for x in bodies], pa.list_(pa.int64()))], names=["held", "keys"])

    found = toxic_rows.select("text").mapInArrow(bounded(held), "held array<string>, keys array<long>").collect()  # training rows
    rows = list(zip((set(r["held"]) for r in found), copy_classes([r["keys"] for r in found]), strict=True))
    draft = Model({(t, e): (1.0,) * MOST_HITS for t in cover(rows, clean, share, len(toxic)) for e in (0, 1)})

    def hits(batches):
        for bodies, marks in arrow_rows(batches, "text", "toxic"):
            out = []
            for x, y in zip(bodies, marks, strict=True):
                tokens = TOKEN.findall(x.lower())
                hit = draft.tokens_hit(set(tokens))
                seen = Counter((t * draft.hits[t][1], *draft.hits[t]) for t in tokens if t in hit)
                out += [(len(tokens), *k, n, y) for k, n in seen.items()] or [(len(tokens), "", "", 0, 0, y)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], schema=pa.schema([("size", pa.int64()), ("token", pa.string()), ("term", pa.string()), ("errors", pa.int64()), ("n", pa.int64()), ("toxic", pa.int64())]))

    # A row for each term of each training row, which are bounded; misspellings with their token.
    found = train.select("text", "toxic").mapInArrow(bounded(hits), "size long, token string, term string, errors long, n long, toxic long")
    return calibrate(found.collect(), draft, sizes)


def calibrate(found: list, draft: Model, sizes: dict[int, int]) -> Model:
    """Chances of each term from the training rows' hits: (size, token, term, errors, n, toxic)."""
    by_token: dict[tuple[str, str], Counter[int]] = {}
    for r in found:
        if r["errors"]:
            by_token.setdefault((r["term"], r["token"]), Counter())[r["toxic"]] += 1
    known = frozenset(t for (_, t), c in by_token.items() if c[0] > c[1])
    clean_hits: Counter[str] = Counter()
    clean_tokens = 1
    for r in found:
        if not r["toxic"] and not r["errors"]:
            clean_hits[r["term"]] += r["n"]
            clean_tokens += r["size"] if not r["term"] else 0
    rate = {t: n / clean_tokens for t, n in clean_hits.items() if t}
    terms = {t for t, _ in draft.chance}
    seen: dict[str, list[list[int]]] = {t: [[0, 0] for _ in range(MOST_HITS)] for t in terms}
    pooled: dict[bool, list[list[int]]] = {s: [[0, 0] for _ in range(MOST_HITS)] for s in (False, True)}
    for r in found:
        if r["term"] and not r["errors"] and (level := hits_beyond(r["n"], r["size"], rate.get(r["term"], 0))):
            for table in (seen[r["term"]], pooled[r["term"].endswith("*")]):
                table[level - 1][r["toxic"]] += 1
    spelt, all_spelt = {t: [0, 0] for t in terms}, {s: [0, 0] for s in (False, True)}
    for (term, _), c in by_token.items():
        for table in (spelt[term], all_spelt[term.endswith("*")]):
            table[c[1] > c[0]] += 1
    chance = {}
    for term, table in seen.items():
        best, out = 0.0, []
        for (d, c), (pd, pc) in zip(table, pooled[term.endswith("*")], strict=True):
            prior = (pc + 4) / (pc + pd + 5)
            best = max(best, (c + POOLED * prior) / (c + d + POOLED))
            out.append(best)
        (d, c), (pd, pc) = spelt[term], all_spelt[term.endswith("*")]
        misspelled = (c + POOLED * (pc + 1) / (pc + pd + 2)) / (c + d + POOLED)
        chance[term, 0], chance[term, 1] = tuple(out), tuple(min(x, misspelled) for x in out)  # it tells no more than the term itself
    return Model(chance, rate, known, 0.5 / (sizes[0] + 1))


# ---------------------------------------------------------------- DataFrames

SCORED = "doc_id long, score double, hits array<struct<term: string, errors: int, quoted: boolean>>"


@lru_cache(maxsize=1)
def _worker_model(key: tuple) -> Model:
    """One model a worker, so that later tasks find its tokens matched."""
    chance, rate, known, base = key
    return Model(dict(chance), dict(rate), known, base)


def _frozen(model: Model) -> tuple:
    return tuple(sorted(model.chance.items())), tuple(sorted(model.rate.items())), model.known, model.base


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), hits: a row a document."""
    key = _frozen(model)

    def run(batches):
        found = _worker_model(key)
        for ids, bodies in arrow_rows(batches, "doc_id", "text"):
            hits = [found.find(x) for x in bodies]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([found.score(n, h) for n, h in hits], pa.float64()), pa.array([[{"term": t, "errors": e, "quoted": q} for t, e, q in h] for _, h in hits], pa.list_(pa.struct([("term", pa.string()), ("errors", pa.int32()), ("quoted", pa.bool_())])))],
                names=["doc_id", "score", "hits"],
            )

    return texts(docs).mapInArrow(bounded(run), SCORED)


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The same columns, without the documents that score `threshold` or more."""
    prepare(docs.sparkSession)
    key, place = _frozen(model), docs.columns.index("text")

    def run(batches):
        found = _worker_model(key)
        for batch in batches:
            yield batch.filter(pa.array([found.score(*found.find(x or "")) < threshold for x in batch.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(bounded(run), docs.schema)


FORGET.append(_worker_model.cache_clear)
