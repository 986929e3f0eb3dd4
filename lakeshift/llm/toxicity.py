"""Toxicity by a weighted finite-state pattern grammar over clauses.

Small transducers read a text's words and are composed into one machine, a product of their states:

* *insult*: a character automaton over word beginnings and whole words, whose arcs and weights are learned from labels
  (weight: log odds of a toxic document, given the match);
* *threat* and *target* (words that address or name a person), *negation* (holds for the next
  ``SCOPE`` words) and *reported speech* (a verb of saying or an opening quote; holds to the end of the clause or quote).

Every clause (up to ``. ! ? ; :`` or a line break) gives at most one weighted match per core, marked with what was open
around it: plain, at a target, negated, or reported.  A document is scored from its matched clauses by a logistic
model of their weights, never from isolated words alone: the same word weighs differently
in the four kinds of clause, as the labels have it.

Learning uses at most ``MAX_TRAIN`` labelled documents (those with the least hash of their id), broadcast as ids, so
only these are shuffled, to count each distinct text once; an entry is learned if more toxic texts hold it than chance gives,
however small a part of all toxic ones they are.  Everything else reads every document and its whole text once.
Neither labels nor ``lang``, ``source`` or ``doc_id`` enter a score.

Defined results: null and empty texts have no clause and score the model's base rate; without labels of both kinds nothing is
learned and the score comes from the fixed threat words alone; conflicting labels of one id count as toxic; rows
that repeat an id are all scored; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of

MAX_TRAIN = 12_000
#: Learned entries: least toxic texts that hold one; least smoothed share of toxic texts.
LEAST_SUPPORT, LEAST_SHARE = 4, 0.55
PREFIXES = range(3, 9)
SCOPE = 3
THRESHOLD = 0.3
#: Fixed word lists (English, German, French, Spanish).
THREATS = frozenset("kill murder hurt stab shoot strangle destroy töten umbringen verletzen tuer frapper poignarder matar golpear".split())
TARGETS = frozenset("you your yours yourself u du dich dir dein euch ihr tu toi te ton vous votre vos ti tú usted ustedes vosotros he she they him her them".split())
NEGATIONS = frozenset("not no never none nobody nothing neither nor cannot don't isn't aren't nicht kein keine keiner nie niemals pas jamais aucun aucune ne nunca jamás ningún ninguna".split())
REPORTS = frozenset("said says say saying told tells wrote writes called calls quoted reported sagte sagt schrieb nannte dit disait écrit appelle dijo dice escribió llamó".split())
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;:\n]|[\"“”„«»]")
WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
CUT = frozenset(".!?;:\n")
QUOTES = frozenset("\"“”„«»")
KINDS = ("plain", "target", "negated", "reported")
FEATURES = [f"insult_{k}" for k in KINDS] + [f"threat_{k}" for k in KINDS] + ["strongest", "sum"]


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id's digits modulo 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Grammar:
    """The composed transducers; ``lexicon`` maps ``^beginning`` and ``^word$`` to weights."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.memory: dict[str, float] = {}

    def insult(self, word: str) -> float:
        """Weight of the longest known beginning of a word, or of the whole word; 0 if none."""
        known = self.memory.get(word)
        if known is None:
            if len(self.memory) > 500_000:
                self.memory.clear()
            known = self.lexicon.get(f"^{word}$", 0.0)
            for n in reversed(PREFIXES):
                if known:
                    break
                if n <= len(word):
                    known = self.lexicon.get("^" + word[:n], 0.0)
            self.memory[word] = known
        return known

    def features(self, text: str | None) -> np.ndarray:
        """Per core and kind, log(1 + matched clauses); the strongest weight; log(1 + sum of weights)."""
        f = np.zeros(len(FEATURES))
        low = (text or "").lower()
        cores = {w for w in set(WORDS.findall(low)) if self.insult(w) or w in THREATS}
        if not cores:
            return f
        total = 0.0
        negated = 0
        reported = quoted = target = False
        found: dict[tuple[int, int], float] = {}

        def end_clause() -> None:
            nonlocal total
            for (core, kind), weight in found.items():
                kind = 1 if kind == 0 and target else kind
                f[4 * core + kind] += 1
                total += weight
            found.clear()

        for token in TOKEN.findall(low):
            if token in CUT:
                end_clause()
                negated, reported, target = 0, quoted, False
            elif token in QUOTES:
                quoted = not quoted
                reported = reported or quoted
            elif token in cores:
                kind = 3 if reported else 2 if negated else 0
                if weight := self.insult(token):
                    found[0, kind] = max(found.get((0, kind), 0.0), weight)
                    f[8] = max(f[8], weight)
                if token in THREATS:
                    found[1, kind] = max(found.get((1, kind), 0.0), 1.0)
                negated = max(0, negated - 1)
            else:
                negated = SCOPE if token in NEGATIONS else max(0, negated - 1)
                reported = reported or token in REPORTS
                target = target or token in TARGETS
        end_clause()
        f[:8] = np.log1p(f[:8])
        f[9] = math.log1p(total)
        return f


def _entries(text: str | None) -> set[str]:
    out = set()
    for w in set(WORDS.findall((text or "").lower())):
        out.add(f"^{w}$")
        out.update("^" + w[:n] for n in PREFIXES if n <= len(w))
    return out


def _count_entries(candidates):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()
        for rows in batches:
            for text in rows.text:
                entries = _entries(text)
                counts.update(entries if candidates is None else entries & candidates.value)
        entries, n = list(counts), list(counts.values())
        for i in range(0, len(entries), 20_000):
            yield pd.DataFrame({"entry": entries[i : i + 20_000], "n": n[i : i + 20_000]})

    return run


def learn_lexicon(train: DataFrame) -> dict[str, float]:
    """Weighted beginnings and words from rows ``text, toxic``."""
    spark = train.sparkSession
    sizes = {r.toxic: r.n for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return {}
    of = lambda label, some: train.filter(F.col("toxic") == label).select("text").mapInPandas(_count_entries(some), "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))
    toxic = {r.entry: r.n for r in of(1, None).filter(F.col("n") >= LEAST_SUPPORT).collect()}  # of at most MAX_TRAIN texts
    names = spark.sparkContext.broadcast(frozenset(toxic))
    clean = {r.entry: r.n for r in of(0, names).collect()}
    base = sizes[1] / (sizes[0] + sizes[1])
    return choose_entries({e: n for e, n in toxic.items() if reliable(n, clean.get(e, 0), base, len(toxic))}, clean, base)


def reliable(n: int, m: int, base: float, candidates: int) -> bool:
    """Whether ``n`` toxic and ``m`` clean texts are more than chance at the base rate gives any of so many entries (Chernoff's bound)."""
    part = n / (n + m)
    if part <= base:
        return False
    rest = (1 - part) * math.log((1 - part) / (1 - base)) if m else 0.0
    return (n + m) * (part * math.log(part / base) + rest) >= math.log(candidates)


def choose_entries(toxic: dict[str, int], clean: dict[str, int], base: float) -> dict[str, float]:
    """Weights of the entries worth keeping, from the toxic and clean documents that hold them."""
    smooth = lambda n, m: (n + 3 * base) / (n + m + 3)
    share = {e: smooth(n, clean.get(e, 0)) for e, n in toxic.items()}
    shorter = lambda e, among: [e[: n + 1] for n in PREFIXES if n + 1 < len(e) and e[: n + 1] in among]
    kept: dict[str, float] = {}
    for entry in sorted(share, key=lambda e: (len(e), e)):
        if share[entry] >= LEAST_SHARE and share[entry] > max((kept[s] for s in shorter(entry, kept)), default=0.0) + 0.01:
            kept[entry] = share[entry]
    # a beginning stays only if it has something to say of words that its kept continuations do not have
    below: dict[str, list[str]] = {}
    for entry in kept:
        if s := shorter(entry, kept):
            below.setdefault(s[-1], []).append(entry)
    for entry, longer in below.items():
        n, m = (max(0, c.get(entry, 0) - sum(c.get(x, 0) for x in longer)) for c in (toxic, clean))
        if n < LEAST_SUPPORT or smooth(n, m) < LEAST_SHARE:
            del kept[entry]
    return {e: math.log(p / (1 - p)) - math.log(LEAST_SHARE / (1 - LEAST_SHARE)) + 0.1 for e, p in kept.items()}


def _with_features(grammar):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = Grammar(grammar.value)
        for rows in batches:
            yield pd.DataFrame({"toxic": rows.toxic, "f": [g.features(t) for t in rows.text]})

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights and, last, the bias; weights of clause counts are kept from falling below zero."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    penalty = np.full(len(w), ridge * 2)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), gradient)
        w -= np.clip(step, -2, 2)
        w[:-1] = np.maximum(w[:-1], 0)
        if np.abs(step).max() < 1e-6:
            break
    return w


def train_model(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[dict[str, float], np.ndarray]:
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    sample = docs.sparkSession.createDataFrame([tuple(r) for r in sample.collect()], "doc_id long, toxic int")  # at most max_train ids
    train = stored(docs.select("doc_id", text_of().alias("text")).join(F.broadcast(sample), "doc_id").select("text", "toxic"), "tox-train")
    # each distinct text once, so that copies make none of their words frequent; toxic if one of its copies is
    once = train.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    lexicon = learn_lexicon(stored(once.select("text", "toxic"), "tox-texts"))
    grammar = docs.sparkSession.sparkContext.broadcast(lexicon)
    rows = train.mapInPandas(_with_features(grammar), "toxic int, f array<double>").collect()  # at most max_train rows of numbers
    if len({r.toxic for r in rows}) < 2:
        w = np.ones(len(FEATURES) + 1)
        w[-1] = -3.0
        return lexicon, w
    order = sorted(rows, key=lambda r: (r.toxic, r.f))
    return lexicon, fit_logistic(np.array([r.f for r in order]), np.array([r.toxic for r in order], float))


def _score(model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, w = model.value
        g = Grammar(lexicon)
        for rows in batches:
            x = np.array([g.features(t) for t in rows.text]).reshape(-1, len(FEATURES))
            yield pd.DataFrame({"doc_id": rows.doc_id, "held_out": rows.held_out, "score": 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))})

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(train_model(docs, labels, max_train))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), text_of().alias("text"))
    scored = rows.mapInPandas(_score(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
