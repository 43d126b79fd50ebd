"""Toxicity by a weighted finite-state pattern grammar over clauses.

A text is cut into clauses. In a clause each word is read as a symbol class (insult, harm, intent, target,
negation, report …). Six small transducers read the classes side by side:

* ``target``: how far back a person addressed or spoken of was named;
* ``negation`` and ``report``: how far back a negation or a reporting verb was; ``quote``: whether a quotation is open in this clause;
* ``insult``: how far back an insult was, so that a target behind it aims it, too;
* ``threat``: an intent ("will", "going to"), then a word of harm, then a target; or a target, an intent, "be" and harm;
  or harm and "yourself".

Their composition is one machine: a table of states x classes, built once, whose arcs say what they emit — an insult or a threat,
and whether it is aimed, negated or reported. A transducer can be left out of the composition. Words outside matched
patterns emit nothing, and a document's features are sums of what its clauses emit: the weights that were aimed, negated, reported
or threats, each by itself, so that what aim, negation, report and threat are worth is fitted from labels (towards the
starter weights, where there are few).

Which word is an insult is part of a public starter lexicon; further insult words and
stems (in any language) are fitted from labelled training documents:
word and stem arcs get their smoothed log-odds, and all that pass the odds test are kept. The fit uses a bounded sample,
``SAMPLE`` labelled rows by the smallest hash of the id.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from kardia.llm.common import documents, filter_texts, map_rows

SAMPLE = 20_000  # labelled rows of the fit, at most
STEM = (4, 12)  # letters of a stem arc
LEAST_DOCS = 4  # toxic documents with a word or stem, for it to become an arc
LEAST_ODDS = 2.0  # its log-odds
THRESHOLD = 0.5
REACH = 4  # words that a target, negation or report reaches
INTENT_REACH = 3  # words from an intent to the harm
THREAT = 4.0  # weight of a threat beside those of insults
PRIOR = 0.1  # how strongly the link is held to the starter link

# FIXED VALUES: starter lexicons of the grammar, in natural order
INSULTS = ("clown", "disgusting", "dumb", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
INTENTS = ("gonna", "shall", "will", "werde", "werden", "wird", "voy", "vamos", "vais", "vas", "allons")
GOING, TO = ("going",), ("to",)
BE = ("be", "get", "être", "ser")
HARM_VERBS = ("beat", "burn", "destroy", "hurt", "kill", "murder", "shoot", "smash", "stab")
HARMS = ("beaten", "burnt", "shot", "stabbed", "stabbing", "schlagen", "töten", "umbringen", "matar", "golpear", "tuer", "frapper")
TARGETS = ("he", "her", "him", "she", "them", "they", "you", "your", "du", "dich", "euch", "ihn", "ihr", "sie", "te", "tu", "vous", "usted", "ustedes")
REFLEXIVES = ("yourself", "yourselves")
NEGATIONS = ("aren't", "don't", "isn't", "never", "no", "not", "wasn't", "without", "won't", "nicht", "kein", "keine", "nunca", "jamás", "jamais", "pas")
REPORTS = ("called", "claims", "quoted", "reported", "said", "says", "sagte", "dijo", "dit")

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;:\n]+|[\"“”«»]")
CLASSES = OTHER, INSULT, INTENT, GO, GO_TO, PASSIVE, HARM, TARGET, REFLEXIVE, NEGATION, REPORT, QUOTE = tuple(range(12))
_CLASS = {w: k for k, words in ((INTENT, INTENTS), (GO, GOING), (GO_TO, TO), (PASSIVE, BE), (HARM, [v + e for v in HARM_VERBS for e in ("", "s", "ed", "ing")]), (HARM, HARMS),
                                (TARGET, TARGETS), (REFLEXIVE, REFLEXIVES), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}
_CLASS |= {v[:-1] + "ing": HARM for v in HARM_VERBS if v.endswith("e")}

# what an arc emits
IS_INSULT, IS_AIMED, IS_NEGATED, IS_REPORTED, IS_THREAT, AIMS_LAST = 1, 2, 4, 8, 16, 32


def word_class(word: str) -> int:
    if word[0] in "\"“”«»":
        return QUOTE
    return INTENT if word.endswith(("'ll", "’ll")) else _CLASS.get(word, OTHER)


class Distance:
    """Words since the last symbol of some classes, ``reach`` if that is too long ago."""

    def __init__(self, *triggers: int, reach: int = REACH):
        self.triggers, self.reach, self.start = triggers, reach, reach

    def step(self, state: int, symbol: int) -> int:
        return 0 if symbol in self.triggers else min(state + 1, self.reach)


class Quote:
    start = 0

    def step(self, state: int, symbol: int) -> int:
        return 1 - state if symbol == QUOTE else state


class Threat:
    """``("intent", words ago, passive)``, ``("harm", words ago)`` after an intent, ``("bare",)`` harm without one, ``("going",)`` or ``()``."""
    start = ()

    def step(self, state: tuple, symbol: int) -> tuple:
        kind = state[0] if state else None
        if symbol == INTENT or symbol == GO_TO and kind == "going":
            return ("intent", 0, False)
        if symbol == GO:
            return ("going",)
        if symbol == HARM:
            return ("harm", 0) if kind == "intent" else ("bare",)
        if kind == "intent" and state[1] + 1 < INTENT_REACH:
            return ("intent", state[1] + 1, state[2] or symbol == PASSIVE)
        if kind == "harm" and state[1] == 0 and symbol not in (TARGET, REFLEXIVE):
            return ("harm", 1)
        return ()


TRANSDUCERS = {"target": Distance(TARGET, REFLEXIVE), "negation": Distance(NEGATION), "report": Distance(REPORT), "quote": Quote(), "insult": Distance(INSULT, HARM), "threat": Threat()}


def emitted(states: dict, symbol: int) -> int:
    """What the transducers, in these states, emit together on a symbol; one that is left out has no state."""
    within = lambda part: states.get(part, REACH) < REACH
    threat, out = states.get("threat", ()), 0
    kind = threat[0] if threat else None
    if symbol in (INSULT, HARM):
        out = IS_INSULT | (IS_AIMED if within("target") else 0)
        if symbol == HARM and kind == "intent" and threat[2] and within("target"):
            out |= IS_THREAT
    elif symbol in (TARGET, REFLEXIVE):
        if kind == "harm" or kind == "bare" and symbol == REFLEXIVE:
            out = IS_THREAT | IS_AIMED
        elif "target" in states and within("insult") and not within("target"):
            out = AIMS_LAST
    if out & (IS_INSULT | IS_THREAT):
        out |= (IS_NEGATED if within("negation") else 0) | (IS_REPORTED if within("report") or states.get("quote") else 0)
    return out


class Machine:
    """The composition: ``next[state * len(CLASSES) + symbol]`` and ``emits[...]`` over all states that can be reached from 0."""

    def __init__(self, parts: tuple[str, ...]):
        start = tuple(TRANSDUCERS[p].start for p in parts)
        number, waiting, self.next, self.emits = {start: 0}, [start], [], []
        for state in waiting:
            named = dict(zip(parts, state))
            for symbol in CLASSES:
                after = tuple(TRANSDUCERS[p].step(v, symbol) for p, v in named.items())
                if after not in number:
                    number[after] = len(waiting)
                    waiting.append(after)
                self.next.append(number[after])
                self.emits.append(emitted(named, symbol))


@lru_cache(maxsize=None)
def compose(parts: tuple[str, ...] = tuple(TRANSDUCERS)) -> Machine:
    return Machine(parts)


@dataclass
class Grammar:
    """Weights of the insult arcs, the transducers composed, and the link from what clauses emit to a score."""
    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, 4.0))
    stems: dict[str, float] = field(default_factory=dict)
    parts: tuple[str, ...] = tuple(TRANSDUCERS)
    # intercept; strongest, all, aimed, negated, reported, threats, share of matched clauses
    link: tuple[float, ...] = (-3.0, 0.6, 0.8, 0.5, -2.0, -1.2, 1.5, 0.0)

    def weight(self, word: str) -> float:
        """The insult weight of a lower-case word: that of the word, or of its strongest stem."""
        w = self.words.get(word)
        if w is None:
            w = max((self.stems.get(word[:n], 0.0) for n in range(STEM[0], min(len(word), STEM[1]) + 1)), default=0.0)
        return w


def clauses(grammar: Grammar, text: str, memo: dict[str, tuple[int, float]]) -> tuple[list[list[tuple[float, int]]], int]:
    """``(weight, flags)`` of what each matched clause of a text emits, and the number of its clauses."""
    machine = compose(grammar.parts)
    step, emits, symbols = machine.next, machine.emits, len(CLASSES)
    found: list[list[tuple[float, int]]] = []
    n, words, state, clause = 0, 0, 0, []
    for word in WORD.findall(text.lower()):
        if word[0] in ".!?;:\n":
            if words:
                n += 1
                if clause:
                    found.append(clause)
            words, state, clause = 0, 0, []
            continue
        known = memo.get(word)
        if known is None:
            kind = word_class(word)
            w = grammar.weight(word) if kind in (OTHER, HARM) else 0.0
            known = memo[word] = (INSULT if kind == OTHER and w > 0 else kind, w)
        symbol, w = known
        words += symbol != QUOTE
        at = state * symbols + symbol
        out, state = emits[at], step[at]
        if out:
            if out & AIMS_LAST:
                if clause:
                    clause[-1] = (clause[-1][0], clause[-1][1] | IS_AIMED)
            elif out & IS_THREAT:
                clause.append((max(w, THREAT), out))
            elif w > 0:
                clause.append((w, out))
    if words:
        n += 1
        if clause:
            found.append(clause)
    return found, n


def features(grammar: Grammar, text: str, memo: dict[str, tuple[int, float]]) -> list[float]:
    """Strongest weight emitted; logs of the sums of all weights, and of those aimed, negated, reported; log of the number of threats; share of matched clauses."""
    found, n = clauses(grammar, text, memo)
    emitted_ = [e for clause in found for e in clause]
    of = lambda flag: math.log1p(sum(w for w, flags in emitted_ if flags & flag))
    return [max((w for w, _ in emitted_), default=0.0), math.log1p(sum(w for w, _ in emitted_)), of(IS_AIMED), of(IS_NEGATED), of(IS_REPORTED),
            math.log1p(sum(1 for _, flags in emitted_ if flags & IS_THREAT)), len(found) / n if n else 0.0]


class Scorer:
    """Scores texts with a grammar; remembers word weights up to a bound."""

    def __init__(self, grammar: Grammar, remembered: int = 300_000):
        self.grammar, self.memo, self.remembered = grammar, {}, remembered

    def __call__(self, text: str) -> float:
        if len(self.memo) > self.remembered:
            self.memo.clear()
        z = self.grammar.link[0] + sum(a * b for a, b in zip(self.grammar.link[1:], features(self.grammar, text, self.memo)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(id_col="doc_id"):
    """Whether a row is left out of every fit: crc32 of the id as text, mod 5, is 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, text, label)`` of at most ``sample`` labelled rows outside the held-out fold, by the smallest hash of the id.

    The ids and labels are at most ``sample`` rows of two numbers, so they are broadcast. Of rows with
    one id, the one whose text has the smallest hash is taken.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    # an id labelled twice counts once, with its smaller label
    chosen = known.where(~held_out()).groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = documents(docs).where("doc_id IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least")).select("doc_id", "least.text", "label")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Grammar:
    """A grammar whose insult arcs and link are fitted from labelled rows; the starter grammar if there are too few."""
    rows = training_rows(docs, labels, "toxic", sample)

    def units(cols):
        out = {"unit": [], "toxic": [], "clean": []}
        for text, y in zip(cols["text"], cols["label"]):
            words = {w for w in WORD.findall(text.lower()) if w[0].isalpha()}
            found = words | {w[:n] + "*" for w in words for n in range(STEM[0], min(len(w), STEM[1]) + 1)}
            out["unit"] += found
            out["toxic"] += [int(y == 1)] * len(found)
            out["clean"] += [int(y != 1)] * len(found)
        return out

    totals = rows.agg(F.count(F.when(F.col("label") == 1, 1)).alias("toxic"), F.count(F.when(F.col("label") != 1, 1)).alias("clean")).first()
    if min(totals.toxic, totals.clean) < LEAST_DOCS:
        return Grammar()
    counts = map_rows(rows.select("text", "label"), units, "unit string, toxic int, clean int").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (totals.toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (totals.clean + 1.0))
    strong = counts.where(F.col("toxic") >= LEAST_DOCS).select("unit", odds.alias("odds")).where(F.col("odds") >= LEAST_ODDS)
    arcs = strong.collect()  # of words in LEAST_DOCS toxic rows of the sample, so bounded by it
    grammar = Grammar()
    for unit, weight in arcs:
        if unit.endswith("*"):
            grammar.stems[unit[:-1]] = weight
        else:
            grammar.words[unit] = max(weight, grammar.words.get(unit, 0.0))

    def clause_features(cols):
        memo: dict[str, float] = {}
        xs = [features(grammar, t, memo) for t in cols["text"]]
        return {"x": xs, "y": cols["label"]}

    seen = map_rows(rows.select("text", "label"), clause_features, "x array<double>, y int").collect()
    x = np.array([r.x for r in seen])
    y = np.array([float(r.y == 1) for r in seen])
    grammar.link = logistic(x, y, grammar.link, PRIOR)
    return grammar


def logistic(x: np.ndarray, y: np.ndarray, prior: tuple[float, ...] | None = None, strength: float = 1e-2, rounds: int = 50) -> tuple[float, ...]:
    """Intercept and weights of a logistic regression held to ``prior`` (by default 0), by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    centre = np.zeros(a.shape[1]) if prior is None else np.array(prior)
    w = centre.copy()
    penalty = strength * np.eye(len(w))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + penalty @ (w - centre)
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def score(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of each row.

    A null or empty text has no clause and gets the link's base score. A null id
    counts as not held out. Repeated rows give repeated results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(cols):
        scorer = scorer_of(shared.value)
        scores = [scorer(t) for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "score": scores, "predicted": [int(s >= threshold) for s in scores]}

    scored = map_rows(documents(docs, id_col, text_col), run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, grammar: Grammar, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that score below ``threshold``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def keep(texts: list[str]) -> list[bool]:
        scorer = scorer_of(shared.value)
        return [scorer(t) < threshold for t in texts]

    return filter_texts(docs, text_col, keep)


_scorers: list[Scorer] = []


def scorer_of(grammar: Grammar) -> Scorer:
    """The scorer of a broadcast grammar, kept by the worker process."""
    if not _scorers or _scorers[0].grammar is not grammar:
        _scorers[:] = [Scorer(grammar)]
    return _scorers[0]
