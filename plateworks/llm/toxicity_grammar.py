"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer reads a word and writes its class: insult (stems and words learned from labels, with weights),
threat, target, negation, reported speech, or other. Context transducers read the classes of a clause: one
tracks who is addressed, one negation, one reported speech. They are composed into one machine, whose run over a clause writes a
reading for every insult or threat in it: plain, addressed, negated or reported. A document's score is a logistic
function of its weighted readings, not of isolated words: an insult that is negated or quoted counts by the weight
that the labels give to that reading.

Learning. ``LABELLED`` bounds the labelled rows used (chosen by a hash of doc_id among rows whose crc32(doc_id) mod 4 is not
2). Stems are whole words and beginnings of words that toxic rows hold and others hardly do. Label, language, source and doc_id
are not inputs of a score. Every document's whole text is scored.

Null and empty texts have no clauses and get the score of none. Without labels of both kinds, scores are zero.
Repeated rows are scored each; a doc_id with several labels counts as toxic if one says so; null labels are left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELLED = 10_000
FIT_PARTS = 8
SHORTEST, LONGEST = 4, 8
SUPPORT = 8
ODDS = 2.5
THRESHOLD = 0.3

# Cue words in English, German, French and Spanish.
THREATS = "kill hurt destroy beat stab shoot burn töten umbringen schlagen verprügeln tuer frapper détruire brûler matar golpear destruir quemar"
TARGETS = "you your yours u he she they him her them his their du dich dir dein ihr euch er sie tu toi te ton vous votre il elle ils tú ti usted ustedes él ella ellos"
NEGATIONS = "not no never none isn't aren't don't doesn't nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún"
REPORTS = "said says told wrote quoted claimed reported sagte sagt schrieb behauptete dit disait écrit dijo dice escribió afirmó"

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)
READINGS = ("plain", "addressed", "negated", "reported")
#: Words after a negation that it covers.
REACH = 3

_CLAUSE = re.compile(rb"[.!?;:,\n]+")
_WORD = re.compile(rb"[^\x00-\x20!-&(-/:-@\[-`{-~]+")


@dataclass(frozen=True)
class Machine:
    """A deterministic transducer: ``step[state][symbol]`` is the next state, ``out[state][symbol]`` what it writes."""

    start: object
    step: dict = field(hash=False)
    out: dict = field(hash=False)

    def composed(self, other: Machine) -> Machine:
        """Both machines on the same input; the outputs are paired. Only states that can be reached are made."""
        start = (self.start, other.start)
        step, out, todo = {}, {}, [start]
        while todo:
            state = todo.pop()
            if state in step:
                continue
            a, b = state
            step[state] = [(x, y) for x, y in zip(self.step[a], other.step[b])]
            out[state] = [(x, y) for x, y in zip(self.out[a], other.out[b])]
            todo += step[state]
        return Machine(start, step, out)

    def renamed(self) -> Machine:
        """The same with states numbered."""
        number = {s: i for i, s in enumerate(self.step)}
        return Machine(number[self.start], [[number[t] for t in self.step[s]] for s in self.step], [self.out[s] for s in self.step])


def _table(states: list, rule) -> tuple[dict, dict]:
    moves = {s: [rule(s, c) for c in range(6)] for s in states}
    return {s: [m[0] for m in ms] for s, ms in moves.items()}, {s: [m[1] for m in ms] for s, ms in moves.items()}


def addressed() -> Machine:
    """Writes whether someone has been addressed in the clause so far."""
    return Machine(0, *_table([0, 1], lambda s, c: (1 if c == TARGET else s, bool(s))))


def negated() -> Machine:
    """Writes whether a negation stands within ``REACH`` words before."""
    return Machine(0, *_table(list(range(REACH + 1)), lambda s, c: (REACH if c == NEGATION else max(0, s - 1), s > 0)))


def reported() -> Machine:
    """Writes whether the clause so far reports speech."""
    return Machine(0, *_table([0, 1], lambda s, c: (1 if c == REPORT else s, bool(s))))


def grammar() -> Machine:
    return addressed().composed(negated()).composed(reported()).renamed()


def _reading(written: tuple) -> int:
    (to_someone, not_so), told = written
    return 3 if told else 2 if not_so else 1 if to_someone else 0


@dataclass
class Lexicon:
    """Weights of insulting words and stems (beginnings of words)."""

    words: dict[bytes, float]
    stems: dict[bytes, float]

    def __post_init__(self) -> None:
        self.cues = {w.encode(): c for c, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws.split()}
        kernels = sorted({*self.stems, *self.words, *(w for w, c in self.cues.items() if c == THREAT)})
        # finds the clauses worth reading: those with a word that begins like one that can score
        self.worth = re.compile(rb"(?<![^\x00-\x40\x5B-\x60\x7B-\x7F])(?:" + b"|".join(map(re.escape, kernels)) + rb")")

    def read(self, word: bytes) -> tuple[int, float]:
        """Class and weight of a lower-case word."""
        if word in self.words:
            return INSULT, self.words[word]
        for k in range(min(LONGEST, len(word)), SHORTEST - 1, -1):
            if word[:k] in self.stems:
                return INSULT, self.stems[word[:k]]
        return self.cues.get(word, OTHER), 1.0


def clauses(text: bytes, lexicon: Lexicon) -> Iterator[list[bytes]]:
    """The words of the clauses in which something can score."""
    last = -1
    for hit in lexicon.worth.finditer(text):
        if hit.start() < last:
            continue
        before = max(text.rfind(c, 0, hit.start()) for c in (b".", b"!", b"?", b";", b":", b",", b"\n"))
        after = _CLAUSE.search(text, hit.end())
        last = after.start() if after else len(text)
        yield _WORD.findall(text[before + 1:last])


def readings(text: bytes | None, lexicon: Lexicon, machine: Machine) -> tuple[np.ndarray, int]:
    """Summed weights by class (insult, threat) and reading, and the number of words."""
    found = np.zeros((2, len(READINGS)))
    text = (text or b"").lower()
    for words in clauses(text, lexicon):
        state = machine.start
        seen = [lexicon.read(w) for w in words]
        # who is addressed may come after the insult
        to_someone = any(c == TARGET for c, _ in seen)
        for c, weight in seen:
            if c in (INSULT, THREAT):
                r = _reading(machine.out[state][c])
                found[c, 1 if r == 0 and to_someone else r] += weight
            state = machine.step[state][c]
    return found, text.count(b" ") + text.count(b"\n") + 1


def features(text: bytes | None, lexicon: Lexicon, machine: Machine) -> np.ndarray:
    """Per class and reading the logarithm of the weight, and the weight of all per hundred words."""
    found, words = readings(text, lexicon, machine)
    return np.r_[np.log1p(found.ravel()), math.log1p(100 * found.sum() / words)]


@dataclass
class Model:
    lexicon: Lexicon
    beta: np.ndarray | None

    def score(self, text: bytes | None, machine: Machine) -> float:
        if self.beta is None:
            return 0.0
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, self.beta[0] + float(features(text, self.lexicon, machine) @ self.beta[1:]))))))


def _units(text: bytes) -> set[tuple[bool, bytes]]:
    """Whole words (True) and beginnings of words (False) of a text."""
    out = set()
    for w in set(_WORD.findall(text.lower())):
        out.add((True, w))
        for k in range(SHORTEST, min(LONGEST, len(w) - 1) + 1):
            out.add((False, w[:k]))
    return out


def held_out(doc_id: str | Column = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of about ``LABELLED`` labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = int(min(1.0, LABELLED / max(known.count(), 1)) * 1_000_000)
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).where(chosen)
    # a text counts once, however many copies of it are labelled
    return texts.join(known.where(chosen), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")).repartition(FIT_PARTS)


def _learned(sample: DataFrame) -> Lexicon:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[bool, bytes], list[int]] = {}
        rows = [0, 0]
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                rows[toxic > 0] += 1
                for unit in _units(text.as_py() or b""):
                    counts.setdefault(unit, [0, 0])[toxic > 0] += 1
        counts[True, b""] = rows
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.binary()), pa.array([counts[k][0] for k in keys], pa.int64()),
                                          pa.array([counts[k][1] for k in keys], pa.int64())], ["whole", "unit", "clean", "toxic"])

    sums = (sample.mapInArrow(run, "whole boolean, unit binary, clean long, toxic long").groupBy("whole", "unit")
            .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where((F.col("toxic") >= SUPPORT) & (F.col("toxic") > F.col("clean")) | (F.octet_length("unit") == 0)))
    units = [(r.whole, bytes(r.unit), r.clean, r.toxic) for r in sums.collect()]
    n = next(((c, t) for _, u, c, t in units if not u), (0, 0))
    weight = {(w, u): math.log((t + 0.5) / (n[1] + 1)) - math.log((c + 0.5) / (n[0] + 1)) for w, u, c, t in units if u}
    good = {k: x for k, x in weight.items() if x >= ODDS}
    return Lexicon({u: x for (w, u), x in good.items() if w}, {u: x for (w, u), x in good.items() if not w})


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    sample = _sample(docs, labels)
    lexicon = _learned(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = grammar()
        for batch in batches:
            x = [features(t.as_py(), lexicon, machine).tolist() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    got = sample.mapInArrow(run, "x array<double>, y int").collect()
    y = np.array([r.y > 0 for r in got], float)
    if not len(y) or y.min() == y.max():
        return Model(lexicon, None)
    x = np.c_[np.ones(len(y)), np.array([r.x for r in got])]
    order = np.lexsort(x.T)  # the sums don't depend on the order of arrival
    x, y = x[order], y[order]
    beta = np.zeros(x.shape[1])
    ridge = np.r_[1e-6, np.full(x.shape[1] - 1, 1.0)]
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(ridge), x.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return Model(lexicon, beta)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = grammar()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t.as_py(), machine) for t in batch.column(1)], pa.float64())], ["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double").select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
