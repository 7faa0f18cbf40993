"""Toxicity by a learned lexicon, misspellings included, and by where its terms stand.

The lexicon comes from labelled documents: words that mark toxic ones.  Its terms form a trie.  The Levenshtein
automata of all terms, intersected with the trie, are one automaton whose state is a set of (trie node, errors); it is
made deterministic as words are read, so a word is dropped at the first character after which no term is in reach.
A hit counts by how exact it is and by its window: inside quotation marks, or after a verb of reporting, it is likely
a quotation and counts less; near other hits it counts as abuse.  A logistic model of a document's counts gives the
score.

Corner cases: a null or empty text has no hits and gets the score of such documents; a document labelled twice is
toxic if any label says so; null labels and null ids teach nothing; without a toxic or without a clean labelled
document, or without a word that tells them apart, every score is 0; of texts with one id the smallest in the order of bytes teaches; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.memory import tidy
from tidelog.llm.shared import crc_mod5, materialize, texts, work_dir

#: Labelled documents that lexicon and model are fitted on, at most: those with the smallest hashes of their ids.
SAMPLE = 20_000
#: Quotation marks that open and close, and verbs that report what someone said.
OPENING, CLOSING, EITHER = "“«„‹‘", "”»“›’", "\"'"
REPORTING = {"said", "says", "wrote", "writes", "called", "quoted", "quote", "dit", "écrit", "sagte", "schrieb", "dijo", "escribió"}
MARKS = ".,;:!?()[]{}<>*#$%&|~_-–—…/\\+=^`@" + OPENING + CLOSING + EITHER
#: Words on either side that make up a hit's window.
WINDOW = 8
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: States of the automaton that a process keeps.
STATES = 50_000


def errors_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class LexiconAutomaton:
    """The Levenshtein automata of all terms over their trie, determinised on demand."""

    def __init__(self, terms: Iterable[str]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        self.budget: list[int] = [0]  # the most errors that a term below a node allows
        for term in sorted(set(terms)):
            node, allowed = 0, errors_allowed(term)
            self.budget[0] = max(self.budget[0], allowed)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.budget.append(0)
                node = self.children[node][c]
                self.budget[node] = max(self.budget[node], allowed)
            self.ends[node] = term
        self.alphabet = {c for kids in self.children for c in kids}
        self._reset()

    def _reset(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.found: list[tuple[str, int] | None] = []
        self.start = self._number(self._closed({0: 0}))

    def _closed(self, reach: dict[int, int]) -> frozenset:
        """With the terms' characters that a word may leave out."""
        todo = list(reach.items())
        while todo:
            node, e = todo.pop()
            for kid in self.children[node].values():
                if e + 1 <= self.budget[kid] and e + 1 < reach.get(kid, 99):
                    reach[kid] = e + 1
                    todo.append((kid, e + 1))
        return frozenset(reach.items())

    def _number(self, state: frozenset) -> int:
        if not state:
            return -1
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
            ends = [(e, self.ends[n]) for n, e in state if self.ends[n] is not None and e <= errors_allowed(self.ends[n])]
            self.found.append((min(ends)[1], min(ends)[0]) if ends else None)
        return self.numbers[state]

    def _step(self, state: int, c: str) -> int:
        reach: dict[int, int] = {}

        def to(node: int, e: int) -> None:
            if e <= self.budget[node] and e < reach.get(node, 99):
                reach[node] = e

        for node, e in self.states[state]:
            to(node, e + 1)  # a character too many
            for k, kid in self.children[node].items():
                to(kid, e + (k != c))
        return self._number(self._closed(reach))

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its allowed errors and its distance; the first of several in the alphabet."""
        if len(self.states) > STATES:
            self._reset()
        state = self.start
        for c in word:
            c = c if c in self.alphabet else "\0"
            steps = self.steps[state]
            state = steps[c] if c in steps else steps.setdefault(c, self._step(state, c))
            if state < 0:
                return None
        return self.found[state]


def bare(word: str) -> str:
    return word.strip(MARKS).lower()


@dataclass
class Lexicon:
    """Terms with the words to leave alone; ``hits`` finds terms in a text."""

    terms: list[str]
    clean: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.automaton = LexiconAutomaton(self.terms)
        self.known: dict[str, tuple[str, int] | None] = {w: None for w in self.clean}
        self.fixed = len(self.known)

    def look_up(self, word: str) -> tuple[str, int] | None:
        if word not in self.known:
            if len(self.known) > 300_000 + self.fixed:
                self.known = {w: None for w in self.clean}
            self.known[word] = self.automaton.match(bare(word)) if bare(word) not in self.known else self.known[bare(word)]
        return self.known[word]

    def features(self, text: str) -> list[float]:
        """What the model sees of a text: its hits by kind, the fullest window, the variety of terms, the length."""
        words = WORDS.findall(text)
        look = self.known.get
        found = []
        for i, w in enumerate(words):
            hit = look(w, 0)
            if hit == 0:
                hit = self.look_up(w)
            if hit is not None:
                found.append((i, hit))
        if not found:
            return [0.0] * 5
        quoted = quotations(words)
        weights = [(0.25 if quoted[i] else 1.0) * (1.0 if e == 0 else 0.7) for i, (_, e) in found]
        left = 0
        total = best = 0.0
        for right, (i, _) in enumerate(found):
            total += weights[right]
            while found[left][0] < i - 2 * WINDOW:
                total -= weights[left]
                left += 1
            best = max(best, total)
        kinds = Counter()
        for (_, (term, _)), w in zip(found, weights):
            kinds[term] = max(kinds[term], w)
        return [math.log1p(sum(weights)), min(sum(kinds.values()), 6.0), best, math.log1p(sum(quoted[i] for i, _ in found)), math.log1p(len(words))]


def quotations(words: list[str]) -> list[bool]:
    """Whether each word stands in a quotation: between marks at most four windows apart, or just after a reporting verb."""
    out, opened = [False] * len(words), None
    reported = -99
    for i, w in enumerate(words):
        begins, ends = w[0] in OPENING + EITHER, w.rstrip(".,;:!?")[-1:] in tuple(CLOSING + EITHER)
        if begins and opened is None:
            opened = i
        if ends and opened is not None and (i > opened or len(w) > 2):
            if i - opened <= 4 * WINDOW:
                out[opened : i + 1] = [True] * (i + 1 - opened)
            opened = None
        elif opened is not None and i - opened > 4 * WINDOW:
            opened = i if begins else None
        if bare(w) in REPORTING:
            reported = i
        if i - reported <= 2 and i > reported:
            out[i] = True
    return out


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    weights: list[float]
    center: list[float]
    scale: list[float]

    def score(self, text: str) -> float:
        x = self.lexicon.features(text)
        z = self.weights[-1] + sum([w * (v - c) / s for w, v, c, s in zip(self.weights, x, self.center, self.scale)])
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[list[float], list[float], list[float]]:
    """Weights (the constant last), centre and scale; Newton's method with a ridge."""
    center, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - center) / scale, np.ones(len(x))])
    w, penalty = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + penalty, z.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist(), center.tolist(), scale.tolist()


def labelled(docs: DataFrame, labels: DataFrame, held_out_fold: int = 0, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic) of the training labels, at most ``sample``."""
    known = labels.where("doc_id is not null and toxic is not null").where(crc_mod5() != held_out_fold)
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = texts(docs).join(F.broadcast(known), "doc_id")  # no larger than the sample
    return found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")


def mine_lexicon(train: DataFrame, least: int = 3, z: float = 4.0, precision: float = 0.8) -> Lexicon:
    """Words whose log odds between toxic and clean documents stand ``z`` deviations above chance.

    Toxic documents that share the smallest hash of their words are near copies; a term counts once for all of them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean: Counter[str] = Counter()
        rows: list[tuple[str, int | None, int]] = []
        docs = Counter()

        def out(rows: list) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64()))], names=["word", "sketch", "clean"])

        for batch in batches:
            for text, toxic in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = {b for w in set(text.split()) if 3 <= len(b := bare(w)) <= 30}
                docs[toxic] += 1
                if not toxic:
                    clean.update(words)
                    continue
                sketch = min((xxhash.xxh64_intdigest(w) >> 1 for w in words), default=0)
                rows += [(w, sketch, 0) for w in words]
                rows.append(("", sketch, 0))
            if len(rows) > 50_000:
                yield out(rows)
                rows = []
        rows += [(w, None, n) for w, n in clean.items()]
        if docs[0]:
            rows.append(("", None, docs[0]))
        if rows:
            yield out(rows)

    found = train.mapInArrow(tidy(count), "word string, sketch long, clean long")
    counts = found.groupBy("word", "sketch").agg(F.sum("clean").alias("clean")).groupBy("word").agg(F.count("sketch").alias("t"), F.sum("clean").alias("c"))
    counts = materialize(counts, f"{work_dir(train.sparkSession, 'lexicon')}/counts")
    total = counts.where("word = ''").first()
    if total is None or not total["t"] or not total["c"]:
        return Lexicon([])
    t, c, nt, nc = F.col("t"), F.col("c"), F.lit(float(total["t"])), F.lit(float(total["c"]))
    odds = F.log((t + 0.5) / (nt - t + 0.5)) - F.log((c + 0.5) / (nc - c + 0.5))
    deviation = F.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
    better = counts.where(F.col("word") != "").where((t >= least) & (t >= precision * (t + c)) & (odds > z * deviation))
    terms = [r["word"] for r in better.orderBy(F.desc(odds / deviation), "word").select("word").collect()]  # of words in the sample
    lexicon = Lexicon(terms)
    chosen = set(terms)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = LexiconAutomaton(terms)
        for batch in batches:
            yield batch.filter(pa.array([w not in chosen and automaton.match(w) is not None for w in batch.column(0).to_pylist()], pa.bool_()))

    near = counts.where((F.col("c") > 0) & (F.col("t") < precision * (t + c))).select("word", "c").mapInArrow(tidy(close), "word string, c long")
    lexicon.clean = [r["word"] for r in near.orderBy(F.desc("c"), "word").collect()]  # of words in the sample, those close to a term
    lexicon.__post_init__()
    return lexicon


def fit(docs: DataFrame, labels: DataFrame, held_out_fold: int = 0, sample: int = SAMPLE) -> ToxicityModel:
    """Lexicon and model from the labelled documents outside the held-out fold."""
    train = labelled(docs, labels, held_out_fold, sample)
    lexicon = mine_lexicon(train)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Lexicon(lexicon.terms, lexicon.clean)
        for batch in batches:
            rows = [mine.features(t) for t in batch.column(0).to_pylist()]
            yield pa.record_batch([batch.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "x"])

    rows = train.select("text", "toxic").mapInArrow(tidy(look), "toxic int, x array<double>").collect()  # no more than the sample
    y = np.array([r["toxic"] for r in rows], float)
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), 5)
    if len(set(y.tolist())) < 2 or not lexicon.terms:
        return ToxicityModel(lexicon, [0.0] * 5 + [-40.0], [0.0] * 5, [1.0] * 5)  # nothing tells texts apart
    return ToxicityModel(lexicon, *fit_logistic(x, y))


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) of every document."""
    parts = (model.lexicon.terms, model.lexicon.clean, model.weights, model.center, model.scale)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, clean, weights, center, scale = parts
        mine = ToxicityModel(Lexicon(terms, clean), weights, center, scale)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([mine.score(t or "") for t in batch.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidy(each), "doc_id long, score double")


def keep_civil(docs: DataFrame, labels: DataFrame, held_out_fold: int = 0, limit: float = 0.5) -> DataFrame:
    """The rows of docs with a score under the limit."""
    model = fit(docs, labels, held_out_fold)
    parts = (model.lexicon.terms, model.lexicon.clean, model.weights, model.center, model.scale)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, clean, weights, center, scale = parts
        mine = ToxicityModel(Lexicon(terms, clean), weights, center, scale)
        for batch in batches:
            yield batch.filter(pa.array([mine.score(t or "") < limit for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(tidy(each), docs.schema)


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, held_out_fold: int = 0, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    out = score_documents(docs, fit(docs, labels, held_out_fold, sample))
    held = F.coalesce(crc_mod5() == held_out_fold, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
