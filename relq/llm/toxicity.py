"""Toxicity: a learned lexicon, found with misspellings, weighed by context.

The lexicon is learned from a bounded number of labelled rows: words and word beginnings whose share of documents is
far higher among toxic ones. Its trie is intersected with a Levenshtein automaton and made deterministic as far as the
texts need it, so that a word is read once, whatever the number of terms; words are read side by side, one character at
a time. Each hit has a score from the window around it: inside quotation marks or after a word of reporting it counts
as a quotation.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, learnable, materialize, small_batches, table

#: Labelled rows learned from at most, and the terms that a document has, about.
TRAIN_ROWS, DOC_TERMS = 20_000, 300
PREFIXES = range(3, 9)
#: The most different words of one beginning that a term asks for.
REPEATS = 4
#: Different pairs of neighbours that a term's words must have.
NEIGHBOURS = 3
#: Code points on either side of a hit that tell a quotation.
WINDOW = 60
#: Words read side by side, and entries of the automaton's table that a worker keeps.
READ, TABLE = 1 << 14, 1 << 23
#: Marks of quotation, and words of reporting.
QUOTES = "\"“”„«»‘’"
REPORTING = re.compile(r"\b(?:said|says|wrote|called|calling|quote|quoted|word|term|sagte|schrieb|nannte|dijo|escribió|llamó|dit|écrit|appelé)\b")
WORD = re.compile(r"[^\W_]+")
EXACT, NEAR, FAR = 1, 2, 3


def allowed(term: str) -> int:
    """Edits that a term may have; beginnings of words (marked by a star) none."""
    return 0 if "*" in term or len(term) < 5 else 1 if len(term) < 9 else 2


def bare(term: str) -> str:
    return term.partition("*")[0]


def needed(term: str) -> int:
    """How many different words of a document must match the term: the number after the star."""
    return int(term.partition("*")[2] or 1)


class Automaton:
    """The lexicon's trie met by the edits that its terms allow, as a table of states.

    step[state, class] -> state: 0 is dead, 1 the start, -1 not known yet. hit: how a word that ends here matches; term:
    which term. States are made when a text first needs them; a table over TABLE entries is begun anew. Only the terms
    are pickled.
    """

    def __init__(self, terms: list[str]) -> None:
        self.terms, self.needed = terms, [needed(t) for t in terms]
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int | None] = [None]
        self.begins: list[int | None] = [None]
        self.most = [0]  # edits of any term below
        for number, term in enumerate(terms):
            node = 0
            for c in bare(term):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.begins.append(None)
                    self.most.append(0)
                self.most[node] = max(self.most[node], allowed(term))
                node = self.children[node][c]
            self.most[node] = max(self.most[node], allowed(term))
            (self.begins if "*" in term else self.ends)[node] = number
        self.letters = [None, *sorted({c for t in terms for c in bare(t)})]
        self.classes = np.zeros(sys.maxunicode + 1, np.int32)
        self.classes[[ord(c) for c in self.letters[1:]]] = np.arange(1, len(self.letters))
        self.begin_anew()

    def __reduce__(self):
        return Automaton, (self.terms,)

    def begin_anew(self) -> None:
        first = self._closed({0: 0})
        self.states: list[frozenset | None] = [None, first]
        self.numbers: dict = {first: 1}
        self.step = np.full((64, len(self.letters)), -1, np.int32)
        self.step[0] = 0
        self.hit, self.term = np.zeros(64, np.int8), np.full(64, -1, np.int32)

    def _closed(self, nodes: dict[int, int]) -> frozenset:
        todo = list(nodes.items())
        while todo:
            node, e = todo.pop()
            if e == nodes[node]:
                for child in self.children[node].values():  # a letter left out
                    if e + 1 <= self.most[child] and e + 1 < nodes.get(child, 9):
                        nodes[child] = e + 1
                        todo.append((child, e + 1))
        return frozenset(nodes.items())

    def _moved(self, state: frozenset, c: str | None) -> frozenset | int:
        nodes: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.most[node] and e < nodes.get(node, 9):
                nodes[node] = e

        for node, e in state:
            put(node, e + 1)  # a letter put in
            for letter, child in self.children[node].items():
                put(child, e if letter == c else e + 1)
                if letter == c and e == 0 and self.begins[child] is not None:
                    return self.begins[child]
        return self._closed(nodes)

    def _number(self, to: frozenset | int) -> int:
        if to in self.numbers:
            return self.numbers[to]
        own = self.numbers[to] = len(self.states)
        self.states.append(None if isinstance(to, int) else to)
        if own == len(self.step):
            self.step = np.vstack([self.step, np.full_like(self.step, -1)])
            self.hit, self.term = np.append(self.hit, np.zeros_like(self.hit)), np.append(self.term, np.full_like(self.term, -1))
        if isinstance(to, int):  # the beginning of a word: whatever follows
            self.step[own], self.hit[own], self.term[own] = own, EXACT, to
        else:
            best = min(((e, self.ends[n]) for n, e in to if self.ends[n] is not None and e <= allowed(self.terms[self.ends[n]])), default=None)
            if best is not None:
                self.hit[own], self.term[own] = best[0] + EXACT, best[1]
        return own

    def after(self, state: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """The states that follow, made where they are not known."""
        to = self.step[state, kinds]
        missing = to < 0
        if missing.any():
            for s, k in sorted(set(zip(state[missing].tolist(), kinds[missing].tolist()))):
                made = self._moved(self.states[s], self.letters[k])
                number = self._number(made) if isinstance(made, int) or made else 0
                self.step[s, k] = number
            to = self.step[state, kinds]
        return to


@lru_cache(1)
def word_letters() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(sys.maxunicode + 1)])


def hits(own: Automaton, text: str) -> tuple[int, list[tuple[int, int, int, int]]]:
    """The number of words of a lower-case text, and its hits: (start, end, kind, term)."""
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.concatenate(([0], word_letters()[cps].view(np.int8), [0]))
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turns[::2], turns[1::2]
    kinds, found = own.classes[cps], []
    for k in range(0, len(starts), READ):
        if own.step.size > TABLE:
            own.begin_anew()
        live, at = np.arange(k, min(k + READ, len(starts))), starts[k : k + READ].copy()
        state = np.ones(len(live), np.int32)
        while len(live):
            state = own.after(state, kinds[at])
            at = at + 1
            over = at == ends[live]
            good = over & (own.hit[state] > 0)
            found += [(int(starts[i]), int(ends[i]), int(own.hit[s]), int(own.term[s])) for i, s in zip(live[good], state[good])]
            keep = ~over & (state > 0)
            live, state, at = live[keep], state[keep], at[keep]
    return len(starts), found


def _marks(text: str, low: int, high: int) -> Iterator[tuple[bool, bool]]:
    """(may open, may close) of each quotation mark of a part of a text. One between letters is an apostrophe and none;
    one opens before what is no space and closes after it, and with spaces on both sides may do either."""
    for i in range(low, high):
        if text[i] in QUOTES:
            left, right = text[i - 1 : i] or " ", text[i + 1 : i + 2] or " "
            if not (left.isalnum() and right.isalnum()):
                free = left.isspace() and right.isspace()
                yield free or not right.isspace() and not left.isalnum(), free or not left.isspace() and not right.isalnum()


def quoted(text: str, start: int, end: int) -> bool:
    """Whether the nearest marks within the window, on the line, open before and close after; or one of both does and a
    word of reporting stands before."""
    low = max(start - WINDOW, text.rfind("\n", 0, start) + 1, 0)
    high = text.find("\n", end, end + WINDOW)
    high = min(end + WINDOW, len(text)) if high < 0 else high
    opened = next((x[0] for x in reversed(list(_marks(text, low, start)))), False)
    closed = next((x[1] for x in _marks(text, end, high)), False)
    return opened and closed or (opened or closed) and bool(REPORTING.search(text, low, start))


MEASURES = ("exact", "near", "far", "quoted", "distinct", "density")


def measures(own: Automaton, text: str) -> list[float]:
    words, found = hits(own, text.lower())
    low = text.lower() if found else ""
    count = [0.0] * 5
    of = defaultdict(set)
    for start, end, kind, term in found:
        of[term].add(low[start:end])
    found = [x for x in found if len(of[x[3]]) >= own.needed[x[3]]]
    terms = set()
    for start, end, kind, term in found:
        if quoted(low, start, end):
            count[3] += 1
        else:
            count[kind - 1] += 1
            if kind == EXACT:
                terms.add(term)
    return [*(math.log1p(c) for c in count[:4]), math.log1p(len(terms)), math.log1p(100 * (count[0] + 0.5 * count[1]) / max(words, 20))]


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05) -> np.ndarray:
    """Weights of the measures and, last, the intercept. Without rows the chance is one half."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(x.shape[1]), np.diag([penalty] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50 if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + keep, x.T @ (y - p) - keep @ w)
        w += np.clip(step, -3, 3)
        if abs(step).max() < 1e-6:
            break
    return w


def term_counts(docs: DataFrame) -> DataFrame:
    """Labelled documents (text, label) -> term, pos, neg: documents of either label that hold a word or beginning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array([v[k] for v in seen.values()], pa.int64()) for k in (0, 1))], ["term", "pos", "neg"])
            seen.clear()
            return out

        for b in batches:
            for text, label in zip(*(c.to_pylist() for c in b.columns)):
                words = set(WORD.findall((text or "").lower()))
                begins = Counter(w[:n] for w in words for n in PREFIXES if len(w) >= n)
                for w in words:
                    seen[w][label == 0] += 1
                for w, k in begins.items():
                    for m in range(1, min(k, REPEATS) + 1):
                        seen[f"{w}*{m}"][label == 0] += 1
            if len(seen) > 300_000:
                yield flush()
        yield flush()

    own = docs.select(F.col("text").cast("string").alias("text"), "label").mapInArrow(run, "term string, pos long, neg long")
    return own.groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def lexicon(docs: DataFrame, neighbours: int = 1) -> list[str]:
    """From labelled documents (text, label), the terms that tell toxic ones from others by their likelihood ratio,
    which must be one that chance gives to less than one of all terms. Terms whose words have fewer different pairs of
    neighbours in toxic documents than asked for are left out, and the others' ratio counts these: copies of a passage
    that differ elsewhere are no proof of their own."""
    total = {r.label: r.n for r in docs.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    p, n = float(total.get(1, 0)), float(total.get(0, 0))
    if not p or not n:
        return []
    counts = term_counts(docs)
    part = lambda c, e: F.when(c > 0, c * F.log(c / e)).otherwise(0.0)
    both = F.col("pos") + F.col("neg")
    sure = 2 * (part(F.col("pos"), both * p / (p + n)) + part(F.col("neg"), both * n / (p + n)))
    least = 2 * math.log(4 * DOC_TERMS * (p + n))
    telling = counts.where((F.col("pos") >= 3) & (F.col("pos") / p >= 20 * (F.col("neg") + 0.5) / n)).withColumn("sure", sure).where(F.col("sure") >= least)
    found = telling.select("term", "pos", "sure").collect()
    known = contexts(docs.where("label = 1"), [r.term for r in found]) if neighbours > 1 else {r.term: r.pos for r in found}
    return choose({r.term: own for r in found if known[r.term] >= neighbours and (own := r.sure * min(1.0, known[r.term] / r.pos)) >= least})


def contexts(docs: DataFrame, terms: list[str]) -> dict[str, int]:
    """How many different pairs of neighbours the terms' words have in the texts."""
    asked = docs.sparkSession.sparkContext.broadcast(frozenset(bare(t) + "*" * ("*" in t) for t in terms))  # terms of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = set()
            for text in b.column(0).to_pylist():
                words = ["", *WORD.findall((text or "").lower()), ""]
                for before, word, after in zip(words, words[1:], words[2:]):
                    found |= {(t, before, after) for t in (word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)) if t in asked.value}
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*found) if found else [()] * 3)], ["term", "before", "after"])

    rows = docs.select("text").mapInArrow(run, "term string, before string, after string").distinct().groupBy("term").count().collect()
    of = {r.term: r["count"] for r in rows}
    return {t: of.get(bare(t) + "*" * ("*" in t), 0) for t in terms}


def choose(sure: dict[str, float]) -> list[str]:
    """Terms, the surest first, of which none is a beginning of another: whole words before the beginnings that are hardly
    surer, long beginnings before short ones."""
    chosen: list[str] = []
    for term in sorted(sure, key=lambda t: (-sure[t] * (1 if "*" in t else 1.02), -len(bare(t)), t)):
        own = bare(term)
        if not any(own.startswith(bare(c)) if "*" in c else "*" in term and bare(c).startswith(own) for c in chosen) and not ("*" in term and any(bare(c).startswith(own) for c in chosen)):
            chosen.append(term)
    return chosen


@dataclass
class Model:
    """The lexicon's automaton and the weights of MEASURES, the intercept last."""

    reader: Automaton
    weights: np.ndarray

    def score(self, text: str | None) -> float:
        x = float(np.dot(measures(self.reader, text or ""), self.weights[:-1]) + self.weights[-1])
        return 1 / (1 + math.exp(-min(max(x, -30.0), 30.0)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", train_rows: int = TRAIN_ROWS) -> Model:
    """Learns the lexicon and the weights from at most train_rows labelled rows, none held out. Labels with nulls or
    without a document teach nothing; where one of both labels is missing every score is one half or their share."""
    spark = docs.sparkSession
    small_batches(spark)
    sample = materialize(learnable(labels, label, train_rows), "sample")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    own = materialize(own, "sample-texts")
    reader = Automaton(lexicon(own.select("text", "label").distinct(), NEIGHBOURS))  # copies of a text tell no more than one

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = pa.array([measures(reader, t or "") for t in b.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), f, b.column(2)], ["doc_id", "f", "label"])

    rows = own.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, f array<double>, label int").orderBy("doc_id", "label").limit(2 * train_rows).toPandas()
    return Model(reader, logistic(np.array(rows.f.tolist(), np.float64).reshape(len(rows), len(MEASURES)), rows.label.to_numpy(np.float64)))


def classify(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with one more column, the chance that the text is toxic.

    Null, empty and repeated texts are scored like others; ids may be null; an empty table gives none; the column
    replaces one of its name, others stay.
    """
    small_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)  # the terms that a bounded sample proves

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = pa.array([known.value.score(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, scores], [*b.schema.names, name])

    own = docs.drop(name)
    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField(name, T.DoubleType())]))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classify(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
