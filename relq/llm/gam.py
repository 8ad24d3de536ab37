"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features, each time adding a small tree of one feature's bins to that feature's table; then
round the pairs of features with the most left to explain, adding small trees of two features to their tables. A
document's score is the sigmoid of an intercept and its bins' entries. Features are measured on whole texts; the
model is fitted on a bounded number of labelled rows.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, learnable, materialize, small_batches, table

#: Labelled rows that the model is fitted on at most.
TRAIN_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 12, 8
NAMES = (
    "log_chars", "log_words", "word_length", "distinct_words", "distinct_pairs", "distinct_lines", "line_words", "upper",
    "digits", "spaces", "stops", "exclaims", "symbols", "foreign", "entropy", "short_words", "sentence_words", "longest_word",
)
LOWER, UPPER, DIGIT, SPACE, STOP, EXCLAIM, SYMBOL, FOREIGN = range(8)


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point of the first plane."""
    found = np.full(1 << 16, FOREIGN, np.uint8)
    for cp in range(1 << 16):
        c = chr(cp)
        kind = unicodedata.category(c)
        if c.isspace():
            found[cp] = SPACE
        elif kind == "Lu":
            found[cp] = UPPER
        elif kind[0] == "L":
            found[cp] = LOWER
        elif kind[0] == "N":
            found[cp] = DIGIT
        elif c in ".,;:'\"-()":
            found[cp] = STOP
        elif c in "!?":
            found[cp] = EXCLAIM
        elif kind[0] in "PS":
            found[cp] = SYMBOL
    return found


def features(text: str) -> list[float]:
    """The measures in NAMES; shares are 0 where there is nothing to count."""
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = max(1, len(cps))
    kinds = np.bincount(classes()[np.minimum(cps, 0xFFFF)], minlength=8) / n
    share = np.bincount(cps & 0xFF, minlength=256) / n
    share = share[share > 0]
    words, lines = text.split(), [x for x in text.split("\n") if x]
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    return [
        float(np.log1p(len(cps))), float(np.log1p(len(words))), float(lengths.mean()), len(set(words)) / m, len(set(zip(words, words[1:]))) / m, len(set(lines)) / max(1, len(lines)),
        m / max(1, len(lines)), kinds[UPPER], kinds[DIGIT], kinds[SPACE], kinds[STOP], kinds[EXCLAIM], kinds[SYMBOL], kinds[FOREIGN], float(-(share * np.log(share)).sum()),
        float((lengths <= 2).mean()), m / (1 + text.count(".")), float(np.log1p(lengths.max())),
    ]


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    mains: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, t in enumerate(self.mains):
            total += t[np.searchsorted(self.edges[f], x[:, f], "right")]
        low = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.coarse)]
        for i, j, t in self.pairs:
            total += t[low[i], low[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The best gain of cutting these bins in two, and the first bin after the cut."""
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(a):
        return 0.0, 0
    gain = a**2 / (b + 1) + (g.sum() - a) ** 2 / (h.sum() - b + 1) - g.sum() ** 2 / (h.sum() + 1)
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """A value for each bin: those of a tree with so many leaves, grown by the best gain."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, k, i = max((*_cut(g[a:b], h[a:b]), i) for i, (a, b) in enumerate(parts))
        if gain <= 1e-6:
            break
        a, b = parts[i]
        parts[i : i + 1] = [(a, a + k), (a + k, b)]
    value = np.zeros(len(g))
    for a, b in parts:
        value[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return value


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The gain and values of the best tree that cuts the rows once and the columns once on either side."""
    best, value = 0.0, np.zeros(g.shape)
    up_g, up_h = np.cumsum(g, 0), np.cumsum(h, 0)
    for r in range(1, len(g)):
        sides = ((up_g[r - 1], up_h[r - 1]), (up_g[-1] - up_g[r - 1], up_h[-1] - up_h[r - 1]))
        gain = sum(_cut(*s)[0] + s[0].sum() ** 2 / (s[1].sum() + 1) for s in sides)
        if gain > best:
            best, value = gain, np.zeros(g.shape)
            for (sg, sh), rows in zip(sides, (slice(0, r), slice(r, None))):
                _, c = _cut(sg, sh)
                for cols in (slice(0, c), slice(c, None)):
                    value[rows, cols] = sg[cols].sum() / (sh[cols].sum() + 1)
    return best, value


def fit(x: np.ndarray, y: np.ndarray, cycles: int = 60, pair_cycles: int = 20, rate: float = 0.15) -> Model:
    """Fits the tables. Without rows the model says one half."""
    if not len(y):
        return Model(0.0)
    p = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(float(np.log(p / (1 - p))))
    cut = lambda c, n: np.unique(np.quantile(c, np.linspace(0, 1, n + 1)[1:-1]))
    model.edges, model.coarse = ([cut(x[:, f], n) for f in range(x.shape[1])] for n in (BINS, PAIR_BINS))
    fine, low = ([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(es)] for es in (model.edges, model.coarse))
    total = np.full(len(y), model.intercept)
    model.mains = [np.zeros(len(e) + 1) for e in model.edges]

    def left() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return y - q, q * (1 - q)

    for _ in range(cycles):
        for f, t in enumerate(model.mains):
            g, h = left()
            add = rate * _tree(np.bincount(fine[f], g, len(t)), np.bincount(fine[f], h, len(t)))
            t += add
            total += add[fine[f]]
    sizes = [len(e) + 1 for e in model.coarse]

    def sums(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(low[i] * sizes[j] + low[j], v, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])

    g, h = left()
    gains = sorted(((_pair_tree(sums(i, j, g), sums(i, j, h))[0], i, j) for i, j in itertools.combinations(range(x.shape[1]), 2)), reverse=True)
    model.pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for _, i, j in gains[:PAIRS]]
    for _ in range(pair_cycles):
        for i, j, t in model.pairs:
            g, h = left()
            add = rate * _pair_tree(sums(i, j, g), sums(i, j, h))[1]
            t += add
            total += add[low[i], low[j]]
    return model


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, f): each text's measures; a null text is the empty one."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = pa.array([features(t or "") for t in b.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), f], ["doc_id", "f"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, f array<double>")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, score) for each row of docs; the score is the chance that the label is 1.

    Learns from at most train_rows labelled rows, none held out; labels with nulls or without a document teach
    nothing, and without any every score is one half. Null, empty and repeated texts are scored like others; ids may
    be null; an empty table gives none; other columns are ignored.
    """
    own = materialize(measured(docs), "measures")
    sample = learnable(labels, label, train_rows)
    rows = own.join(sample, "doc_id").orderBy("doc_id", "label").limit(2 * train_rows).select("label", "f").toPandas()
    model = fit(np.array(rows.f.tolist(), np.float64).reshape(len(rows), len(NAMES)), rows.label.to_numpy(np.float64))
    known = docs.sparkSession.sparkContext.broadcast(model)  # tables of a fixed number of bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(known.value.score(x))], ["doc_id", "score"])

    return own.mapInArrow(run, "doc_id long, score double")


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    scored = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
