"""Quality classifier: a generalised additive model with pairwise interactions.

The score of a text is the logistic function of a sum of table look-ups: one table per feature over
its bins, and one per chosen pair of features over pairs of bins. The tables are learned by cyclic
boosting: round after round, each feature in turn gets a shallow tree on its bins, fitted to what
is left to explain, at a small rate. Pairs are chosen by how much of the rest a cut in both features
explains, and boosted the same way. Scoring adds up bins of a whole batch of texts at once.

Learning sees at most ``TRAIN_ROWS`` labelled documents, those with the smallest hash of their id,
and none of the held-out ones; features are counted over whole texts, by Spark tasks. Labels, ids,
language and source are no features.

Defined cases: a null text counts as empty, and an empty text has a score too, from its features,
all zero; several labels of one id count by their mean; without labelled rows every score is 0.5,
with labels of one kind only it is near that kind; repeated rows get the same score each; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from clicktide.llm.arrow import keep_rows, per_row
from clicktide.llm.words import words_of

FOLDS = 5
THRESHOLD = 0.3
TRAIN_ROWS = 20_000

BINS = 24
PAIR_BINS = 8
PAIRS = 6
ROUNDS = 150
PAIR_ROUNDS = 60
RATE = 0.1
RIDGE = 1.0


# --- features --------------------------------------------------------------------------------

FEATURES = (
    "log_words",
    "mean_word",
    "distinct_words",
    "same_as_last",
    "top_word",
    "short_words",
    "words_per_line",
    "repeated_lines",
    "upper",
    "digits",
    "stops",
    "bangs",
    "bars",
    "symbols",
    "beyond_ascii",
)

_UPPER, _DIGITS = slice(ord("A"), ord("Z") + 1), slice(ord("0"), ord("9") + 1)
_STOPS = [ord(c) for c in ".,;:?"]
_SYMBOLS = [ord(c) for c in "#*$%&<>"]


def features(text: str | None) -> list[float]:
    """The features of a whole text; shares are per byte or per word."""
    words = words_of(text)
    if not words:
        return [0.0] * len(FEATURES)
    data = text.encode()
    byte = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    n, size = len(words), len(data)
    counts: dict[bytes, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    lines = [line for line in data.split(b"\n") if line.strip()]
    return [
        float(np.log1p(n)),
        sum(map(len, words)) / n,
        len(counts) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        max(counts.values()) / n,
        sum(len(word) < 4 for word in words) / n,
        float(np.log1p(n / len(lines))),
        1 - len(set(lines)) / len(lines),
        byte[_UPPER].sum() / size,
        byte[_DIGITS].sum() / size,
        byte[_STOPS].sum() / n,
        byte[ord("!")] / n,
        byte[ord("|")] / n,
        byte[_SYMBOLS].sum() / n,
        byte[128:].sum() / size,
    ]


# --- model -----------------------------------------------------------------------------------


@dataclass
class Gam:
    """Cuts and tables; ``pairs`` has two features, the cuts of each and a table."""

    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of features."""
        total = np.full(len(rows), self.base)
        for at, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, rows[:, at], side="right")]
        for a, b, cuts_a, cuts_b, table in self.pairs:
            total += table[
                np.searchsorted(cuts_a, rows[:, a], side="right"),
                np.searchsorted(cuts_b, rows[:, b], side="right"),
            ]
        return 1 / (1 + np.exp(-total))


def _quantile_cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins; place 0 is no cut."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    at = int(np.argmax(gains))
    return (float(gains[at]), at + 1) if gains[at] > 1e-9 else (0.0, 0)


def _shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values of the bins by a tree of depth two: a cut, and a cut on each side of it."""
    cuts = [0, len(g)]
    first = _best_cut(g, h)[1]
    if first:
        cuts = [0, first, len(g)]
        left = _best_cut(g[:first], h[:first])[1]
        right = _best_cut(g[first:], h[first:])[1]
        cuts = sorted({0, left, first, first + right, len(g)})
    values = np.empty(len(g))
    for start, end in zip(cuts, cuts[1:]):
        values[start:end] = g[start:end].sum() / (h[start:end].sum() + RIDGE)
    return values


def _corner_sums(grid: np.ndarray) -> np.ndarray:
    """Sums of a grid's upper left corners, for every inner cut of both sides."""
    return grid.cumsum(0).cumsum(1)[:-1, :-1]


def _best_cross(g: np.ndarray, h: np.ndarray) -> tuple[float, int, int]:
    """Gain and places of the best pair of cuts, which makes four leaves."""
    if min(g.shape) < 2:
        return 0.0, 0, 0
    total = -_gain(g.sum(), h.sum())
    gains = np.full((g.shape[0] - 1, g.shape[1] - 1), total)
    for flip_a in (False, True):
        for flip_b in (False, True):
            step = (slice(None, None, -1 if flip_a else 1), slice(None, None, -1 if flip_b else 1))
            gains += _gain(_corner_sums(g[step]), _corner_sums(h[step]))[step]
    a, b = np.unravel_index(int(np.argmax(gains)), gains.shape)
    return float(gains[a, b]), int(a) + 1, int(b) + 1


def _cross_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    values = np.zeros_like(g)
    gain, a, b = _best_cross(g, h)
    if gain > 1e-9:
        for rows in (slice(0, a), slice(a, None)):
            for columns in (slice(0, b), slice(b, None)):
                part = g[rows, columns].sum() / (h[rows, columns].sum() + RIDGE)
                values[rows, columns] = part
    return values


def fit(rows: np.ndarray, labels: np.ndarray) -> Gam:
    """Learn a model from rows of features and labels 0 and 1."""
    if not len(labels):
        return Gam()
    share = np.clip(labels.mean(), 0.01, 0.99)
    model = Gam(base=float(np.log(share / (1 - share))))
    if labels.min() == labels.max():
        return model
    total = np.full(len(labels), model.base)

    def rest() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return labels - p, p * (1 - p)

    model.cuts = [_quantile_cuts(rows[:, at], BINS) for at in range(rows.shape[1])]
    model.tables = [np.zeros(len(cuts) + 1) for cuts in model.cuts]
    bins = [np.searchsorted(c, rows[:, at], side="right") for at, c in enumerate(model.cuts)]
    for _ in range(ROUNDS):
        for at, own in enumerate(bins):
            g, h = rest()
            size = len(model.tables[at])
            step = RATE * _shallow_tree(
                np.bincount(own, g, minlength=size), np.bincount(own, h, minlength=size)
            )
            model.tables[at] += step
            total += step[own]

    coarse = [_quantile_cuts(rows[:, at], PAIR_BINS) for at in range(rows.shape[1])]
    places = [np.searchsorted(c, rows[:, at], side="right") for at, c in enumerate(coarse)]

    def grids(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = len(coarse[a]) + 1, len(coarse[b]) + 1
        cell = places[a] * shape[1] + places[b]
        g, h = rest()
        sums = [np.bincount(cell, x, minlength=shape[0] * shape[1]).reshape(shape) for x in (g, h)]
        return cell, *sums

    found = [(_best_cross(*grids(a, b)[1:])[0], a, b) for a, b in combinations(range(len(bins)), 2)]
    chosen = [(a, b) for gain, a, b in sorted(found, reverse=True)[:PAIRS] if gain > 0]
    tables = {pair: np.zeros((len(coarse[pair[0]]) + 1, len(coarse[pair[1]]) + 1)) for pair in chosen}
    for _ in range(PAIR_ROUNDS):
        for pair in chosen:
            cell, g, h = grids(*pair)
            step = RATE * _cross_tree(g, h)
            tables[pair] += step
            total += step.ravel()[cell]
    model.pairs = [(a, b, coarse[a], coarse[b], tables[a, b]) for a, b in chosen]
    return model


# --- on Spark --------------------------------------------------------------------------------


def held_out(id_col: str | Column) -> Column:
    """Whether learning never sees the row with this id."""
    number = F.crc32((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string"))
    return F.coalesce(F.pmod(number, F.lit(FOLDS)) == 0, F.lit(False))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    rows: int = TRAIN_ROWS,
) -> Gam:
    """Learn from at most ``rows`` labelled documents that aren't held out."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label).alias("label"))
    sample = (
        known.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg((F.avg("label") >= 0.5).cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    # At most ``rows`` pairs of numbers are broadcast.
    labelled = own.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")
    schema = StructType(
        [
            labelled.schema["doc_id"],
            labelled.schema["label"],
            StructField("features", ArrayType(DoubleType())),
        ]
    )
    made = per_row(
        labelled, "text", schema, lambda: lambda texts: [(features(value),) for value in texts]
    )
    # Repeated ids count once, so what comes to the driver is bounded by ``rows``.
    once = made.groupBy("doc_id").agg(
        F.min("label").alias("label"), F.min("features").alias("features")
    )
    found = once.orderBy("doc_id").toArrow()
    if not found.num_rows:
        return Gam()
    matrix = np.array(found.column("features").to_pylist(), dtype=float)
    return fit(matrix, found.column("label").to_numpy())


def score(docs: DataFrame, model: Gam, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id and ``score``, the probability of label 1."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    schema = StructType([rows.schema["doc_id"], StructField("score", DoubleType())])

    def make() -> Callable[[list], list]:
        return lambda texts: [(value,) for value in _scores(model, texts)]

    return per_row(rows, "text", schema, make)


def keep_good(
    docs: DataFrame, model: Gam, text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The rows whose score is at least the threshold, with all their columns."""

    def make() -> Callable[[list], list[bool]]:
        return lambda texts: [value >= threshold for value in _scores(model, texts)]

    return keep_rows(docs, text, make)


def _scores(model: Gam, texts: list[str | None]) -> list[float]:
    if not texts:
        return []
    return model.score(np.array([features(value) for value in texts])).tolist()
