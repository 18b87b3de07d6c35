"""Quality rules as a short-circuit cascade, ordered by what a sample says about each rule.

Each rule is a cheap test of one text. The cost (seconds) and the selectivity (share of texts that
it rejects) of every rule are estimated on a sample; rules then run in the order of rejections per
cost, and a text is rejected by the first rule that it breaks, the rest being skipped. The order
decides the time, never the verdict: a text is kept if and only if it breaks no rule. As costs are
measured, another run may have another order and then name another rule that a text breaks
(``broken_rule``); an ``order`` that is given fixes that.

Defined cases: a null text counts as empty; an empty text has no words and breaks ``few_words``;
repeated rows get the same verdict each; an empty table gives an empty result and the rules run in
the order they are written.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from clicktide.llm.arrow import Batches, keep_rows, per_row
from clicktide.llm.words import SPACES, words_of

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3

# The other rules, in percent or characters.
MAX_SYMBOLS_PERCENT = 20
MAX_DUP_LINES_PERCENT = 50
MAX_UPPER_PERCENT = 50
MAX_SHOUTS_PERCENT = 30
MEAN_WORD_CHARS = (2, 20)

SAMPLE_TEXTS = 2_000


class Measured:
    """The measures of one text, each computed when first asked for."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return words_of(self.text)

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        """Lines that have a word."""
        return [line for line in self.text.split("\n") if line.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words that lie in a window of three words which the text has twice or more."""
        if self.n_words <= WINDOW:
            return 0
        numbers: dict[bytes, int] = {}
        ids = np.array([numbers.setdefault(word, len(numbers)) for word in self.words])
        windows = ids[: 1 - WINDOW]
        for at in range(1, WINDOW):
            # Renumbered after each word, so that the number of a pair stays below n * n.
            ends = ids[at : len(ids) - WINDOW + 1 + at]
            _, windows = np.unique(windows * len(numbers) + ends, return_inverse=True)
        found = np.bincount(windows)[windows] > 1
        covered = np.zeros(len(ids), dtype=bool)
        for at in range(WINDOW):
            covered[at : at + len(found)] |= found
        return int(covered.sum())

    @cached_property
    def upper_percent(self) -> float:
        letters = sum(map(str.isalpha, self.text))
        return 100 * sum(map(str.isupper, self.text)) / letters if letters else 0

    @cached_property
    def n_shouts(self) -> int:
        return sum(word.endswith(b"!!") for word in self.words)


Rule = Callable[[Measured], bool]

# Each says whether a text breaks the rule.
RULES: dict[str, Rule] = {
    "few_words": lambda m: m.n_words < MIN_WORDS,
    "repeated_words": lambda m: 100 * m.n_repeat_words > MAX_REPEAT_PERCENT * m.n_words,
    "symbols": lambda m: 100 * m.n_symbols > MAX_SYMBOLS_PERCENT * m.n_words,
    "duplicate_lines": lambda m: 100 * m.n_dup_lines > MAX_DUP_LINES_PERCENT * len(m.lines),
    "upper_case": lambda m: m.upper_percent > MAX_UPPER_PERCENT,
    "shouts": lambda m: 100 * m.n_shouts > MAX_SHOUTS_PERCENT * m.n_words,
    "word_length": lambda m: not (
        MEAN_WORD_CHARS[0] * m.n_words <= m.word_chars <= MEAN_WORD_CHARS[1] * m.n_words
    ),
}
BASE_RULES = ("few_words", "repeated_words")


def first_broken(measured: Measured, order: list[str]) -> str | None:
    """The first rule in this order that the text breaks; later rules aren't evaluated."""
    return next((name for name in order if RULES[name](measured)), None)


def _trial(batches: Batches) -> Iterator[pa.RecordBatch]:
    """Rejections and nanoseconds of every rule, each with nothing computed beforehand."""
    seen, rejected, spent = 0, dict.fromkeys(RULES, 0), dict.fromkeys(RULES, 0)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen += 1
            for name, rule in RULES.items():
                measured, begin = Measured(text), time.perf_counter_ns()
                rejected[name] += rule(measured)
                spent[name] += time.perf_counter_ns() - begin
    yield pa.RecordBatch.from_pydict(
        {
            "rule": list(RULES),
            "seen": [seen] * len(RULES),
            "rejected": list(rejected.values()),
            "spent": list(spent.values()),
        }
    )


def estimate(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE_TEXTS
) -> DataFrame:
    """Per rule: texts seen, rejections and nanoseconds on about ``sample`` texts of the whole table.

    A row is in the sample by a hash of its id and text, so the order of rows doesn't matter.
    """
    parts = max(1, docs.count() // max(1, sample))
    number = F.xxhash64(F.col(id_col), F.col(text))
    chosen = docs.where(F.pmod(number, F.lit(parts)) == 0).select(F.col(text).alias("text"))
    tried = chosen.mapInArrow(_trial, "rule string, seen long, rejected long, spent long")
    return tried.groupBy("rule").agg(
        F.sum("seen").alias("seen"),
        F.sum("rejected").alias("rejected"),
        F.sum("spent").alias("spent"),
    )


def cascade_order(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE_TEXTS
) -> list[str]:
    """The rules, the one with the most rejections per cost first; ties stay as written."""
    found = {row["rule"]: row for row in estimate(docs, id_col, text, sample).collect()}

    def gain(name: str) -> float:
        row = found.get(name)
        return row["rejected"] / max(1, row["spent"]) if row else 0.0

    return sorted(RULES, key=gain, reverse=True)


MEASURES = StructType(
    [
        StructField(name, LongType())
        for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    ]
    + [
        StructField("base_failed", BooleanType()),
        StructField("kept", BooleanType()),
        StructField("broken_rule", StringType()),
    ]
)


def judge(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", order: list[str] | None = None
) -> DataFrame:
    """Per row: the id, the base measures, ``base_failed``, ``kept`` and the rule that rejected."""
    order = order or cascade_order(docs, id_col, text)

    def make() -> Callable[[list], list]:
        def one(value: str | None) -> tuple:
            m = Measured(value)
            broken = first_broken(m, order)
            base = any(RULES[name](m) for name in BASE_RULES)
            counts = m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words
            return *counts, base, broken is None, broken

        return lambda texts: [one(value) for value in texts]

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    schema = StructType([rows.schema["doc_id"], *MEASURES.fields])
    return per_row(rows, "text", schema, make)


def keep_good(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", order: list[str] | None = None
) -> DataFrame:
    """The rows whose text breaks no rule, with all their columns."""
    order = order or cascade_order(docs, id_col, text)

    def make() -> Callable[[list], list[bool]]:
        return lambda texts: [first_broken(Measured(value), order) is None for value in texts]

    return keep_rows(docs, text, make)
