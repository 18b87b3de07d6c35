"""Language identification by a linear-chain conditional random field over words.

Every word gets a language, so texts may switch between languages. A word's features are its
beginnings and endings, its n-grams of characters and, if the lexicon has it, the word itself; the
weights of transitions between the languages of neighbouring words are learned with them. The
forward and backward pass gives each word's probabilities; a text's are the mean over its words
that have letters. A chain is a line of text.

Learning sees the ``TRAIN_DOCS`` documents with the smallest hash of their id and, of each of the
``LANGUAGES`` most frequent languages, the ``PER_LANGUAGE`` with the smallest, but no held-out ones;
rarer languages can't be predicted.
Of a document above ``TRAIN_CHARS`` characters it sees ``LONG_CHARS``, of lines from all over it.
A document's language is that of all its words; lines of different documents are spliced into
chains, so that switches occur and their weights are learned.

Defined cases: a null text, or one without letters, is ``und`` with score 0; without documents to
learn from every text is; of equal probabilities the language first in the alphabet wins; repeated
rows get the same answer each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from clicktide.llm.arrow import per_row

FOLDS, HELD_OUT_FOLD = 3, 1
UNKNOWN = "und"

TRAIN_DOCS = 1_200
PER_LANGUAGE = 20
LANGUAGES = 200
TRAIN_CHARS = 20_000
LONG_CHARS = 4_000
LEXICON_COUNT = 5
BUCKET_BITS = 17
AFFIX = 4
NGRAMS = (2, 3)
LINES_PER_CHAIN = 3
EPOCHS = 4
CHAINS_PER_STEP = 256
RATE = 0.3
DECAY = 1e-6
SEED = 5
# Parts that the documents of a language are chosen from.
PARTS = 64
# Scores that are kept: of words, and of words and languages together.
KNOWN_WORDS = 200_000
KNOWN_SCORES = 10_000_000

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - BUCKET_BITS)


# --- features --------------------------------------------------------------------------------


def letters_of(word: str) -> str:
    """The word in lower case, from its first letter to its last."""
    low, high = 0, len(word)
    while low < high and not word[low].isalpha():
        low += 1
    while high > low and not word[high - 1].isalpha():
        high -= 1
    return word[low:high].lower()


def features_of(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of words without their punctuation, and the word each belongs to.

    A word without characters has no features. Words of the lexicon have buckets of their own.
    """
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(word) for word in words], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(points))
    buckets, owners = [], []

    def add(at: np.ndarray, of: np.ndarray, n: int, kind: int) -> None:
        hashed = np.full(len(at), 8 * n + kind, dtype=np.uint64)
        for step in range(n):
            hashed = hashed * _FACTOR + points[at + step]
        buckets.append(((hashed * _FACTOR) >> _SHIFT).astype(np.int64))
        owners.append(of)

    for n in range(1, AFFIX + 1):
        long = np.flatnonzero(sizes >= n)
        add(starts[long], long, n, 1)
        add(starts[long] + sizes[long] - n, long, n, 2)
    for n in NGRAMS:
        at = np.flatnonzero(left >= n)
        add(at, owner[at], n, 3)
    known = [(lexicon[word], at) for at, word in enumerate(words) if word in lexicon]
    buckets.append(np.array([bucket for bucket, _ in known], dtype=np.int64))
    owners.append(np.array([at for _, at in known], dtype=np.int64))
    return np.concatenate(buckets), np.concatenate(owners)


# --- model -----------------------------------------------------------------------------------


@dataclass
class Crf:
    languages: list[str] = field(default_factory=list)
    # The lexicon's buckets are behind those of the hashed features.
    lexicon: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))


def _scores(weights: np.ndarray, buckets: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """For each of n words and each language, the summed weights of the word's features."""
    return np.stack(
        [np.bincount(owners, column[buckets], minlength=n) for column in weights.T], axis=1
    )


class Chains:
    """Chains laid end to end, walked step by step, all chains at once."""

    def __init__(self, lengths: np.ndarray) -> None:
        order = np.argsort(-lengths, kind="stable")
        self.starts = (np.cumsum(lengths) - lengths)[order]
        self.lengths = lengths[order]
        self.steps = int(lengths.max(initial=0))

    def at(self, step: int) -> np.ndarray:
        """Positions of the words at this step of the chains that are long enough."""
        return self.starts[: np.searchsorted(-self.lengths, -step, side="left")] + step


def _normal(rows: np.ndarray) -> np.ndarray:
    return rows / rows.sum(axis=1, keepdims=True)


def forward_backward(
    scores: np.ndarray, transitions: np.ndarray, chains: Chains
) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the languages of each word, and expected numbers of transitions."""
    emitted = np.exp(scores - scores.max(axis=1, keepdims=True))
    step_to = np.exp(transitions - transitions.max())
    forward = np.empty_like(emitted)
    last = None
    for step in range(chains.steps):
        here = chains.at(step)
        coming = emitted[here] if last is None else (last[: len(here)] @ step_to) * emitted[here]
        last = forward[here] = _normal(coming)
    expected = np.zeros_like(step_to)
    found = np.empty_like(emitted)
    behind = np.ones((len(chains.lengths), emitted.shape[1]))
    for step in range(chains.steps - 1, -1, -1):
        here = chains.at(step)
        after = chains.at(step + 1)
        if len(after):
            ahead = emitted[after] * behind[: len(after)]
            reached = ahead @ step_to.T
            before = forward[here[: len(after)]]
            total = (before * reached).sum(axis=1, keepdims=True)
            expected += ((before / total).T @ ahead) * step_to
            behind[: len(after)] = _normal(reached)
        found[here] = _normal(forward[here] * behind[: len(here)])
    return found, expected


def fit(docs: list[tuple[str, str]]) -> Crf:
    """Learn from documents (text, language)."""
    languages = sorted({language for _, language in docs})
    lines = [
        (languages.index(language), words)
        for text, language in docs
        for line in text.split("\n")
        if (words := [letters_of(word) for word in line.split()])
    ]
    counts = Counter(word for _, words in lines for word in words)
    common = [word for word, n in counts.items() if word and n >= LEXICON_COUNT]
    model = Crf(languages, {word: (1 << BUCKET_BITS) + at for at, word in enumerate(common)})
    model.weights = np.zeros(((1 << BUCKET_BITS) + len(common), len(languages)))
    model.transitions = np.zeros((len(languages), len(languages)))
    if not lines:
        return model
    vocabulary = list(counts)
    number = {word: at for at, word in enumerate(vocabulary)}
    tokens = [np.array([number[word] for word in words]) for _, words in lines]
    random = np.random.default_rng(SEED)
    # Sums of squared gradients, for steps that shrink where there have been many.
    seen_weights = np.full_like(model.weights, 1e-3)
    seen_steps = np.ones_like(model.transitions)
    for _ in range(EPOCHS):
        order = random.permutation(len(lines))
        for start in range(0, len(order), CHAINS_PER_STEP * LINES_PER_CHAIN):
            chosen = order[start : start + CHAINS_PER_STEP * LINES_PER_CHAIN]
            line_lengths = np.array([len(tokens[x]) for x in chosen])
            lengths = np.add.reduceat(line_lengths, np.arange(0, len(chosen), LINES_PER_CHAIN))
            words = np.concatenate([tokens[x] for x in chosen])
            truth = np.concatenate([np.full(len(tokens[x]), lines[x][0]) for x in chosen])
            kinds, place = np.unique(words, return_inverse=True)
            own, owners = features_of([vocabulary[kind] for kind in kinds], model.lexicon)
            chains = Chains(lengths)
            scores = _scores(model.weights, own, owners, len(kinds))
            found, expected = forward_backward(scores[place], model.transitions, chains)
            miss = -found
            miss[np.arange(len(truth)), truth] += 1
            first = np.ones(len(truth), dtype=bool)
            first[chains.starts] = False
            pairs = truth[:-1][first[1:]] * len(languages) + truth[1:][first[1:]]
            actual = np.bincount(pairs, minlength=expected.size).reshape(expected.shape)
            n = len(truth)
            for at in range(len(languages)):
                by_kind = np.bincount(place, miss[:, at], minlength=len(kinds))
                step = np.bincount(own, by_kind[owners], minlength=len(model.weights))
                step = step / n - DECAY * model.weights[:, at]
                seen_weights[:, at] += n * step**2
                model.weights[:, at] += RATE * np.sqrt(n / seen_weights[:, at]) * step
            step = (actual - expected) / n
            seen_steps += n * step**2
            model.transitions += RATE * np.sqrt(n / seen_steps) * step
    # Half the size for the tasks, which all hold it.
    model.weights = model.weights.astype(np.float32)
    return model


class Labeller:
    """Applies a model to texts; the scores of words are kept between texts, up to a bound."""

    def __init__(self, model: Crf, known_words: int = KNOWN_WORDS) -> None:
        self.model = model
        self.known_words = min(known_words, KNOWN_SCORES // max(1, len(model.languages)))
        self._forget()

    def _forget(self) -> None:
        self._number: dict[str, int] = {}
        self._scores = np.zeros((0, len(self.model.languages)), dtype=np.float32)
        self._lettered = np.zeros(0, dtype=bool)

    def _numbers(self, lines: list[list[str]]) -> list[int]:
        """The row of each word in the table of scores, which is filled up first."""
        if len(self._number) > self.known_words:
            self._forget()
        number, new = self._number, []
        found = []
        for words in lines:
            for word in words:
                at = number.get(word)
                if at is None:
                    at = number[word] = len(number)
                    new.append(letters_of(word))
                found.append(at)
        if new and self.model.languages:
            features = features_of(new, self.model.lexicon)
            made = _scores(self.model.weights, *features, len(new)).astype(np.float32)
            self._scores = np.concatenate([self._scores, made])
        if new:
            lettered = np.array([bool(word) for word in new])
            self._lettered = np.concatenate([self._lettered, lettered])
        return found

    def words(self, texts: list[str | None]) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
        """Per text: its words, each word's probabilities, and whether it has letters."""
        lines, owner = [], []
        for at, text in enumerate(texts):
            for line in (text or "").split("\n"):
                if words := line.split():
                    lines.append(words)
                    owner.append(at)
        lengths = np.array([len(words) for words in lines], dtype=np.int64)
        numbers = np.array(self._numbers(lines), dtype=np.int64)
        if len(numbers) and self.model.languages:
            found, _ = forward_backward(
                self._scores[numbers].astype(np.float64), self.model.transitions, Chains(lengths)
            )
        else:
            found = np.zeros((len(numbers), len(self.model.languages)))
        lettered = self._lettered[numbers]
        per_text = np.bincount(np.array(owner, dtype=np.int64), lengths, minlength=len(texts))
        ends = np.cumsum(per_text).astype(np.int64) if len(texts) else []
        of: list[list[str]] = [[] for _ in texts]
        for at, words in zip(owner, lines):
            of[at].extend(words)
        starts = [0, *ends[:-1]]
        return [
            (of[at], found[start:end], lettered[start:end])
            for at, (start, end) in enumerate(zip(starts, ends))
        ]

    def text_languages(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Per text: its language and the mean probability of it."""
        answers = []
        for _, found, lettered in self.words(texts):
            if not self.model.languages or not lettered.any():
                answers.append((UNKNOWN, 0.0))
                continue
            mean = found[lettered].mean(axis=0)
            best = int(np.argmax(mean))
            answers.append((self.model.languages[best], float(min(1.0, mean[best]))))
        return answers


# --- on Spark --------------------------------------------------------------------------------


def held_out(id_col: str | Column) -> Column:
    """Whether learning never sees the row with this id."""
    number = F.crc32((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string"))
    return F.coalesce(F.pmod(number, F.lit(FOLDS)) == HELD_OUT_FOLD, F.lit(False))


def _excerpt() -> Column:
    """Every n-th line of a long text that has words, up to ``LONG_CHARS`` characters."""
    lines = F.filter(F.split("text", "\n"), lambda line: F.trim(line) != "")
    step = F.ceil(F.length("text") / LONG_CHARS)
    some = F.filter(lines, lambda _, at: at % step == 0)
    return F.substring(F.array_join(some, "\n"), 1, LONG_CHARS)


def _smallest(known: DataFrame, rows: int) -> DataFrame:
    """The ids with the smallest hashes; of a large table only those below a bound are ordered."""
    total = known.count()
    share = min(1.0, 4 * rows / max(1, total))
    bound = min(2**63 - 1, int(share * 2**64) - 2**63)
    below = known.where(F.xxhash64("id") <= F.lit(bound))
    for some in (below, known):
        found = some.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(rows)
        # Ids that repeat may leave too few below the bound.
        if share == 1.0 or found.count() == rows:
            break
    return found


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    language: str = "lang",
    rows: int = TRAIN_DOCS,
) -> Crf:
    """Learn from ``rows`` documents with a language that aren't held out, and some of each language."""
    known = docs.select(
        F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(language).alias("language")
    ).where(
        F.col("id").isNotNull()
        & F.col("language").isNotNull()
        & F.col("text").isNotNull()
        & ~held_out("id")
    )
    languages = (
        known.groupBy("language")
        .agg(F.count(F.lit(1)).alias("docs"))
        .orderBy(F.col("docs").desc(), "language")
        .limit(LANGUAGES)
        .select("language")
    )
    # Of each language the smallest of every part, and of these the smallest: so no task gets more
    # than a part of a frequent language.
    part = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(PARTS)).alias("part")
    of_each = known.select("id", "language", part).distinct().join(F.broadcast(languages), "language")
    for keys in (("language", "part"), ("language",)):
        in_order = Window.partitionBy(*keys).orderBy(F.xxhash64("id"), "id")
        of_each = of_each.withColumn("place", F.row_number().over(in_order))
        of_each = of_each.where(F.col("place") <= PER_LANGUAGE).drop("place")
    of_each = of_each.select("id").distinct()
    # Ids first, so that no more texts than needed are moved; at most ``rows`` ids, and
    # PER_LANGUAGE * LANGUAGES, are broadcast.
    chosen = _smallest(known, rows).union(of_each).distinct()
    once = (
        known.join(F.broadcast(chosen), "id")
        .withColumn("text", F.when(F.length("text") <= TRAIN_CHARS, F.col("text")).otherwise(_excerpt()))
        .groupBy("id")
    )
    texts = once.agg(F.min(F.struct("text", "language")).alias("one")).orderBy("id")
    sample = texts.select("one.text", "one.language").collect()
    return fit([(row["text"], row["language"]) for row in sample])


def identify(docs: DataFrame, model: Crf, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, ``lang_pred`` and ``score``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    schema = StructType(
        [
            rows.schema["doc_id"],
            StructField("lang_pred", StringType()),
            StructField("score", DoubleType()),
        ]
    )
    return per_row(rows, "text", schema, lambda: Labeller(model).text_languages)


def label_words(
    docs: DataFrame, model: Crf, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: the id and the language of each word, in order; words without letters too."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    schema = StructType(
        [rows.schema["doc_id"], StructField("languages", ArrayType(StringType()))]
    )

    def make() -> Callable[[list], list]:
        labeller, names = Labeller(model), np.array([*model.languages, UNKNOWN], dtype=object)

        def of(texts: list[str | None]) -> list[tuple]:
            return [
                (names[found.argmax(axis=1) if found.size else [-1] * len(words)].tolist(),)
                for words, found, _ in labeller.words(texts)
            ]

        return of

    return per_row(rows, "text", schema, make)
