"""Periodic runs of words by string synchronising sets.

A run is a longest stretch of words with smallest period q (words q apart are equal) that holds its
period at least ``POWER`` times and has ``LENGTH`` words or more. All runs of a text are found:

1. Highly periodic regions. Periods up to ``SMALL`` are found by comparing the words that far apart.
2. Synchronising sets. At every scale t (a power of two above ``SMALL``) a position belongs to the
   set if, of the windows of t words that start on it and up to t words behind, the one with the
   least hash is the first or the last. Windows inside a region with a period of up to t / 4 are left
   out; those regions are runs (of four periods or more) that smaller scales have supplied. Whether
   a position is in the set depends on its next 2t words alone, so equal contexts give equal choices,
   and each stretch of t positions has one unless all its windows were left out.
3. Proposals. A run with a period q from t to 2t - 1 has a position of the set in its first t ones,
   and the next position with the same context is q words on: an earlier one would give the run a
   smaller period. So neighbours with equal contexts, t to 2t - 1 apart, propose all such periods.
4. A proposal is extended word by word to both sides, which also confirms it: hashes decide only what
   is looked at. Work per scale is in proportion to the words.

The texts of a batch are searched together, with a different stop word between any two. A text is
searched whole in the task that reads it; there is no shuffle.

Defined cases: a null or empty text, or one without words, has no runs; so has one of fewer than
``LENGTH`` words. Repeated rows give repeated results, a null id is an id like others (``repeated``
leaves its text alone), an empty table an empty result. Other columns of the table are not read by
``find_runs`` and ``run_digests`` and are kept by ``collapse``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clicktide.llm.arrow import per_row
from clicktide.llm.words import mixed, words_of

POWER = 4
LENGTH = 6
# Periods up to this are compared directly; the first scale is one above.
SMALL = 3
# Texts are searched together up to so many words; a longer one is searched alone.
WORDS_AT_ONCE = 1 << 16

_LEFT_OUT = np.uint64(np.iinfo(np.uint64).max)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)

Run = tuple[int, int, int]


# --- runs in a sequence of numbers -----------------------------------------------------------


def stretches(words: np.ndarray, period: int) -> list[Run]:
    """Longest (start, end, period) of at least ``POWER`` times the period, by direct comparison."""
    if len(words) < POWER * period:
        return []
    same = np.zeros(len(words) - period + 2, dtype=np.int8)
    same[1:-1] = words[period:] == words[:-period]
    turns = np.flatnonzero(np.diff(same))
    starts, ends = turns[::2], turns[1::2] + period
    long = ends - starts >= POWER * period
    return [(s, e, period) for s, e in zip(starts[long].tolist(), ends[long].tolist())]


def least_ahead(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values, in time that doesn't depend on the width."""
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, _LEFT_OUT)
    padded[: len(values)] = values
    table = padded.reshape(blocks, width)
    before = np.minimum.accumulate(table, axis=1).ravel()
    after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    last = len(values) - width + 1
    return np.minimum(after[:last], before[width - 1 : width - 1 + last])


def doubled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of windows of twice the width."""
    return mixed(hashes[:-width] * _FACTOR + hashes[width:])


def inside(runs: list[Run], scale: int, n: int) -> np.ndarray:
    """Which windows of ``scale`` words lie in a region with a period of up to a quarter of it."""
    steps = np.zeros(n - scale + 2, dtype=np.int32)
    for start, end, period in runs:
        if POWER * period <= scale <= end - start:
            steps[start] += 1
            steps[end - scale + 1] -= 1
    return np.cumsum(steps[:-1]) > 0


def proposals(windows: np.ndarray, contexts: np.ndarray, left_out: np.ndarray, scale: int) -> list:
    """(period, position) of neighbours in the synchronising set that have equal contexts."""
    ranks = np.where(left_out, _LEFT_OUT, windows)
    least = least_ahead(ranks, scale + 1)
    n = len(least)
    chosen = (least != _LEFT_OUT) & ((ranks[:n] == least) | (ranks[scale : scale + n] == least))
    at = np.flatnonzero(chosen)
    order = np.argsort(contexts[at], kind="stable")
    at, context = at[order], contexts[at[order]]
    apart = at[1:] - at[:-1]
    good = (context[1:] == context[:-1]) & (apart >= scale) & (apart < 2 * scale)
    return sorted(zip(apart[good].tolist(), at[:-1][good].tolist()))


def _matches(a: np.ndarray, b: np.ndarray) -> int:
    """How many of the first values of a and b are the same."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        same = a[at : min(n, at + step)] == b[at : min(n, at + step)]
        if not same.all():
            return at + int(same.argmin())
        at, step = at + len(same), step * 2
    return n


def extended(words: np.ndarray, position: int, period: int) -> Run:
    """The longest stretch with the period around a position."""
    end = position + period + _matches(words[position:], words[position + period :])
    start = position - _matches(words[:position][::-1], words[: position + period][::-1])
    return start, end, period


def runs_in(words: np.ndarray, longest: int) -> list[Run]:
    """All (start, end, period) that hold their smallest period ``POWER`` times.

    ``longest``: no run has more words than this.
    """
    found: dict[tuple[int, int], int] = {}

    def add(run: Run) -> None:
        start, end, period = run
        if end - start >= POWER * period:
            # A stretch with a multiple of its smallest period has been found with that before.
            found.setdefault((start, end), period)

    for period in range(1, SMALL + 1):
        for run in stretches(words, period):
            add(run)
    hashes, width = mixed(words.astype(np.uint64) * _FACTOR), 1
    while width <= SMALL:
        hashes, width = doubled(hashes, width), 2 * width
    while POWER * width <= min(longest, len(words)):
        contexts = doubled(hashes, width)
        known = [(start, end, period) for (start, end), period in found.items()]
        last = (0, 0, 0)
        for period, position in proposals(hashes, contexts, inside(known, width, len(words)), width):
            if period != last[2] or position >= last[1] - period:
                last = extended(words, position, period)
                add(last)
        hashes, width = contexts, 2 * width
    return [(start, end, period) for (start, end), period in found.items()]


# --- runs of texts ---------------------------------------------------------------------------


def _together(texts: list[list[bytes]]) -> Iterator[list[int]]:
    """Numbers of texts that are searched together."""
    chunk, size = [], 0
    for at, words in enumerate(texts):
        if chunk and size + len(words) > WORDS_AT_ONCE:
            yield chunk
            chunk, size = [], 0
        chunk.append(at)
        size += len(words) + 1
    if chunk:
        yield chunk


def runs_of(texts: list[list[bytes]]) -> list[list[Run]]:
    """For each list of words its runs (start, length, period), by start, then period."""
    result: list[list[Run]] = [[] for _ in texts]
    for chunk in _together(texts):
        numbers: dict[bytes, int] = {}
        parts, starts, n = [], [], 0
        for place, at in enumerate(chunk):
            own = [numbers.setdefault(word, len(numbers)) for word in texts[at]]
            parts += [np.array(own, dtype=np.int64), np.array([-1 - place], dtype=np.int64)]
            starts.append(n)
            n += len(own) + 1
        longest = max(len(texts[at]) for at in chunk)
        for start, end, period in runs_in(np.concatenate(parts), longest):
            if end - start >= LENGTH:
                place = int(np.searchsorted(starts, start, "right")) - 1
                result[chunk[place]].append((start - starts[place], end - start, period))
    for own in result:
        own.sort(key=lambda run: (run[0], run[2]))
    return result


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    steps = np.zeros(len(words) + 1, dtype=np.int32)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return [words[at] for at in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]


def repeated(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the texts, chosen by a checksum of the id, go over into a repetition."""
    checksum = zlib.crc32(str(doc_id).encode())
    group, n = checksum // 10, len(words)
    if doc_id is None or checksum % 10 or not n:
        return words
    start = group % n
    period = 1 + (n - start) // (3 + group % 8)
    cycle = words[start : start + period]
    return words[:start] + (cycle * -(-(n - start) // period))[: n - start]


# --- the operator ----------------------------------------------------------------------------


def _per_text(
    docs: DataFrame, id_col: str, text: str, result: str, make: Callable[[], Callable]
) -> DataFrame:
    own = docs.select(
        F.col(id_col).alias("doc_id"),
        F.struct(F.col(id_col).alias("id"), F.col(text).alias("text")).alias("__own"),
    )
    schema = StructType([own.schema["doc_id"], *StructType.fromDDL(result).fields])
    return per_row(own, "__own", schema, make)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id and ``runs``, an array of (start, length, period) by start, then period."""

    def make() -> Callable:
        def function(rows: list[dict]) -> list[tuple]:
            names = ("start", "length", "period")
            found = runs_of([words_of(row["text"]) for row in rows])
            return [([dict(zip(names, run)) for run in own],) for own in found]

        return function

    return _per_text(
        docs, id_col, text, "runs array<struct<start:long,length:long,period:long>>", make
    )


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """The table with each run cut down to its first period.

    Words of a text that has runs are joined by one space; other texts stay as they are.
    """

    def make() -> Callable:
        def function(texts: list[str | None]) -> list[tuple]:
            words = [words_of(value) for value in texts]
            return [
                (b" ".join(kept_words(own, runs)).decode() if runs else value,)
                for value, own, runs in zip(texts, words, runs_of(words))
            ]

        return function

    others = [docs.schema[name] for name in docs.columns if name != text]
    schema = StructType([*others, docs.schema[text]])
    return per_row(docs, text, schema, make).select(*docs.columns)


_DIGESTS = (
    "n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def run_digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row the number of runs, the longest, and digests of all runs and of the collapsed text.

    The texts are those of ``repeated``. Of runs of one length the first counts as the longest, then
    the one with the smallest period.
    """

    def make() -> Callable:
        def function(rows: list[dict]) -> list[tuple]:
            words = [repeated(row["id"], words_of(row["text"])) for row in rows]
            return [_digest(own, runs) for own, runs in zip(words, runs_of(words))]

        return function

    return _per_text(docs, id_col, text, _DIGESTS, make)


def _digest(words: list[bytes], runs: list[Run]) -> tuple:
    best: tuple = (None, None, None, None)
    if runs:
        start, length, period = min(runs, key=lambda run: (-run[1], run[0], run[2]))
        best = (start, length, period, 1000 * length // period)
    listed = "".join(f"{start},{length},{period}\n" for start, length, period in runs)
    collapsed = b" ".join(kept_words(words, runs))
    return (
        len(runs),
        *best,
        hashlib.sha256(listed.encode()).hexdigest(),
        hashlib.sha256(collapsed).hexdigest(),
    )
