"""Approximate nearest neighbours by a forest of hash prefixes.

Every tree gives every vector a long string of bits, the sides of random planes that it lies on, and
keeps the vectors sorted by it. A query looks in each tree for the vectors whose strings share the
longest prefix with its own, and then goes up in all trees at once, a bit at a time, to shorter
prefixes with more vectors, until it has enough candidates or is at the floor. If no tree has ``k``
others for it there, it goes on above the floor until one has, at last to all vectors. Candidates
are compared exactly, by the inner product in double precision; a query's own vector is always one.

As the inner product also grows with length, indexed vectors get one more coordinate that makes all
of them equally long; queries have zero there. Planes don't depend on the data. The floor and the
number of candidates do, for each dimension: on up to ``TUNING_QUERIES`` queries, compared with all
vectors, the deepest floor and the fewest candidates are chosen that find the target share of the
true neighbours. The number of trees is one of ``TREE_CHOICES``: that with the least estimated cost
of moving vectors and comparing them, as more trees move each vector more often and, for the same
share of neighbours found, compare fewer. All this is done for the ``TUNED`` dimensions with most
vectors; in others every query is compared with all vectors.

The trees are dealt out by their first bits, up to the floor, and into blocks of at most
``BLOCK`` vectors; a block is held by one task, queries pass by in a stream. Equal vectors are one,
with the smallest ids that can be among the nearest, so a vector that a third of all rows have
makes no large block.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows
without an id, take no part; vectors of different dimensions don't meet; an id isn't among its own
neighbours, and rows with the same id and vector count once; equal scores go to the smaller id; a
query has all others if they are fewer; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from clicktide.llm.arrow import Batches
from clicktide.session import materialize

TREES = 16
TREE_CHOICES = (4, 8, 16)
BITS = 32
# Microseconds to move a vector to a tree, and to compare two vectors.
MOVE_COST, COMPARE_COST = 20.0, 0.06
# Prefixes are dealt out by a list of all of them, which this keeps small.
MAX_FLOOR = 10
BLOCK = 32_768
TUNING_QUERIES = 100
TUNED = 16
TARGET = 0.96
SEED = 17

_ROW = "key binary, dim int, vector binary, norm double, vec_id long"


@lru_cache(maxsize=4)
def planes(dim: int) -> np.ndarray:
    """The planes of all trees for vectors of this dimension and their added coordinate."""
    return np.random.default_rng([SEED, dim]).standard_normal((dim + 1, TREES * BITS))


def codes(vectors: np.ndarray, longest: float, queries: bool, trees: int = TREES) -> np.ndarray:
    """The strings of bits of vectors in the first trees, as whole numbers."""
    lengths = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    if queries:
        placed = np.column_stack([vectors / lengths[:, None], np.zeros(len(vectors))])
    else:
        added = np.sqrt(np.maximum(0.0, 1 - (lengths / longest) ** 2))
        placed = np.column_stack([vectors / longest, added])
    sides = placed @ planes(vectors.shape[1])[:, : trees * BITS]
    bits = (sides > 0).reshape(len(vectors), trees, BITS)
    weights = np.left_shift(np.int64(1), np.arange(BITS - 1, -1, -1, dtype=np.int64))
    return bits @ weights


def shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The lengths of the common prefixes."""
    differing = np.bitwise_xor(a, b).astype(np.float64)
    # frexp's exponent is the number of bits that differ somewhere.
    return BITS - np.frexp(differing)[1]


# --- equal vectors ---------------------------------------------------------------------------


def _valid(rows: DataFrame) -> DataFrame:
    """Rows with an id and a vector that takes part; its numbers stay in the precision they have."""
    kind = np.float32 if rows.schema["vector"].dataType == ArrayType(FloatType()) else np.float64

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            ids = batch.column("vec_id").to_pylist()
            for row, values in zip(ids, batch.column("vector").to_pylist()):
                if row is None or not values or None in values:
                    continue
                vector = np.array(values, dtype=np.float64)
                if np.isfinite(vector).all() and vector.any():
                    # Zeros of either sign are one.
                    data = (vector + 0.0).tobytes()
                    length = float(np.sqrt(vector @ vector))
                    kept = (vector + 0.0).astype(kind).tobytes()
                    made.append((hashlib.md5(data).digest(), len(vector), kept, length, row))
            columns = list(zip(*made)) or [[]] * 5
            kinds = [pa.binary(), pa.int32(), pa.binary(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(columns, kinds)],
                names=["key", "dim", "vector", "norm", "vec_id"],
            )

    return rows.mapInArrow(run, _ROW)


def _smallest_ids(rows: DataFrame, keep: int, every: int) -> DataFrame:
    """Of rows sorted by key and id: per key its vector, smallest ids, and if it has a query."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        done: list[tuple] = []
        for batch in batches:
            names = ("key", "dim", "vector", "norm", "vec_id")
            for key, dim, vector, norm, row in zip(*[batch.column(n).to_pylist() for n in names]):
                if key != now:
                    if held:
                        done.append(held)
                    now, held = key, (key, dim, vector, norm, [], [False])
                if len(held[4]) < keep and (not held[4] or held[4][-1] != row):
                    held[4].append(row)
                held[5][0] = held[5][0] or row % every == 0
            if done:
                yield _class_rows(done)
                done = []
        if held:
            yield _class_rows([held])

    schema = "key binary, dim int, vector binary, norm double, ids array<long>, is_query boolean"
    return rows.mapInArrow(run, schema)


def _class_rows(rows: list[tuple]) -> pa.RecordBatch:
    key, dim, vector, norm, ids, query = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(key, pa.binary()),
            pa.array(dim, pa.int32()),
            pa.array(vector, pa.binary()),
            pa.array(norm, pa.float64()),
            pa.array(ids, pa.list_(pa.int64())),
            pa.array([flag for (flag,) in query], pa.bool_()),
        ],
        names=["key", "dim", "vector", "norm", "ids", "is_query"],
    )


def _distinct_vectors(valid: DataFrame, keep: int, every: int) -> DataFrame:
    """Per different vector: a number, the vector, its smallest ids, and if an id is a query's."""
    # By key and id, so that a frequent vector is dealt out over many tasks.
    in_order = valid.repartitionByRange("key", "vec_id").sortWithinPartitions("key", "vec_id")
    per_key = (
        _smallest_ids(in_order, keep, every)
        .groupBy("key")
        .agg(
            F.first("dim").alias("dim"),
            F.first("vector").alias("vector"),
            F.first("norm").alias("norm"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"),
            F.max("is_query").alias("is_query"),
        )
    )
    numbered = per_key.select(
        F.monotonically_increasing_id().alias("number"),
        "key",
        "dim",
        "vector",
        "norm",
        F.slice("ids", 1, keep).alias("ids"),
        "is_query",
    )
    return materialize(numbered, "vectors")


def _matrix(values: list[bytes], dim: int) -> np.ndarray:
    """Vectors of one dimension in double precision, from either precision."""
    kind = np.float32 if values and len(values[0]) == 4 * dim else np.float64
    return np.frombuffer(b"".join(values), dtype=kind).astype(np.float64).reshape(len(values), dim)


def _vectors(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    """The vectors of rows of one dimension."""
    return _matrix(rows.column("vector").to_pylist(), rows.column("dim")[0].as_py())


def _by_dimension(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        yield batch.filter(pa.array(dims == dim))


# --- tuning ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Plan:
    """Prefixes are no shorter than ``floor``; a query stops at ``enough`` candidates."""

    longest: float
    trees: int
    floor: int
    enough: int


@dataclass(frozen=True)
class Plans:
    """The plans of the tuned dimensions; in others all vectors are candidates."""

    tuned: dict[int, Plan]

    def of(self, dim: int) -> Plan:
        return self.tuned.get(dim, Plan(1.0, 1, 0, 1 << 62))

    def column(self, name: str) -> Column:
        """A number of the plan that belongs to a row's ``dim``."""
        found = F.lit(getattr(self.of(-1), name))
        for dim, plan in self.tuned.items():
            found = F.when(F.col("dim") == dim, F.lit(getattr(plan, name))).otherwise(found)
        return found


def _tune(vectors: DataFrame, k: int, target: float) -> Plans:
    """Choose floors and numbers of candidates by comparing some queries with all vectors."""
    dims = (
        vectors.groupBy("dim")
        .agg(
            F.max("norm").alias("longest"),
            F.count(F.lit(1)).alias("vectors"),
            F.count_if("is_query").alias("queries"),
        )
        .orderBy(F.col("vectors").desc(), "dim")
        .limit(TUNED)
        .collect()
    )
    longest = {row["dim"]: row["longest"] or 1.0 for row in dims}
    queries_of = {row["dim"]: row["queries"] for row in dims}
    size_of = {row["dim"]: row["vectors"] for row in dims}
    # At most TUNED * TUNING_QUERIES vectors go to the tasks.
    asked = {}
    for dim in longest:
        chosen = (
            vectors.where(F.col("is_query") & (F.col("dim") == dim))
            .orderBy(F.xxhash64("key"), "key")
            .limit(TUNING_QUERIES)
            .select("number", "vector")
            .collect()
        )
        if chosen:
            asked[dim] = (
                np.array([row["number"] for row in chosen]),
                _matrix([bytes(row["vector"]) for row in chosen], dim),
            )

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_dimension(batch):
                dim = part.column("dim")[0].as_py()
                if dim not in asked:
                    continue
                numbers, queries = asked[dim]
                own = part.column("number").to_numpy()
                points = _vectors(part)
                scores = queries @ points.T
                query_codes = codes(queries, longest[dim], queries=True)
                point_codes = codes(points, longest[dim], queries=False)
                for at, number in enumerate(numbers):
                    shared = shared_bits(query_codes[at][None, :], point_codes)
                    others = own != number
                    # Per number of trees, how many vectors share so many bits in one of them.
                    counts = [
                        np.bincount(shared[others, :trees].ravel(), minlength=BITS + 1).tolist()
                        for trees in TREE_CHOICES
                    ]
                    best = np.argsort(-np.where(others, scores[at], -np.inf), kind="stable")[:k]
                    best = best[others[best]]
                    most = np.stack(
                        [shared[best, :trees].max(axis=1, initial=0) for trees in TREE_CHOICES], axis=1
                    )
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([number] * (len(best) + 1), pa.int64()),
                            pa.array([*scores[at][best].tolist(), None], pa.float64()),
                            pa.array([*most.tolist(), None], pa.list_(pa.int32())),
                            pa.array([None] * len(best) + [sum(counts, [])], pa.list_(pa.int64())),
                        ],
                        names=["number", "score", "shared", "counts"],
                    )

    seen = materialize(
        vectors.select("number", "dim", "vector").mapInArrow(
            run, "number long, score double, shared array<int>, counts array<long>"
        ),
        "tuning",
    )
    best = Window.partitionBy("number").orderBy(F.col("score").desc())
    nearest = (
        seen.where("score is not null")
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("number", "shared")
        .collect()
    )
    width = BITS + 1
    sums = [F.sum(F.col("counts")[at]).alias(f"c{at}") for at in range(width * len(TREE_CHOICES))]
    counted = seen.where("counts is not null").groupBy("number").agg(*sums).collect()
    shared = {row["number"]: [] for row in counted}
    for row in nearest:
        shared[row["number"]].append(row["shared"])
    tuned = {}
    for dim, (numbers, _) in asked.items():
        plans = []
        for at, trees in enumerate(TREE_CHOICES):
            own = {number: [bits[at] for bits in shared[number]] for number in numbers.tolist()}
            # Per query, how many candidates have a prefix of each length or more.
            found = {
                row["number"]: np.cumsum(list(row)[1:][at * width : (at + 1) * width][::-1])[::-1]
                for row in counted
                if row["number"] in own
            }
            if any(own.values()):
                floor, enough = _choose(own, found, target)
                cost = trees * MOVE_COST * size_of[dim]
                cost += queries_of[dim] * COMPARE_COST * _compared(found, floor, enough)
                plans.append((cost, Plan(longest[dim], trees, floor, enough)))
        if plans:
            tuned[dim] = min(plans, key=lambda plan: plan[0])[1]
    return Plans(tuned)


def _level(found: np.ndarray, floor: int, enough: float) -> int:
    """The length of prefix that a query goes up to, given how many candidates each has."""
    deep = np.flatnonzero(found >= enough)
    return max(floor, int(deep[-1]) if len(deep) else 0)


def _compared(found: dict[int, np.ndarray], floor: int, enough: float) -> float:
    """How many vectors a query is compared with, on average."""
    return float(np.mean([own[_level(own, floor, enough)] for own in found.values()]))


def _choose(
    shared: dict[int, list[int]], found: dict[int, np.ndarray], target: float
) -> tuple[int, int]:
    """The deepest floor, and for it the fewest candidates, with which the target is met."""
    everything = [bits for own in shared.values() for bits in own]

    def recall(floor: int, enough: float) -> float:
        hits = 0
        for number, own in shared.items():
            level = _level(found[number], floor, enough)
            hits += sum(bits >= level for bits in own)
        return hits / max(1, len(everything))

    floor = next(
        (at for at in range(MAX_FLOOR, 0, -1) if recall(at, float("inf")) >= target + 0.01), 0
    )
    most = int(max(counts[floor] for counts in found.values())) + 1
    enough = 1
    while enough < most and recall(floor, enough) < target:
        enough = enough * 5 // 4 + 1
    return floor, min(enough, most)


# --- forest ----------------------------------------------------------------------------------

_PLACE = ["dim", "tree", "prefix", "block"]


def _tree_rows(vectors: DataFrame, plans: Plans, queries: bool) -> DataFrame:
    """A row for each vector and tree: its place up to the floor, and its whole code.

    ``own`` is, for a query, how many bits its own vector shares with it in the tree.
    """

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_dimension(batch):
                plan, points = plans.of(part.column("dim")[0].as_py()), _vectors(part)
                made = codes(points, plan.longest, queries, plan.trees)
                own = np.zeros_like(made)
                if queries:
                    own = shared_bits(made, codes(points, plan.longest, False, plan.trees))
                for tree in range(plan.trees):
                    code = made[:, tree]
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("number"),
                            part.column("dim"),
                            part.column("vector"),
                            pa.array(np.full(len(code), tree, dtype=np.int32)),
                            pa.array((code >> (BITS - plan.floor)).astype(np.int32)),
                            pa.array(code),
                            pa.array(own[:, tree].astype(np.int32)),
                        ],
                        names=["number", "dim", "vector", "tree", "prefix", "code", "own"],
                    )

    schema = "number long, dim int, vector binary, tree int, prefix int, code long, own int"
    return vectors.select("number", "dim", "vector").mapInArrow(run, schema)


def _sizes(indexed: DataFrame) -> DataFrame:
    """How many vectors each place has: up to TREES * 2 ** MAX_FLOOR rows for a dimension."""
    return materialize(
        indexed.groupBy(*_PLACE[:3]).agg(F.count(F.lit(1)).alias("vectors")), "sizes"
    )


def _in_blocks(indexed: DataFrame, asked: DataFrame, sizes: DataFrame, plans: Plans) -> DataFrame:
    """Index rows and, behind them, query rows of the same place, by blocks.

    A query whose level is above the floor goes to all places below its prefix.
    """
    place = _PLACE[:3]
    few = sizes.count() <= TREES << MAX_FLOOR
    sizes = sizes.select(*place, F.ceil(F.col("vectors") / BLOCK).cast("int").alias("blocks"))
    if few:
        sizes = F.broadcast(sizes)
    # At level 0 every tree has all vectors, so one is enough.
    asked = (
        asked.where((F.col("level") > 0) | (F.col("tree") == 0))
        .withColumn("above", F.greatest(F.lit(0), plans.column("floor") - F.col("level")))
        .withColumn("low", F.expr("shiftleft(shiftright(prefix, above), above)"))
        .withColumn("prefix", F.expr("explode(sequence(low, low + shiftleft(1, above) - 1))"))
    )
    points = indexed.join(sizes, place).select(
        *place,
        F.pmod(F.xxhash64("number"), F.col("blocks")).cast("int").alias("block"),
        F.lit(0).alias("kind"),
        "number",
        "code",
        "vector",
        F.lit(0).alias("level"),
        "own",
    )
    queries = asked.join(sizes, place).select(
        *place,
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.lit(1).alias("kind"),
        "number",
        "code",
        "vector",
        "level",
        "own",
    )
    both = points.unionByName(queries)
    # Queries stay in the order of their codes, so that equal ones need no more than a glance.
    return both.repartition(*_PLACE).sortWithinPartitions(*_PLACE, "kind", "code")


def _passing_queries(batches: Batches) -> Iterator[tuple[pa.Table, pa.RecordBatch]]:
    """Whole blocks of the index, each with one batch after another of the queries that pass by."""
    now, held, block = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.column_stack([batch.column(n).to_numpy() for n in (*_PLACE, "kind")])
        cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
        for start, end in zip([0, *cuts], [*cuts, len(marks)]):
            place, kind = tuple(marks[start, :-1]), marks[start, -1]
            part = batch.slice(start, end - start)
            if place != now:
                now, held, block = place, [], None
            if not kind:
                held.append(part)
            elif held:
                block = block or pa.Table.from_batches(held).combine_chunks()
                yield block, part


def _ranges(
    block_codes: np.ndarray, query_codes: np.ndarray, level: np.ndarray | int
) -> tuple[np.ndarray, np.ndarray]:
    """From where to where sorted codes have the queries' prefixes."""
    rest = BITS - level
    low = (query_codes >> rest) << rest
    return (
        np.searchsorted(block_codes, low, side="left"),
        np.searchsorted(block_codes, low + (np.int64(1) << rest), side="left"),
    )


def _levels(
    asked: DataFrame, indexed: DataFrame, sizes: DataFrame, plans: Plans, k: int
) -> DataFrame:
    """Per query the length of prefix that it goes up to, in all trees alike."""
    depths = list(range(BITS + 1))

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for block, part in _passing_queries(batches):
            own, wanted = block.column("code").to_numpy(), part.column("code").to_numpy()
            floor = plans.of(part.column("dim")[0].as_py()).floor
            # Above the floor a place has only a part of those with the prefix.
            counts = [np.zeros(len(wanted), dtype=np.int64)] * floor + [
                np.subtract(*_ranges(own, wanted, depth)[::-1]) for depth in depths[floor:]
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    *[part.column(name) for name in ("number", "dim", "tree", "own")],
                    pa.array(np.column_stack(counts).tolist()),
                ],
                names=["number", "dim", "tree", "own", "counts"],
            )

    nothing = F.lit(None).cast("binary")
    blocks = _in_blocks(
        indexed.withColumn("vector", nothing),
        asked.withColumn("vector", nothing).withColumn("level", F.lit(BITS)),
        sizes,
        plans,
    )
    counted = blocks.mapInArrow(
        run, "number long, dim int, tree int, own int, counts array<long>"
    )
    # Others: without the query's own vector, in the trees that find it.
    others = [
        (F.sum(F.col("counts")[depth]) - F.when(F.col("own") >= depth, 1).otherwise(0)).alias(
            f"c{depth}"
        )
        for depth in depths
    ]
    per_tree = counted.groupBy("number", "dim", "tree", "own").agg(*others)
    floor, enough = plans.column("floor"), plans.column("enough")
    stops = [
        F.when(
            (F.max(f"c{depth}") >= k)
            & (floor <= depth)
            & ((F.sum(f"c{depth}") >= enough) | (floor == depth)),
            F.lit(depth),
        )
        for depth in depths
    ]
    # One tree with k others is enough to have k of them.
    reached = per_tree.groupBy("number", "dim").agg(F.greatest(*stops).alias("reached"))
    reached = materialize(reached.select("number", "reached"), "levels")
    return reached.where("reached is not null").select(
        "number", F.col("reached").alias("level")
    ).unionByName(_levels_above(asked, reached, sizes, plans, k))


def _levels_above(
    asked: DataFrame, reached: DataFrame, sizes: DataFrame, plans: Plans, k: int
) -> DataFrame:
    """The lengths of prefix of queries for which no tree has k others at the floor."""
    steps = F.explode(F.sequence(F.lit(0), plans.column("floor"))).alias("depth")
    shorter = F.expr("shiftright(prefix, floor - depth)").alias("shorter")
    wide = (
        sizes.select("dim", "tree", "prefix", "vectors", plans.column("floor").alias("floor"), steps)
        .select("dim", "tree", "depth", shorter, "vectors")
        .groupBy("dim", "tree", "depth", "shorter")
        .agg(F.sum("vectors").alias("vectors"))
    )
    short = asked.drop("vector").join(
        reached.where("reached is not null"), "number", "left_anti"
    )
    others = F.col("vectors") - F.when(F.col("own") >= F.col("depth"), 1).otherwise(0)
    return (
        short.select(
            "number", "dim", "tree", "prefix", "own", plans.column("floor").alias("floor"), steps
        )
        .select("number", "dim", "tree", "depth", shorter, "own")
        .join(wide, ["dim", "tree", "depth", "shorter"], "left")
        .groupBy("number")
        .agg(
            F.coalesce(F.max(F.when(others >= k, F.col("depth"))), F.lit(0)).cast("int").alias("level")
        )
    )


def _own_scores(vectors: DataFrame) -> DataFrame:
    """Queries as candidates of themselves, as other ids can have the same vector."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_dimension(batch):
                points = _vectors(part)
                yield pa.RecordBatch.from_arrays(
                    [part.column("number")] * 2 + [pa.array(np.einsum("ij,ij->i", points, points))],
                    names=["query", "number", "own"],
                )

    rows = vectors.where("is_query").select("number", "dim", "vector")
    return rows.mapInArrow(run, "query long, number long, own double")


def _nearest(blocks: DataFrame, k: int) -> DataFrame:
    """Per query and block the nearest candidates, by the exact score."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        of, points = None, None
        for block, part in _passing_queries(batches):
            if block is not of:
                of, points = block, _vectors(block)
                own, numbers = block.column("code").to_numpy(), block.column("number").to_numpy()
            queries, levels = _vectors(part), part.column("level").to_numpy()
            starts, ends = _ranges(own, part.column("code").to_numpy(), levels.astype(np.int64))
            asked = part.column("number").to_numpy()
            for at in range(0, len(asked), 256):
                low, high = starts[at : at + 256], ends[at : at + 256]
                first, last = int(low.min()), int(high.max())
                scores = queries[at : at + 256] @ points[first:last].T
                for row, (start, end) in enumerate(zip(low - first, high - first)):
                    mine = scores[row, start:end]
                    if not len(mine):
                        continue
                    few = min(k, len(mine))
                    best = np.argpartition(-mine, few - 1)[:few]
                    # Whatever is equal to the last belongs to it; ids decide later.
                    best = np.flatnonzero(mine >= mine[best].min())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(best), asked[at + row])),
                            pa.array(numbers[first + start : first + end][best]),
                            pa.array(mine[best]),
                        ],
                        names=["query", "number", "score"],
                    )

    return blocks.mapInArrow(run, "query long, number long, score double")


def search(
    embeddings: DataFrame,
    k: int = 20,
    every: int = 20,
    id_col: str = "vec_id",
    vector: str = "embedding",
    target: float = TARGET,
) -> DataFrame:
    """For rows whose id is divisible by ``every``: query_id, rank, vec_id and score of the nearest."""
    rows = embeddings.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("vector")
    )
    valid = materialize(_valid(rows), "valid")
    vectors = _distinct_vectors(valid, k + 1, every)
    plans = _tune(vectors, k, target)
    indexed = _tree_rows(vectors, plans, queries=False)
    asked = _tree_rows(vectors.where("is_query"), plans, queries=True)
    sizes = _sizes(indexed)
    levels = _levels(asked, indexed, sizes, plans, k)
    blocks = _in_blocks(indexed, asked.join(levels, "number"), sizes, plans)
    found = (
        _nearest(blocks, k + 1)
        .withColumn("own", F.lit(None).cast("double"))
        .unionByName(_own_scores(vectors), allowMissingColumns=True)
        .groupBy("query", "number")
        .agg(F.coalesce(F.max("score"), F.max("own")).alias("score"))
    )
    near = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("ids")[0])
    # Of different vectors, k + 1 are enough; each brings its smallest ids.
    best = (
        found.join(vectors.select("number", "ids"), "number")
        .withColumn("place", F.row_number().over(near))
        .where(F.col("place") <= k + 1)
    )
    in_order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    listed = (
        best.select("query", "score", F.explode("ids").alias("vec_id"))
        .withColumn("place", F.row_number().over(in_order))
        .where(F.col("place") <= k + 1)
        .groupBy("query")
        .agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("nearest"))
        .select(F.col("query").alias("number"), "nearest")
        .join(vectors.select("number", "key"), "number")
        .select("key", "nearest")
    )
    queries = valid.where(F.col("vec_id") % every == 0).select("vec_id", "key").distinct()
    answered = queries.join(listed, "key")
    return answered.select(
        F.col("vec_id").alias("query_id"), F.posexplode(_others(F.col("nearest"), k))
    ).select(
        "query_id",
        (F.col("pos") + 1).cast("int").alias("rank"),
        F.col("col.vec_id").alias("vec_id"),
        F.col("col.score").alias("score"),
    )


def _others(nearest: Column, k: int) -> Column:
    """The first k that aren't the query itself."""
    return F.slice(F.filter(nearest, lambda one: one["vec_id"] != F.col("vec_id")), 1, k)
