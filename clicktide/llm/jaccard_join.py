"""N-gram Jaccard join by chosen paths, with exact verification.

Texts are sets of word shingles. Rows with the same set form a class of copies, of which one
represents all. Of each representative a sketch of ``TOKENS`` min-hashes is kept; two sketches agree
in a share of places that is near the similarity of the sets.

1. Chosen paths. In each of several independent runs, a set goes from a node to the children of
   some of its tokens (a place of the sketch and its value), chosen by a hash that all sets share,
   1 / ``SPREAD`` of them on average. Sets with similarity s meet in s / SPREAD children of a common
   node on average, more than one at the threshold, while others soon part. Nodes with up to
   ``SMALL`` sets are searched by brute force on the sketches, larger ones are split again. Sets
   still together in a large node after ``DEPTH`` steps agree in that many tokens and are linked.
   The number of runs follows from the target recall. All this links candidates: it gives groups
   that hold every similar pair with the target probability, and few others.
2. Exact sets. Within a group all pairs are compared by their shingles, in blocks of bounded size,
   each pair of blocks in a task of its own. Only counts per set and links that span the block
   leave a task, never all pairs.
3. Classes are the components of the exact links.

Defined cases: null and empty texts have no shingles, no links, and each such row is a class of its
own; a text with fewer words than a shingle is one shingle; rows with the same set are linked with
similarity 1, repeated rows and null ids included; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicktide.llm.arrow import Batches, groups
from clicktide.llm.components import components
from clicktide.llm.words import WORD_PATTERN, Shingler, mixed
from clicktide.session import materialize

# Similarity from which two texts are linked, as a fraction of whole numbers.
THRESHOLD = (4, 5)

TOKENS = 64
SPREAD = 0.7
SMALL = 4_096
# Places of sketches that are compared at once in a small node.
COMPARED = 1 << 23
DEPTH = 6
TARGET_RECALL = 0.999
# Sketches that agree in fewer places are below the threshold by more than five standard errors.
MIN_AGREEING = math.floor(
    TOKENS * (THRESHOLD[0] / THRESHOLD[1] - 5 * math.sqrt(0.16 / TOKENS))
)
BLOCK_SETS = 512
BLOCK_SHINGLES = 1 << 20

_RANDOM = np.random.default_rng(20_240_613)
_FACTORS = _RANDOM.integers(1, 1 << 63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def runs_needed(target: float = TARGET_RECALL, depth: int = DEPTH) -> int:
    """Runs until a pair at the threshold meets at the last step with the target probability.

    Common children are nearly Poisson, so the chance that a pair parts is a branching process's.
    """
    mean, parted = THRESHOLD[0] / THRESHOLD[1] / SPREAD, 0.0
    for _ in range(depth):
        parted = math.exp(mean * (parted - 1))
    return max(1, math.ceil(math.log(1 - target) / math.log(parted)))


# --- sets and sketches -----------------------------------------------------------------------


def set_key(shingles: np.ndarray) -> bytes | None:
    """128 bits that tell sets apart; none for the empty set."""
    return hashlib.md5(shingles.tobytes()).digest() if len(shingles) else None


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The smallest hash of the set for each of the hash functions, 32 bits each."""
    least = np.full(TOKENS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        least = np.minimum(least, (part[None, :] * _FACTORS[:, None]).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _sketches(docs: DataFrame) -> DataFrame:
    """Per row of (doc_id, text): doc_id, hash of the text, key and size of the set, sketch."""
    schema = (
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, "
        "text_key binary, set_key binary, size long, sketch array<int>"
    )

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            texts, made = batch.column("text"), []
            for at in range(batch.num_rows):
                text = texts[at].as_py() or ""
                shingles = shingler(text)
                made.append(
                    (
                        hashlib.md5(text.encode()).digest(),
                        set_key(shingles),
                        len(shingles),
                        sketch(shingles) if len(shingles) else None,
                    )
                )
            columns = list(zip(*made)) or [[], [], [], []]
            kinds = [pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                names=["doc_id", "text_key", "set_key", "size", "sketch"],
            )

    return docs.mapInArrow(run, schema)


# --- chosen paths ----------------------------------------------------------------------------

# Of the hashes of 64 bits with a sign, the share that is below this is 1 / (SPREAD * TOKENS).
_CHOSEN_BELOW = int(2**64 / (SPREAD * TOKENS)) - 2**63


def children(node: Column, sketch: Column) -> Column:
    """The child nodes that a set goes on to from a node, by the tokens of its sketch."""
    hashes = F.transform(sketch, lambda value, place: F.xxhash64(node, place, value))
    chosen = F.filter(hashes, lambda value: value < F.lit(_CHOSEN_BELOW))
    return F.transform(chosen, lambda value: F.xxhash64(value))


def _first_step(sets: DataFrame, runs: int) -> DataFrame:
    """Rows (node, set_id) of all runs' first step."""
    roots = F.sequence(F.lit(1).cast("long"), F.lit(runs).cast("long"))
    nodes = F.flatten(F.transform(roots, lambda root: children(root, F.col("sketch"))))
    return sets.select(F.explode(nodes).alias("node"), "set_id")


def _next_step(members: DataFrame) -> DataFrame:
    """Rows (node, set_id) of the children of rows (node, set_id, sketch)."""
    return members.select(
        F.explode(children(F.col("node"), F.col("sketch"))).alias("node"), "set_id"
    )


def spanning(root: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest member of each member's component, given those so far and further links."""
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if (root == before).all():
            return root


def _similar_sketches(own: np.ndarray) -> np.ndarray:
    """For each row of sketches the first row that it is connected with by similar ones."""
    n = len(own)
    root, rows = np.arange(n), max(1, COMPARED // (n * TOKENS))
    for start in range(0, n, rows):
        part = own[start : start + rows]
        agreeing = (part[:, None, :] == own[None, start:, :]).sum(axis=2, dtype=np.uint8)
        left, right = np.nonzero(agreeing >= MIN_AGREEING)
        root = spanning(root, left + start, right + start)
    return root


def _small_nodes(members: DataFrame) -> DataFrame:
    """Links (a, b) that span the similar sets of each small node, by brute force on sketches."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["group"]):
            ids = table.column("set_id").to_numpy()
            own = table.column("sketch").combine_chunks().flatten().to_numpy().reshape(-1, TOKENS)
            root = _similar_sketches(own)
            linked = np.flatnonzero(root != np.arange(len(ids)))
            if len(linked):
                yield _edges(ids[linked], ids[root[linked]])

    return members.mapInArrow(run, "a long, b long")


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _candidate_links(sets: DataFrame, runs: int) -> DataFrame:
    """Links (a, b) that join sets which may be similar, by chosen paths."""
    own = sets.select("set_id", "sketch")
    links, small = [], []
    step = materialize(_first_step(own, runs), "paths")
    for depth in range(1, DEPTH + 1):
        sizes = step.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = materialize(step.join(sizes, "node"), "paths")
        small.append(shared.where(F.col("n") <= SMALL).select("node", "set_id"))
        large = shared.where(F.col("n") > SMALL).select("node", "set_id")
        if large.isEmpty():
            break
        if depth == DEPTH:
            lowest = large.groupBy("node").agg(F.min("set_id").alias("b"))
            links.append(large.join(lowest, "node").select(F.col("set_id").alias("a"), "b"))
            break
        step = materialize(_next_step(large.join(own, "set_id")), "paths")
    together = small[0]
    for more in small[1:]:
        together = together.unionByName(more)
    # Nodes of other runs with the same members say nothing new. A list has at most SMALL sets.
    lists = together.groupBy("node").agg(F.sort_array(F.collect_list("set_id")).alias("members"))
    distinct = lists.select("members").distinct()
    listed = distinct.select(
        F.xxhash64("members").alias("group"), F.explode("members").alias("set_id")
    )
    members = listed.join(own, "set_id").repartition("group").sortWithinPartitions("group")
    links.append(_small_nodes(members))
    found = links[0]
    for more in links[1:]:
        found = found.unionByName(more)
    return found


# --- exact comparison ------------------------------------------------------------------------


def similar(sizes_a: np.ndarray, sizes_b: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Whether the Jaccard similarity is at least the threshold, in whole numbers."""
    up, down = THRESHOLD
    return down * common >= up * (sizes_a[:, None] + sizes_b[None, :] - common)


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sorted sets, for all pairs of a and b."""
    if len(a) * len(b) <= 4:
        return np.array(
            [[len(np.intersect1d(x, y, assume_unique=True)) for y in b] for x in a]
        ).reshape(len(a), len(b))
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(flat_a, flat_b)
    total = np.zeros((len(a), len(b)), dtype=np.float32)
    for start in range(0, len(both), 2048):
        part = both[start : start + 2048]
        total += _incidence(a, part) @ _incidence(b, part).T
    return np.rint(total).astype(np.int64)


def _incidence(sets: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    """Which set has which of the sorted shingles, as 0 and 1."""
    found = np.zeros((len(sets), len(columns)), dtype=np.float32)
    for row, values in enumerate(sets):
        start, end = np.searchsorted(values, columns[0]), np.searchsorted(values, columns[-1], "right")
        part = values[start:end]
        if len(part):
            at = np.searchsorted(columns, part)
            found[row, at[columns[at] == part]] = 1
    return found


_BLOCK_ROW = "group long, i int, j int, block int, set_id long, copies long, shingles binary"


def _in_blocks(texts: DataFrame) -> DataFrame:
    """One row for every pair of blocks that a set is compared in, with its shingles.

    Reads (group, blocks, set_id, copies, text).
    """

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: batch.column(n)[at].as_py() for n in batch.schema.names}
                shingles = shingler(row["text"])
                n, block = row["blocks"], block_of(row["set_id"], row["blocks"])
                pairs = [(min(block, other), max(block, other)) for other in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["group"]] * n, pa.int64()),
                        pa.array([i for i, _ in pairs], pa.int32()),
                        pa.array([j for _, j in pairs], pa.int32()),
                        pa.array([block] * n, pa.int32()),
                        pa.array([row["set_id"]] * n, pa.int64()),
                        pa.array([row["copies"]] * n, pa.int64()),
                        pa.array([shingles.tobytes()] * n, pa.binary()),
                    ],
                    names=["group", "i", "j", "block", "set_id", "copies", "shingles"],
                )

    return texts.mapInArrow(run, _BLOCK_ROW)


def block_of(set_id: int, blocks: int) -> int:
    return int(mixed(np.array([set_id], dtype=np.int64).view(np.uint64))[0] % np.uint64(blocks))


def _compare_blocks(rows: DataFrame) -> DataFrame:
    """Per set and pair of blocks: linked rows, and one linked set on the way to the smallest."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["group", "i", "j"]):
            _, first = np.unique(table.column("set_id").to_numpy(), return_index=True)
            table = table.take(pa.array(first))
            ids, copies = table.column("set_id").to_numpy(), table.column("copies").to_numpy()
            sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("shingles").to_pylist()]
            block, same = table.column("block").to_numpy(), table["i"][0] == table["j"][0]
            left = np.flatnonzero(block == table["i"][0].as_py())
            right = left if same else np.flatnonzero(block == table["j"][0].as_py())
            if not len(left) or not len(right):
                continue
            sizes = np.array([len(x) for x in sets])
            linked = similar(
                sizes[left],
                sizes[right],
                common_counts([sets[x] for x in left], [sets[x] for x in right]),
            )
            if same:
                np.fill_diagonal(linked, False)
            links = np.zeros(len(ids), dtype=np.int64)
            links[left] += linked @ copies[right]
            if not same:
                links[right] += copies[left] @ linked
            a, b = np.nonzero(linked)
            root = spanning(np.arange(len(ids)), left[a], right[b])
            found = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[found]), pa.array(links[found]), pa.array(ids[root[found]])],
                names=["set_id", "links", "root"],
            )

    return rows.mapInArrow(run, "set_id long, links long, root long")


def _exact(docs: DataFrame, sets: DataFrame, groups_of: DataFrame) -> DataFrame:
    """Rows (set_id, links, root) of the exact comparison within every group."""
    members = groups_of.select(F.col("node").alias("set_id"), F.col("root").alias("group"))
    roots = members.select(F.col("group").alias("set_id"), "group").distinct()
    members = members.unionByName(roots).join(sets.drop("sketch"), "set_id")
    sizes = members.groupBy("group").agg(
        F.greatest(
            F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("size") / BLOCK_SHINGLES)
        ).cast("int").alias("blocks")
    )
    wanted = members.join(sizes, "group")
    texts = docs.select(
        F.col("doc_id").alias("__doc_id"), "text", F.unhex(F.md5("text")).alias("__text_key")
    )
    same = (F.col("text_key") == F.col("__text_key")) & F.col("doc_id").eqNullSafe(F.col("__doc_id"))
    found = texts.join(wanted, same).select("group", "blocks", "set_id", "copies", "text")
    keys = ["group", "i", "j"]
    blocks = _in_blocks(found).repartition(*keys).sortWithinPartitions(*keys)
    return _compare_blocks(blocks)


# --- the operator ----------------------------------------------------------------------------


def _classes(rows: DataFrame, target_recall: float) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows (doc_id, text), and per set its class, class id, size and links."""
    sketched = materialize(_sketches(rows), "sketches")
    with_words = sketched.where(F.col("set_key").isNotNull())
    sets = materialize(
        with_words.groupBy("set_key")
        .agg(
            F.min(F.struct("doc_id", "text_key")).alias("one"),
            F.min("doc_id").alias("low_id"),
            F.count(F.lit(1)).alias("copies"),
            F.first("size").alias("size"),
            F.first("sketch").alias("sketch"),
        )
        .select(
            # Fixed by the write.
            F.monotonically_increasing_id().alias("set_id"),
            "set_key",
            F.col("one.doc_id").alias("doc_id"),
            F.col("one.text_key").alias("text_key"),
            "low_id",
            "copies",
            "size",
            "sketch",
        ),
        "sets",
    )
    loose = components(_candidate_links(sets, runs_needed(target_recall)), "candidates")
    exact = materialize(_exact(rows, sets, loose), "links")
    linked = exact.groupBy("set_id").agg(F.sum("links").alias("links"))
    spans = exact.select(F.col("set_id").alias("a"), F.col("root").alias("b"))
    roots = components(spans, "classes").withColumnRenamed("node", "set_id")
    known = (
        sets.select("set_id", "set_key", "low_id", "copies")
        .join(linked, "set_id", "left")
        .join(roots, "set_id", "left")
        .select(
            "set_key",
            "low_id",
            "copies",
            F.coalesce("root", "set_id").alias("root"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        )
    )
    classes = known.groupBy("root").agg(
        F.min("low_id").alias("class_id"), F.sum("copies").alias("class_size")
    )
    return sketched, known.join(classes, "root").drop("low_id", "copies")


def near_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    target_recall: float = TARGET_RECALL,
) -> DataFrame:
    """Per row: doc_id, class_id, class_size, n_links.

    ``class_id`` is the smallest id of the rows that are connected by links, ``n_links`` the number
    of other rows whose set has a similarity of at least the threshold.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    sketched, classes = _classes(rows, target_recall)
    found = sketched.select("doc_id", "set_key").where(F.col("set_key").isNotNull())
    alone = sketched.where(F.col("set_key").isNull()).select(
        "doc_id",
        F.col("doc_id").alias("class_id"),
        F.lit(1).cast("long").alias("class_size"),
        F.lit(0).cast("long").alias("n_links"),
    )
    return found.join(classes.drop("root"), "set_key").drop("set_key").unionByName(alone)


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    target_recall: float = TARGET_RECALL,
) -> DataFrame:
    """One row of each class, with all its columns: the one with the smallest id.

    Ids that are null come last; among equal ids the smallest hash of the text decides, and of rows
    with the same id and text any one stays. Rows without a word all stay.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    sketched, classes = _classes(rows, target_recall)
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key")
    firsts = (
        sketched.where(F.col("set_key").isNotNull())
        .groupBy("set_key")
        .agg(F.min(order).alias("first"))
        .join(classes.select("set_key", "root"), "set_key")
        .groupBy("root")
        .agg(F.min("first").alias("first"))
        .select(
            F.col("first.doc_id").alias("__first_id"), F.col("first.text_key").alias("__first_key")
        )
    )
    own = docs.columns
    keyed = docs.select(
        "*", F.col(id_col).alias("__row_id"), F.unhex(F.md5(F.col(text))).alias("__row_key")
    )
    with_words = F.coalesce(F.col(text).rlike(WORD_PATTERN), F.lit(False))
    once = keyed.where(with_words).dropDuplicates(["__row_id", "__row_key"])
    same = (F.col("__row_key") == F.col("__first_key")) & F.col("__row_id").eqNullSafe(
        F.col("__first_id")
    )
    kept = once.join(firsts, same, "left_semi").select(*own)
    return kept.unionByName(docs.where(~with_words))
