"""Near copies by bottom-k sketches of one hash function, confirmed on full sets.

A text is the set of its shingles of ``WIDTH`` words, A-Z in lower case. Texts with equal sets are
one set from the first step on. A set's sketch is its ``SKETCH`` smallest hashes, all of one function.

1. Inverted lists. Of two sets above the threshold, a sample of the ``LISTED`` smallest hashes of
   their union shares ``SHARED`` at least, but for about one pair in a million at the threshold (for
   sets of no more hashes, the exact share). So it is enough to list a set under its rarest values,
   all but ``SHARED`` - 1 of them: one that both have is among those of either. Values of one set
   only come first, as the rarest, and need no list. Frequent passages fill the places that are left
   out. Lists with equal members are one list.
2. Overlaps. In a list, members are compared with a few leaders by their sketches: of the values of
   the union up to where both sketches reach, the share that both have estimates the similarity.
   Pairs below the threshold by more than ``ERRORS`` standard errors are left out, all others are
   confirmed on full sets. This joins most copies to their group with one link each.
3. What remains are lists with members of several groups. Of each, the members outside its largest
   group are compared with all others by their sketches, in blocks, each pair of blocks in a task.
   Sets that may be linked across groups meet in the same pairs of blocks with their full sets, and
   only links that join groups leave a task. No step writes pairs of a list: leaders give one row per
   member, blocks one per member and block.
4. Components of the links are the groups.

Links are confirmed on full sets in whole numbers, so there are no false ones; hashes have 64 bits.

Defined cases: null and empty texts and texts without words have the empty set, no links, and are
groups of their own; a text with fewer words than a shingle is one shingle. Null ids count as larger
than any other; a group without any other id has a null id, and its rows are kept. Rows with one id
are rows like others. An empty table gives an empty result. Other columns are not read.
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
from clicktide.llm.skew import frequent_bound, join_counted
from clicktide.llm.words import Shingler
from clicktide.session import materialize

WIDTH = 4
# Linked are sets with PERCENT[1] * intersection >= PERCENT[0] * union.
PERCENT = (80, 100)

SKETCH = 128
LISTED = 32
SHARED = 14
ERRORS = 4.5
# Leaders per list, or per block of a long one.
LEADERS = 8
# A block has up to about so many sets, and so many shingles.
BLOCK_SETS = 512
BLOCK_SHINGLES = 1 << 20
# Full sets leave a task in batches of about so many bytes.
BATCH_BYTES = 4 << 20
# Sketches, and values of them, that are compared at once.
ROWS, COLUMNS = 512, 2_048
# Confirmed together with a leader are up to about so many sets.
CHUNK = 64


# --- sets and sketches -----------------------------------------------------------------------


def listed_of(size: int) -> tuple[int, int]:
    """How many of a set's smallest hashes may be listed, and how many of the rarest are."""
    n = min(size, LISTED)
    shared = SHARED if size > LISTED else -(-PERCENT[0] * size // PERCENT[1])
    return n, n - shared + 1


def _sketches(rows: DataFrame) -> DataFrame:
    """Per row of (doc_id, text_key, text): its set's key and size, listed hashes and sketch."""
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {id_type}, text_key long, set_key binary, size long, listed array<long>, sketch binary"
    )

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(WIDTH)
        for batch in batches:
            texts, keys, sizes, listed, sketches = batch.column("text"), [], [], [], []
            for at in range(batch.num_rows):
                shingles = _shingles(shingler, texts[at].as_py())
                sizes.append(len(shingles))
                keys.append(_key(shingles) if len(shingles) else None)
                listed.append(shingles[:LISTED].view(np.int64))
                # The upper halves do for estimates and keep their order.
                sketches.append((shingles[:SKETCH] >> np.uint64(32)).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array(keys, pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.array(listed, pa.list_(pa.int64())),
                    pa.array(sketches, pa.binary()),
                ],
                names=["doc_id", "text_key", "set_key", "size", "listed", "sketch"],
            )

    return rows.mapInArrow(run, schema)


def _shingles(shingler: Shingler, text: str | None) -> np.ndarray:
    return shingler(text.encode().lower().decode() if text else None)


def _key(shingles: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    return hashlib.md5(shingles.tobytes()).digest()


def linked(common: np.ndarray, size: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether sets are linked, by the sizes of their intersection and their own."""
    return PERCENT[1] * common >= PERCENT[0] * (size + other - common)


def may_be_linked(
    common: np.ndarray, sample: np.ndarray, size: np.ndarray, other: np.ndarray
) -> np.ndarray:
    """Whether an estimate leaves a link possible.

    ``common`` of the ``sample`` smallest hashes of the union are in both. At the threshold the union
    has a known size, and the sample is drawn from it without putting back.
    """
    share = PERCENT[0] / PERCENT[1]
    union = (size + other) / (1 + share)
    rest = np.clip((union - sample) / np.maximum(union - 1, 1), 0, 1)
    error = np.sqrt(share * (1 - share) * sample * rest)
    near = np.minimum(size, other) * PERCENT[1] >= PERCENT[0] * np.maximum(size, other)
    return near & (common >= np.floor(share * sample - ERRORS * error))


class Sketches:
    """Sketches of several sets, compared one with many."""

    def __init__(self, sizes: np.ndarray, sketches: list[bytes]) -> None:
        self.sizes = sizes
        self.values = [np.frombuffer(sketch, dtype=np.uint32) for sketch in sketches]
        self.lengths = np.array([len(values) for values in self.values])
        self.ends = np.array([values[-1] for values in self.values], dtype=np.int64)
        # A sketch that is the whole set reaches up to any value.
        self.ends[self.sizes <= SKETCH] = np.iinfo(np.int64).max
        self.flat = np.concatenate(self.values).astype(np.int64)
        self.row = np.repeat(np.arange(len(self.values)), self.lengths)

    def similar(self, at: int, rows: np.ndarray) -> np.ndarray:
        """Those of ``rows``, a mask, that may be linked with the set ``at``."""
        own = self.values[at].astype(np.int64)
        places = np.minimum(np.searchsorted(own, self.flat), len(own) - 1)
        hit = own[places] == self.flat
        common = np.bincount(self.row[hit], minlength=len(self.values))
        end = np.minimum(self.ends[at], self.ends)
        below = np.bincount(self.row[self.flat <= end[self.row]], minlength=len(self.values))
        sample = below + np.searchsorted(own, end, "right") - common
        good = rows & may_be_linked(common, sample, self.sizes, self.sizes[at])
        good[at] = False
        return np.flatnonzero(good)

    def overlaps(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """How many values the sketches of ``left`` and ``right``, row numbers, have in common."""
        found = np.zeros((len(left), len(right)), dtype=np.float32)
        parts = [np.concatenate([self.values[at] for at in rows]) for rows in (left, right)]
        shared = np.intersect1d(*parts)
        for start in range(0, len(shared), COLUMNS):
            columns = shared[start : start + COLUMNS]
            found += self._incidence(left, columns) @ self._incidence(right, columns).T
        return np.rint(found).astype(np.int64)

    def _incidence(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Which sketch has which of the sorted values, as 0 and 1."""
        flat = np.concatenate([self.values[at] for at in rows])
        row = np.repeat(np.arange(len(rows)), self.lengths[rows])
        place = np.minimum(np.searchsorted(columns, flat), len(columns) - 1)
        hit = columns[place] == flat
        found = np.zeros((len(rows), len(columns)), dtype=np.float32)
        found[row[hit], place[hit]] = 1
        return found

    def near(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which of ``left`` may be linked with which of ``right``, row numbers."""
        common = self.overlaps(left, right)
        of_left = [np.searchsorted(self.values[at], self.ends[right], "right") for at in left]
        of_right = [np.searchsorted(self.values[at], self.ends[left], "right") for at in right]
        sample = np.array(of_left) + np.array(of_right).T - common
        return may_be_linked(common, sample, self.sizes[left][:, None], self.sizes[right][None, :])


# --- lists -----------------------------------------------------------------------------------


def _lists(sets: DataFrame) -> DataFrame:
    """Rows (value, set_id, size, n, low, blocks): each list's members, its length, the smallest."""
    exploded = sets.select("set_id", "size", F.explode("listed").alias("value"))
    counted = exploded.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(counted, "shared")
    total = shared.agg(F.sum("n")).first()[0] or 0
    found = join_counted(exploded, shared, "value", total)
    # Values of one set only are the rarest and take their places without being here.
    places = F.least(F.col("size"), F.lit(LISTED))
    least = F.when(F.col("size") > LISTED, F.lit(SHARED)).otherwise(
        F.ceil(F.col("size") * PERCENT[0] / PERCENT[1])
    )
    rarest = found.groupBy("set_id").agg(
        F.sort_array(F.collect_list(F.struct("n", "value"))).alias("values"),
        F.first(places - least + 1).alias("places"),
        F.first(places).alias("all"),
        F.first("size").alias("size"),
    )
    left = F.col("places") - (F.col("all") - F.size("values"))
    chosen = rarest.where(left > 0).select(
        "set_id", "size", F.explode(F.slice("values", F.lit(1), left.cast("int"))).alias("one")
    )
    chosen = materialize(chosen.select("set_id", "size", F.col("one.value").alias("value")), "lists")
    lists = (
        chosen.groupBy("value")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("set_id").alias("low"),
            F.sum("size").alias("shingles"),
            F.bit_xor(F.xxhash64("set_id")).alias("members"),
            F.sum(F.xxhash64("set_id", F.lit(1)).cast("decimal(38,0)")).alias("more"),
        )
        .where("n > 1")
    )
    once = lists.groupBy("n", "low", "shingles", "members", "more").agg(F.min("value").alias("value"))
    blocks = _blocks(F.col("n"), F.col("shingles")).alias("blocks")
    once = materialize(once.select("value", "n", "low", blocks), "lists")
    return materialize(join_counted(chosen, once, "value", chosen.count()), "members")


def _leader_pairs(members: DataFrame) -> DataFrame:
    """Pairs (leader, set_id) that may be linked, from rows (value, block, set_id, size, sketch)."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["value", "block"]):
            ids = table.column("set_id").to_numpy()
            ids, first = np.unique(ids, return_index=True)
            if len(ids) < 2:
                continue
            table = table.take(pa.array(first))
            own = Sketches(table.column("size").to_numpy(), table.column("sketch").to_pylist())
            free = np.ones(len(ids), dtype=bool)
            for _ in range(LEADERS):
                leader = int(free.argmax())
                if not free[leader]:
                    break
                free[leader] = False
                near = own.similar(leader, free)
                free[near] = False
                if len(near):
                    yield _columns(
                        leader=np.full(len(near), ids[leader]), set_id=ids[near]
                    )

    return members.mapInArrow(run, "leader long, set_id long")


def _columns(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def _blocks(n: Column, shingles: Column) -> Column:
    """How many blocks so many sets with so many shingles make."""
    return F.greatest(F.ceil(n / BLOCK_SETS), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")


def _block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("set_id"), blocks).cast("int")


def _all(blocks: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), blocks - 1))


def _by_leaders(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Distinct pairs (leader, set_id) of all lists. A list's smallest member leads all its blocks."""
    blocks = F.col("blocks")
    others = lists.select("value", _block(blocks).alias("block"), "set_id")
    lows = lists.where("set_id = low and blocks > 1").select("value", _all(blocks).alias("block"), "set_id")
    members = others.unionByName(lows).join(sets.select("set_id", "size", "sketch"), "set_id")
    keys = ["value", "block"]
    rows = members.repartition(*keys).sortWithinPartitions(*keys)
    return _leader_pairs(rows).distinct()


# --- full sets -------------------------------------------------------------------------------


def _full(docs: DataFrame, sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (set_id, shingles) of the wanted sets, from the text of one row of each."""
    of = sets.join(wanted, "set_id", "left_semi").select(
        "set_id", "set_key", F.col("doc_id").alias("__doc_id"), F.col("text_key").alias("__text_key")
    )
    same = (F.col("text_key") == F.col("__text_key")) & F.col("doc_id").eqNullSafe(F.col("__doc_id"))
    texts = docs.join(of, same).select("set_id", "set_key", "text")

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        shingler, held, size = Shingler(WIDTH), [], 0
        for batch in batches:
            ids, keys, texts = (batch.column(name) for name in ("set_id", "set_key", "text"))
            for at in range(batch.num_rows):
                shingles = _shingles(shingler, texts[at].as_py())
                if _key(shingles) == keys[at].as_py():
                    held.append((ids[at].as_py(), shingles.tobytes()))
                    size += shingles.nbytes
                if size > BATCH_BYTES:
                    yield _set_rows(held)
                    held, size = [], 0
        if held:
            yield _set_rows(held)

    # Repeated rows are the same text twice.
    return texts.mapInArrow(run, "set_id long, shingles binary").dropDuplicates(["set_id"])


def _set_rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    ids, sets = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["set_id", "shingles"]
    )


def common_with(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted set with others."""
    flat = np.concatenate(others)
    places = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    row = np.repeat(np.arange(len(others)), [len(other) for other in others])
    return np.bincount(row[own[places] == flat], minlength=len(others))


def _confirmed(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """Links (a, b) among pairs (leader, set_id), by full sets.

    The followers of a frequent leader are dealt to several chunks, each with its leader's set.
    """
    total = pairs.count()
    counts = pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("n"))
    often = counts.where(F.col("n") > frequent_bound(total))
    chunk = F.pmod(F.xxhash64("set_id"), F.ceil(F.coalesce("n", F.lit(1)) / CHUNK)).cast("int")
    dealt = materialize(
        pairs.join(F.broadcast(often), "leader", "left").select(
            "leader", F.coalesce(chunk, F.lit(0)).alias("chunk"), "set_id"
        ),
        "pairs",
    )
    leaders = dealt.select("leader", "chunk", F.col("leader").alias("set_id")).distinct()
    keys = ["leader", "chunk"]
    rows = dealt.unionByName(leaders).join(full, "set_id")
    rows = rows.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["leader", "chunk"]):
            ids, leader = table.column("set_id").to_numpy(), table["leader"][0].as_py()
            sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("shingles").to_pylist()]
            own = sets[int(np.flatnonzero(ids == leader)[0])]
            sizes = np.array([len(x) for x in sets])
            good = linked(common_with(own, sets), sizes, len(own)) & (ids != leader)
            if good.any():
                yield _columns(a=ids[good], b=np.full(good.sum(), leader))

    return rows.mapInArrow(run, "a long, b long")


# --- what leaders leave ----------------------------------------------------------------------


def _pairs_of_blocks(labelled: DataFrame) -> DataFrame:
    """Rows (value, i, j, block, set_id, root) for each pair (i, j) of blocks that a set is in.

    Sets of a list's largest group are only compared with the rest, so they make blocks of their
    own, 0 and up, and meet the rest's blocks, -1 and down; those meet each other too. Lists with
    one group only have no pairs.
    """
    by_root = labelled.groupBy("value", "root").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles")
    )
    largest = by_root.groupBy("value").agg(
        F.max(F.struct("n", "shingles", "root")).alias("top"),
        F.sum("n").alias("n"),
        F.sum("shingles").alias("shingles"),
    )
    top = F.col("top")
    mixed = largest.where(F.col("n") > top["n"]).select(
        "value",
        "n",
        top["root"].alias("largest"),
        _blocks(top["n"], top["shingles"]).alias("blocks"),
        _blocks(F.col("n") - top["n"], F.col("shingles") - top["shingles"]).alias("rest"),
    )
    mixed = materialize(mixed, "mixed")
    rows = join_counted(labelled, mixed, "value", labelled.count())
    of_largest, blocks, rest = F.col("root") == F.col("largest"), F.col("blocks"), F.col("rest")
    block = F.when(of_largest, _block(blocks)).otherwise(-1 - _block(rest)).alias("block")
    whole = rows.select("value", "set_id", "root", block, blocks, rest)
    last = F.when(F.col("block") >= 0, F.lit(-1)).otherwise(blocks - 1)
    other = F.explode(F.sequence(-rest, last)).alias("other")
    return whole.select("value", "set_id", "root", "block", other).select(
        "value",
        "set_id",
        "root",
        "block",
        F.greatest("block", "other").alias("i"),
        F.least("block", "other").alias("j"),
    )


def _across(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Table]:
    """Ids, groups, and which sets are on which side of a pair of blocks; each set once."""
    _, first = np.unique(table.column("set_id").to_numpy(), return_index=True)
    table = table.take(pa.array(first))
    block = table.column("block").to_numpy()
    ids, root = table.column("set_id").to_numpy(), table.column("root").to_numpy()
    return ids, root, block == table["i"][0].as_py(), block == table["j"][0].as_py(), table


def _possible(
    own: Sketches, root: np.ndarray, left: np.ndarray, right: np.ndarray
) -> Iterator[tuple[int, np.ndarray]]:
    """Pairs of the two sides, of different groups, that may be linked: one set and its others.

    Two sets of the largest group aren't compared, so a group that is nearly whole costs little.
    """
    roots, counts = np.unique(root, return_counts=True)
    rest = root != roots[counts.argmax()]
    sides = [(left & rest, right)]
    if (left & right).any():
        sides[0] = (left & rest, left)
    else:
        sides.append((left & ~rest, right & rest))
    for one, other in sides:
        others = np.flatnonzero(other)
        rows = np.flatnonzero(one)
        for start in range(0, len(rows) if len(others) else 0, ROWS):
            part = rows[start : start + ROWS]
            near = own.near(part, others) & (root[part][:, None] != root[others][None, :])
            for at in np.flatnonzero(near.any(axis=1)).tolist():
                yield int(part[at]), others[near[at]]


def _undecided(rows: DataFrame) -> DataFrame:
    """Rows (value, i, j, block, set_id, root) of sets that may be linked with one of another group."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["value", "i", "j"]):
            ids, root, left, right, table = _across(table)
            if not left.any() or not right.any() or (root == root[0]).all():
                continue
            own = Sketches(table.column("size").to_numpy(), table.column("sketch").to_pylist())
            wanted = np.zeros(len(ids), dtype=bool)
            for at, near in _possible(own, root, left, right):
                wanted[near] = wanted[at] = True
            if wanted.any():
                names = ["value", "i", "j", "block", "set_id", "root", "size", "sketch"]
                kept = table.select(names).take(pa.array(np.flatnonzero(wanted)))
                yield from kept.combine_chunks().to_batches()

    schema = "value long, i int, j int, block int, set_id long, root long, size long, sketch binary"
    return rows.mapInArrow(run, schema)


def _joining(rows: DataFrame) -> DataFrame:
    """Links (a, b) between groups that are confirmed on full sets, no more than join them."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["value", "i", "j"]):
            ids, root, left, right, table = _across(table)
            own = Sketches(table.column("size").to_numpy(), table.column("sketch").to_pylist())
            sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("shingles").to_pylist()]
            now, sizes = root.copy(), own.sizes
            for at, near in _possible(own, root, left, right):
                near = near[now[near] != now[at]]
                if not len(near):
                    continue
                common = common_with(sets[at], [sets[other] for other in near])
                for other in near[linked(common, sizes[near], sizes[at])].tolist():
                    if now[other] != now[at]:
                        yield _columns(a=root[[other]], b=root[[at]])
                        now[now == now[other]] = now[at]

    return rows.mapInArrow(run, "a long, b long")


def _by_blocks(lists: DataFrame, sets: DataFrame, roots: DataFrame, full: DataFrame) -> DataFrame:
    """Links (a, b) between groups that share a list."""
    labelled = lists.select("value", "set_id", "size").join(roots, "set_id", "left")
    labelled = materialize(labelled.withColumn("root", F.coalesce("root", "set_id")), "members")
    pairs = _pairs_of_blocks(labelled)
    members = pairs.join(sets.select("set_id", "size", "sketch"), "set_id")
    keys = ["value", "i", "j"]
    members = members.repartition(*keys).sortWithinPartitions(*keys)
    undecided = materialize(_undecided(members), "undecided")
    whole = undecided.join(full, "set_id").repartition(*keys).sortWithinPartitions(*keys)
    return _joining(whole).distinct()


# --- the operator ----------------------------------------------------------------------------


def near_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id of its group) and kept.

    ``kept`` says whether the row's id is its group's.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_key")
    )
    sketched = materialize(_sketches(rows), "sketches")
    with_words = sketched.where("size > 0")
    # Fixed by the write.
    set_id = F.monotonically_increasing_id().alias("set_id")
    by_key = with_words.groupBy("set_key").agg(
        F.min(F.struct("doc_id", "text_key")).alias("one"),
        F.min("doc_id").alias("low_id"),
        F.count(F.lit(1)).alias("copies"),
        F.first("size").alias("size"),
        F.first("listed").alias("listed"),
        F.first("sketch").alias("sketch"),
    )
    sets = materialize(
        by_key.select(
            set_id, "set_key", "one.doc_id", "one.text_key", "low_id", "copies", "size", "listed", "sketch"
        ),
        "sets",
    )
    lists = _lists(sets)
    full = materialize(_full(rows, sets, lists.select("set_id").distinct()), "full-sets")
    led = _confirmed(materialize(_by_leaders(lists, sets), "pairs"), full)
    first = materialize(components(led, "groups").withColumnRenamed("node", "set_id"), "groups")
    joined = components(_by_blocks(lists, sets, first, full), "groups")
    last = joined.select(F.col("node").alias("first"), F.col("root").alias("last"))
    known = (
        sets.select("set_id", "set_key", "low_id", "copies")
        .join(first.withColumnRenamed("root", "first"), "set_id", "left")
        .withColumn("first", F.coalesce("first", "set_id"))
        .join(last, "first", "left")
        .select("set_key", "low_id", "copies", F.coalesce("last", "first").alias("root"))
    )
    known = materialize(known, "known")
    lowest = known.groupBy("root").agg(F.min("low_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    lowest = materialize(lowest, "lowest")
    named = join_counted(known, lowest, "root", known.count())
    named = materialize(named.select("set_key", "component_id", F.col("copies").alias("n")), "named")
    found = join_counted(
        with_words.select("doc_id", "size", "set_key"), named, "set_key", sketched.count()
    ).select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    alone = sketched.where("size = 0").select(
        "doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id")
    )
    return found.unionByName(alone).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def recall_of_lists() -> float:
    """The chance that two large sets at the threshold share ``SHARED`` of ``LISTED`` values."""
    share = PERCENT[0] / PERCENT[1]
    return sum(
        math.comb(LISTED, n) * share**n * (1 - share) ** (LISTED - n) for n in range(SHARED, LISTED + 1)
    )


# All pairs of sets that share a shingle, so it is for tables of moderate size.
COMPONENTS_SQL = f"""
WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
        FROM documents),
    shingled AS MATERIALIZED (
        SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WIDTH} THEN [w]
            ELSE list_distinct(list_transform(range(1, len(w) - {WIDTH - 2}),
                lambda i: w[i : i + {WIDTH - 1}])) END AS s
        FROM words),
    sets AS MATERIALIZED (
        SELECT row_number() OVER () AS k, * FROM (
            SELECT list_sort(s) AS s, min(doc_id) AS low FROM shingled WHERE len(s) > 0 GROUP BY 1)),
    places AS MATERIALIZED (SELECT k, len(s) AS n, unnest(s) AS shingle FROM sets),
    links AS MATERIALIZED (
        SELECT a.k AS a, b.k AS b FROM places a JOIN places b ON a.shingle = b.shingle AND a.k <> b.k
        GROUP BY a.k, b.k, a.n, b.n
        HAVING {PERCENT[1]} * count(*) >= {PERCENT[0]} * (a.n + b.n - count(*))),
    reach AS (
        SELECT k AS a, k AS b FROM sets UNION
        SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
    ids AS (SELECT r.a AS k, min(s.low) AS component_id FROM reach r JOIN sets s ON s.k = r.b GROUP BY r.a)
SELECT doc_id, n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM (
    SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles,
        CASE WHEN len(d.s) = 0 THEN d.doc_id ELSE i.component_id END AS component_id
    FROM shingled d LEFT JOIN sets s ON s.s = list_sort(d.s) LEFT JOIN ids i ON i.k = s.k)
"""
