"""Vector codes by product quantisation, with the adaptive bounds of Drake and Hamerly.

Vectors become whole numbers (``SCALE`` times each component, rounded down) and are cut into
``PARTS`` equal parts. Each part position has a codebook of up to ``ENTRIES`` entries, which starts
with that part of the vectors with the smallest ids. ``ROUNDS`` times every part goes to its nearest
entry and every entry to the mean of its parts, rounded down; then parts are assigned once more.

Between rounds a table in the shared folder keeps, for each vector and part, the entry it has, its
``b`` next entries in the order of lower bounds on their distances, and one outer lower bound for all
others. Bounds are whole numbers, rounded down. When entries move, each bound falls by the way its
entry went, the outer one by the longest way. The distance to the own entry is computed exactly; an
entry whose squared bound is above it is farther away for certain and isn't looked at. Every other
listed entry is compared in whole numbers, and if the outer bound doesn't suffice, all are. So the
result is that of plain assignment, ties included. ``b`` adapts: it starts at a quarter of the
entries and falls for a part position, down to an eighth, while hardly any vector needs more.

A round is one pass over the table, which writes the next one, and one that adds up the parts of
each entry: per task, then by key. The driver gets the sums per entry and position and nothing that
grows with the table. The table before is deleted when the next one has been read in full.

Defined cases: vectors that are null or hold null or non-finite components are left out. All others
must have one number of components; those with another than the most frequent (of equally frequent
ones the larger) have a null code and null errors, and do not count. Parts differ by one component at
most if their number is not a multiple of ``PARTS``. Components are held between limits within which
the squared error of a vector fits into a long (2^27 for 64 components). Fewer vectors than entries
give as many entries. Of rows with one id, those with the smaller vector come first; null ids come
last. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from clicktide.llm.arrow import Batches
from clicktide.session import fresh_folder, materialize

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
# Of the vectors, the share that may need all entries before a list is kept as long as it is.
SPARED = 0.02
# Labels up to this number are sent to all tasks with their sums.
MAX_BROADCAST_LABELS = 100_000
SALTS = 16

# Bounds are kept in 16 bits; one that is cut off stays a bound.
_MOST = np.iinfo(np.uint16).max


@dataclass(frozen=True)
class Layout:
    """How vectors and bounds are kept; the same for all rows of a table."""

    size: int
    limit: int
    kind: str
    entries: int

    @property
    def cuts(self) -> list[int]:
        return [part * self.size // PARTS for part in range(PARTS + 1)]


@dataclass(frozen=True)
class Codebooks:
    """Per part an array (entry, position) of whole numbers."""

    layout: Layout
    parts: list[np.ndarray]

    def digest(self) -> str:
        numbers = [str(value) for part in self.parts for value in part.ravel().tolist()]
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def limit_of(size: int) -> int:
    """Components up to this, and differences of twice that, have squares whose sum is a long."""
    return 1 << min(30, (60 - math.ceil(math.log2(max(size, 1)))) // 2)


def whole_numbers(vectors: np.ndarray, limit: int) -> np.ndarray:
    return np.clip(np.floor(vectors.astype(np.float64) * SCALE), -limit, limit).astype(np.int64)


# --- bounds of one part ----------------------------------------------------------------------


def root(squares: np.ndarray) -> np.ndarray:
    """Square roots of whole numbers, rounded down."""
    found = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    return found - (found * found > squares)


def distances(values: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all values (rows) to all entries, in whole numbers."""
    found = np.empty((len(values), len(entries)), dtype=np.int64)
    for at, entry in enumerate(entries):
        apart = values - entry
        found[:, at] = np.einsum("ij,ij->i", apart, apart)
    return found


@dataclass
class Bounds:
    """Of one part of several vectors: own entry, next entries, their lower bounds and the outer one.

    ``looked`` counts the next entries that the last assignment compared; one more means all.
    """

    own: np.ndarray
    next: np.ndarray
    low: np.ndarray
    looked: np.ndarray

    @staticmethod
    def fresh(values: np.ndarray, entries: np.ndarray, listed: int) -> tuple[Bounds, np.ndarray]:
        """Bounds by comparing all entries, and the distances to the own ones."""
        found = distances(values, entries)
        order = np.argsort(found, axis=1, kind="stable")
        ranked = np.take_along_axis(found, order, axis=1)
        low = np.full((len(values), listed + 1), _MOST, dtype=np.int64)
        near = root(ranked[:, 1 : listed + 2])
        low[:, : near.shape[1]] = np.minimum(near, _MOST)
        looked = np.full(len(values), listed + 1)
        return Bounds(order[:, 0], order[:, 1 : listed + 1], low, looked), ranked[:, 0]

    def shorter(self, listed: int) -> Bounds:
        """The same with fewer next entries; the outer bound covers the others."""
        if listed == self.next.shape[1]:
            return self
        low = self.low[:, : listed + 1].copy()
        low[:, listed] = self.low[:, listed:].min(axis=1)
        return Bounds(self.own, self.next[:, :listed], low, self.looked)

    def moved(self, ways: np.ndarray) -> Bounds:
        """After each entry has gone up to so far."""
        low = self.low.copy()
        low[:, :-1] -= ways[self.next]
        low[:, -1] -= ways.max()
        return Bounds(self.own, self.next, np.maximum(low, 0), self.looked)

    def assigned(self, values: np.ndarray, entries: np.ndarray) -> tuple[Bounds, np.ndarray]:
        """Bounds after assignment to the nearest entry, and the distances to it."""
        listed = self.next.shape[1]
        apart = values - entries[self.own]
        start = np.einsum("ij,ij->i", apart, apart)
        uncertain = self.low**2 <= start[:, None]
        own, best, low, near = self.own.copy(), start.copy(), self.low.copy(), self.next.copy()
        place = np.full(len(values), -1)
        for at in range(listed):
            rows = np.flatnonzero(uncertain[:, at] & ~uncertain[:, listed])
            if not len(rows):
                continue
            entry = self.next[rows, at]
            apart = values[rows] - entries[entry]
            exact = np.einsum("ij,ij->i", apart, apart)
            low[rows, at] = np.minimum(root(exact), _MOST)
            nearer = (exact < best[rows]) | ((exact == best[rows]) & (entry < own[rows]))
            rows = rows[nearer]
            own[rows], best[rows], place[rows] = entry[nearer], exact[nearer], at
        # The entry that was left takes the place of the one that was found.
        left = np.flatnonzero(place >= 0)
        near[left, place[left]] = self.own[left]
        low[left, place[left]] = np.minimum(root(start[left]), _MOST)
        order = np.argsort(low[:, :listed], axis=1, kind="stable")
        near = np.take_along_axis(near, order, axis=1)
        low[:, :listed] = np.take_along_axis(low[:, :listed], order, axis=1)
        looked = uncertain[:, :listed].sum(axis=1)
        rows = np.flatnonzero(uncertain[:, listed])
        if len(rows):
            anew, best[rows] = Bounds.fresh(values[rows], entries, listed)
            own[rows], near[rows], low[rows], looked[rows] = anew.own, anew.next, anew.low, anew.looked
        return Bounds(own, near, low, looked), best

    def packed(self) -> np.ndarray:
        """Bytes of each vector's part."""
        low = np.ascontiguousarray(self.low.astype("<u2")).view(np.uint8).reshape(len(self.own), -1)
        columns = [self.own[:, None], self.next, self.looked[:, None]]
        return np.hstack([np.hstack(columns).astype(np.uint8), low])

    @staticmethod
    def width(listed: int) -> int:
        return 2 + listed + 2 * (listed + 1)

    @staticmethod
    def unpacked(rows: np.ndarray, listed: int) -> Bounds:
        head = rows[:, : listed + 2].astype(np.int64)
        low = np.ascontiguousarray(rows[:, listed + 2 :]).view("<u2").astype(np.int64)
        return Bounds(head[:, 0], head[:, 1 : listed + 1], low, head[:, -1])


def _bytes_of(column: pa.Array, n: int) -> np.ndarray:
    """Binary values of one length, as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(n, -1)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in rows], pa.binary())


def _bounds_of(column: pa.Array, n: int, listed: list[int]) -> list[Bounds]:
    rows, at, found = _bytes_of(column, n), 0, []
    for length in listed:
        found.append(Bounds.unpacked(rows[:, at : at + Bounds.width(length)], length))
        at += Bounds.width(length)
    return found


# --- rounds ----------------------------------------------------------------------------------


def _numbers(vectors: DataFrame, layout: Layout) -> DataFrame:
    """Rows (vec_id, label, numbers) of vectors (vec_id, label, vector); numbers are packed."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
            own = whole_numbers(flat.reshape(batch.num_rows, layout.size), layout.limit)
            packed = np.ascontiguousarray(own.astype(layout.kind)).view(np.uint8)
            columns = [batch.column("vec_id"), batch.column("label"), _binary(packed)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "numbers"])

    kept = [vectors.schema["vec_id"], vectors.schema["label"]]
    return vectors.mapInArrow(run, StructType(kept).add("numbers", "binary"))


@dataclass(frozen=True)
class Step:
    """What a pass over the table needs to know: entries, how far they went, lengths of the lists."""

    codebooks: Codebooks
    ways: list[np.ndarray] | None
    listed: list[int]
    listed_before: list[int]

    def assign(self, batch: pa.RecordBatch) -> Iterator[tuple[Bounds, np.ndarray]]:
        """Per part its bounds and the distances to the nearest entry."""
        layout, n = self.codebooks.layout, batch.num_rows
        values = _bytes_of(batch.column("numbers"), n).view(layout.kind).astype(np.int64)
        values = values.reshape(n, layout.size)
        before = None if self.ways is None else _bounds_of(batch.column("bounds"), n, self.listed_before)
        for part, entries in enumerate(self.codebooks.parts):
            own = values[:, layout.cuts[part] : layout.cuts[part + 1]]
            if before is None:
                yield Bounds.fresh(own, entries, self.listed[part])
            else:
                bounds = before[part].shorter(self.listed[part]).moved(self.ways[part])
                yield bounds.assigned(own, entries)


def _assigned(rows: DataFrame, step: Step) -> DataFrame:
    """The table with the bounds of the next round."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                packed = np.hstack([bounds.packed() for bounds, _ in step.assign(batch)])
                columns = [batch.column(name) for name in ("vec_id", "label", "numbers")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, _binary(packed)], names=["vec_id", "label", "numbers", "bounds"]
                )

    kept = [rows.schema[name] for name in ("vec_id", "label", "numbers")]
    return rows.mapInArrow(run, StructType(kept).add("bounds", "binary"))


def _sums(rows: DataFrame, layout: Layout, listed: list[int]) -> list:
    """Rows (part, entry, place, total) over the whole table.

    Place -1 has the number of an entry's parts; entry -1 has, at a place, how many vectors compared
    so many next entries.
    """

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        width = max(b - a for a, b in zip(layout.cuts, layout.cuts[1:]))
        totals = np.zeros((PARTS, layout.entries, width + 1), dtype=object)
        looked = np.zeros((PARTS, max(listed) + 2), dtype=np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            values = _bytes_of(batch.column("numbers"), n).view(layout.kind).astype(np.int64)
            for part, bounds in enumerate(_bounds_of(batch.column("bounds"), n, listed)):
                own = values.reshape(n, layout.size)[:, layout.cuts[part] : layout.cuts[part + 1]]
                found = np.zeros((layout.entries, width + 1), dtype=np.int64)
                np.add.at(found[:, 1 : own.shape[1] + 1], bounds.own, own)
                found[:, 0] = np.bincount(bounds.own, minlength=layout.entries)
                totals[part] += found
                looked[part] += np.bincount(bounds.looked, minlength=looked.shape[1])
        made = [(p, e, at - 1, int(v)) for (p, e, at), v in np.ndenumerate(totals) if v]
        made += [(p, -1, at, int(v)) for (p, at), v in np.ndenumerate(looked) if v]
        names, kinds = ["part", "entry", "place", "total"], [pa.int32()] * 3 + [pa.int64()]
        columns = zip(*made) if made else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    counted = rows.select("numbers", "bounds").mapInArrow(run, "part int, entry int, place int, total long")
    total = F.sum(F.col("total").cast("decimal(20,0)")).alias("total")
    return counted.groupBy("part", "entry", "place").agg(total).collect()


def _next(codebooks: Codebooks, listed: list[int], sums: list) -> tuple[Codebooks, list, list[int]]:
    """Moved entries, how far each went at most, and the lengths of the lists from now on."""
    total = {(row["part"], row["entry"], row["place"]): int(row["total"]) for row in sums}
    parts, ways, lengths = [], [], []
    for part, entries in enumerate(codebooks.parts):
        new = entries.copy()
        for entry, place in np.ndindex(entries.shape):
            if n := total.get((part, entry, -1)):
                new[entry, place] = total.get((part, entry, place), 0) // n
        way = ((new - entries) ** 2).sum(axis=1)
        parts.append(new)
        ways.append(root(way) + 1)
        looked = [total.get((part, -1, at), 0) for at in range(listed[part] + 2)]
        lengths.append(adapted(looked, codebooks.layout.entries))
    return Codebooks(codebooks.layout, parts), ways, lengths


def adapted(looked: list[int], entries: int) -> int:
    """The length of the lists, given how many vectors compared 0, 1, ... listed and all entries.

    The shortest list for which few vectors need more; a list that is too short as it is stays.
    """
    listed, n = len(looked) - 2, sum(looked)
    least = min(listed, max(1, entries // 8))
    for length in range(least, listed):
        if sum(looked[length + 1 :]) <= SPARED * n:
            return length
    return listed


def _delete(folder: str, rows: DataFrame) -> None:
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# --- the operator ----------------------------------------------------------------------------


def _finite(vectors: DataFrame) -> DataFrame:
    """Vectors without null and non-finite components."""
    limit = F.lit(float("inf"))
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    return vectors.where(F.col("vector").isNotNull() & F.coalesce(good, F.lit(False)))


def _layout(vectors: DataFrame) -> Layout | None:
    sizes = vectors.groupBy(F.size("vector").alias("size")).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double"))))).alias("most"),
    )
    best = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    if best is None:
        return None
    limit = limit_of(best["size"])
    kind = "<i2" if (best["most"] or 0) * SCALE < 1 << 15 else "<i4"
    return Layout(best["size"], limit, kind, min(ENTRIES, best["n"]))


def _first(vectors: DataFrame, layout: Layout) -> Codebooks:
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(layout.entries)
    values = np.array([row["vector"] for row in rows.select("vector").collect()], dtype=np.float64)
    own = whole_numbers(values.reshape(layout.entries, layout.size), layout.limit)
    return Codebooks(layout, [own[:, a:b] for a, b in zip(layout.cuts, layout.cuts[1:])])


def _coded(rows: DataFrame, step: Step) -> DataFrame:
    """Rows (vec_id, label, codes, error) by a last assignment."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = list(step.assign(batch))
                codes = np.stack([bounds.own for bounds, _ in found], axis=1).astype(np.uint8)
                errors = np.sum([apart for _, apart in found], axis=0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("label"), _binary(codes), pa.array(errors)],
                    names=["vec_id", "label", "codes", "error"],
                )

    kept = [rows.schema["vec_id"], rows.schema["label"]]
    return rows.mapInArrow(run, StructType(kept).add("codes", "binary").add("error", "long"))


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> tuple[DataFrame, Codebooks | None]:
    """Rows (vec_id, label, codes, error) of all usable vectors, and the codebooks.

    ``codes`` has one byte per part. Without any vector there are no codebooks.
    """
    named = vectors.select(
        F.col(id_col).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector")
    )
    usable = _finite(named)
    layout = _layout(usable)
    if layout is None:
        empty = usable.select("vec_id", "label", F.lit(b"").alias("codes"), F.lit(0).cast("long").alias("error"))
        return empty.where("false"), None
    fitting = usable.where(F.size("vector") == layout.size)
    codebooks = _first(fitting, layout)
    listed = [min(max(1, layout.entries // 4), layout.entries - 1)] * PARTS
    step = Step(codebooks, None, listed, listed)
    now, before = _numbers(fitting, layout), None
    for _ in range(ROUNDS):
        folder = fresh_folder(vectors.sparkSession, "codes")
        made = _assigned(now, step)
        made.write.parquet(folder)
        now = vectors.sparkSession.read.schema(made.schema).parquet(folder)
        sums = _sums(now, layout, step.listed)
        if before:
            _delete(before, vectors)
        before = folder
        codebooks, ways, lengths = _next(step.codebooks, step.listed, sums)
        step = Step(codebooks, ways, lengths, step.listed)
    coded = materialize(_coded(now, step), "codes")
    _delete(before, vectors)
    others = usable.where(F.size("vector") != layout.size)
    unfit = others.select(
        "vec_id", "label", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("long").alias("error")
    )
    return coded.unionByName(unfit), codebooks


def decompress(coded: DataFrame, codebooks: Codebooks) -> DataFrame:
    """``coded`` with the ``vector`` that its codes stand for; null without codes."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [
                codes
                and np.concatenate([part[at] for part, at in zip(codebooks.parts, codes)]) / SCALE
                for codes in batch.column("codes").to_pylist()
            ]
            columns = [*batch.columns, pa.array(made, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "vector"])

    return coded.mapInArrow(run, StructType([*coded.schema.fields, StructField("vector", ArrayType(DoubleType()))]))


def _with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with the sum of errors over rows of the same label, nulls together."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = sums.select(F.col("label").alias("__label"), "label_error")
    same = F.col("label").eqNullSafe(F.col("__label"))
    if sums.limit(MAX_BROADCAST_LABELS + 1).count() <= MAX_BROADCAST_LABELS:
        return coded.join(F.broadcast(sums), same).drop("__label")
    # A frequent label's rows are dealt to several tasks, each with the label's sum.
    salted = coded.withColumn("__salt", F.pmod(F.xxhash64("vec_id", "codes"), F.lit(SALTS)))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    sums = sums.select("*", salts.alias("__part"))
    return salted.join(sums, same & (F.col("__salt") == F.col("__part"))).drop("__label", "__salt", "__part")


def code_digests(
    vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """Per usable vector its code in hex, its error, its label's error and the codebooks' digest."""
    coded, codebooks = compress(vectors, id_col, vector, label)
    return _with_label_errors(coded).select(
        "vec_id",
        F.lower(F.hex("codes")).alias("code"),
        "error",
        "label_error",
        F.lit(codebooks.digest() if codebooks else None).cast("string").alias("codebooks_sha256"),
    )


def _round_sql(at: int) -> str:
    """Assignment ``a`` to the entries ``c`` of a round, and the entries of the next."""
    return f"""
    a{at} AS MATERIALIZED (
        SELECT row, p, min(d * {ENTRIES} + e) % {ENTRIES} AS e, min(d) AS d FROM (
            SELECT row, p, e, CAST(sum((x.v - c.v) * (x.v - c.v)) AS BIGINT) AS d
            FROM x JOIN c{at} c USING (p, i) GROUP BY row, p, e)
        GROUP BY row, p),
    m{at} AS (
        SELECT p, e, i, CAST(sum(v) AS BIGINT) AS s, count(*) AS n
        FROM a{at} JOIN x USING (row, p) GROUP BY p, e, i),
    c{at + 1} AS MATERIALIZED (
        SELECT p, e, i, CASE WHEN n IS NULL THEN v ELSE (s - ((s % n) + n) % n) // n END AS v
        FROM c{at} LEFT JOIN m{at} USING (p, e, i)),"""


# For tables whose vectors have one number of components, a multiple of the number of parts.
CODES_SQL = f"""
WITH kept AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, vec_id, label,
            list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    x AS MATERIALIZED (
        SELECT row, (k - 1) // (len(v) // {PARTS}) AS p, (k - 1) % (len(v) // {PARTS}) AS i, v[k] AS v
        FROM (SELECT row, v, unnest(range(1, len(v) + 1)) AS k FROM kept)),
    c0 AS (SELECT p, row - 1 AS e, i, v FROM x WHERE row <= {ENTRIES}),{
    "".join(_round_sql(at) for at in range(ROUNDS))}
    last AS ({_round_sql(ROUNDS).split("MATERIALIZED (", 1)[1].split("GROUP BY row, p),")[0]}
        GROUP BY row, p),
    coded AS (
        SELECT row, string_agg(printf('%02x', e), '' ORDER BY p) AS code,
            CAST(sum(d) AS BIGINT) AS error
        FROM last GROUP BY row),
    books AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, i)) AS h FROM c{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    h AS codebooks_sha256
FROM kept JOIN coded USING (row), books
"""
