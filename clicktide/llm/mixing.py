"""Mixing sources to target weights, with DataFrame functions only.

Sizes are counted in words. The targets of all sources add up to the size of the whole table and
are shared by weight, but no target is above ``MAX_REPEATS`` times its source's size; what is above
goes to the other sources by weight until none is above. A source's repetition rate is its target
over its size. A document is emitted floor(rate) times, and once more if a number in [0, 1) made
from a hash of a seed and its id is below the rate's fraction, so that a rerun gives the same rows.

Only one row per source meets in a single task, to share the targets: this is the table of sources,
not of documents. It is joined to the documents by broadcast while it has at most
``MAX_BROADCAST_SOURCES`` rows, which is checked, and by a salted shuffle beyond.

Defined cases: a null text has size 0; a null source is a source of its own, ordered last; sources
of size 0 have target 0 and rate 0; rows with a null id use a hash of their text instead; repeated
rows are decided alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clicktide.llm.words import WORD_PATTERN
from clicktide.session import materialize

# The weights of the sources in order, repeating, and the cap on a target.
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3

SEED = "mix-1"
MAX_BROADCAST_SOURCES = 100_000
SALTS = 64

# Names of work columns; nobody else's table has them.
_SIZE, _SOURCE, _RATE = "__mix_size", "__mix_source", "__mix_rate"


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, source: str, size: str) -> DataFrame:
    """Per source: ``source_size``, ``target`` and ``rate``.

    The shares stop at the caps like water in vessels of different depth: ordered by the depth
    cap / weight, the first sources are full, and the rest share what is left by weight. As long
    as sources are full, the level rises from each to the next, and it falls from the first that
    isn't, so the level that all others share is the highest.
    """
    totals = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    position = F.pmod(F.row_number().over(in_order) - 1, F.lit(len(WEIGHTS)))
    weights = F.array(*[F.lit(float(weight)) for weight in WEIGHTS])
    weighed = totals.select(
        "source",
        "source_size",
        F.element_at(weights, (position + 1).cast("int")).alias("weight"),
        (F.col("source_size") * float(MAX_REPEATS)).alias("cap"),
    )
    by_depth = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_depth.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    full = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(
        F.sum("weight").over(before), F.lit(0.0)
    )
    whole = F.sum("source_size").over(everything)
    levels = weighed.select("*", ((whole - full) / weight_left).alias("level"))
    shared = levels.select("*", F.max("level").over(everything).alias("shared_level"))
    target = F.least(F.col("cap"), F.col("shared_level") * F.col("weight"))
    return shared.select(
        "source",
        "source_size",
        target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size"))
        .otherwise(F.lit(0.0))
        .alias("rate"),
    )


def _draw(id_col: str, text: str) -> Column:
    """A number in [0, 1) from the first 32 bits of a hash."""
    own = F.coalesce(F.col(id_col).cast("string"), F.md5(F.col(text)), F.lit(""))
    digits = F.substring(F.md5(F.concat(F.lit(SEED + ":"), own)), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(2**32))


def _with_targets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Join the targets to rows by their source; null is a source too."""
    # One row per source, counted and read without adding up the documents again.
    targets = materialize(targets, "targets")
    named = targets.select(
        F.col("source").alias("__target_source"), "source_size", "target", "rate"
    )
    same = F.col(_SOURCE).eqNullSafe(F.col("__target_source"))
    if targets.count() <= MAX_BROADCAST_SOURCES:
        return rows.join(F.broadcast(named), same).drop("__target_source")
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("__mix_draw"), F.lit(SALTS)))
    copies = named.withColumn("__target_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    both = same & (F.col("__salt") == F.col("__target_salt"))
    return salted.join(copies, both).drop("__target_source", "__target_salt", "__salt")


def _decided(docs: DataFrame, id_col: str, text: str, source: str) -> DataFrame:
    sized = docs.select(
        "*",
        size_of(text).alias(_SIZE),
        F.col(source).alias(_SOURCE),
        _draw(id_col, text).alias("__mix_draw"),
    )
    return _copied(sized)


def _copied(sized: DataFrame) -> DataFrame:
    """Rows with a size, source and draw, with their targets and copies."""
    targets = source_targets(sized.select(_SOURCE, _SIZE), _SOURCE, _SIZE)
    renamed = _with_targets(sized, targets)
    whole = F.floor("rate")
    extra = (F.col("__mix_draw") < F.col("rate") - whole).cast("int")
    return renamed.withColumn("__mix_copies", (whole + extra).cast("int"))


def decide(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """Per row: id, size, its source's size and target, the number of copies and the words taken."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source")
    )
    # Without texts, so that each is looked at once.
    sized = rows.select(
        "doc_id",
        size_of("text").alias(_SIZE),
        F.col("source").alias(_SOURCE),
        _draw("doc_id", "text").alias("__mix_draw"),
    )
    return _copied(materialize(sized, "sizes")).select(
        "doc_id",
        F.col(_SIZE).alias("size"),
        "source_size",
        "target",
        F.col("__mix_copies").alias("copies"),
        (F.col(_SIZE) * F.col("__mix_copies")).alias("taken"),
    )


def mix(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """The mixed table: every row as often as it is taken, with its own columns."""
    own = [F.col(f"`__own`.`{name}`").alias(name) for name in docs.columns]
    packed = docs.select(
        F.col(id_col).alias("__id"),
        F.col(text).alias("__text"),
        F.col(source).alias("__source"),
        F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("__own"),
    )
    taken = _decided(packed, "__id", "__text", "__source")
    copies = F.explode(F.array_repeat(F.lit(0), F.col("__mix_copies")))
    return taken.select("__own", copies.alias("__copy")).select(*own)


DECIDE_SQL = f"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '{WORD_PATTERN}')), 0)::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, md5(text), '')) AS digest
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, source_size * 3.0::DOUBLE AS cap,
         ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
  FROM totals
), levels AS (
  SELECT *, ((SELECT sum(source_size) FROM totals)
             - coalesce(sum(cap) OVER before, 0))
            / ((SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed
  WINDOW before AS (ORDER BY cap / weight, source ASC NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size,
         least(cap, (SELECT max(level) FROM levels) * weight) AS target
  FROM levels
), rated AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || substr(digest, 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT
         AS taken
FROM rated
"""
