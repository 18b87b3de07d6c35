"""Conversations in reply order, by linking quotations to the messages that they come from.

A message may quote others, in lines that begin with one ``>`` for each level. Quotes are taken
apart by level; their lines and sentences are normalised (case, white space) and hashed, and joined
to the latest earlier message of the conversation that has the same line or sentence as its own.
The message answers the one that most of its outermost quotes come from, or, without quotes that
are found, the message before it. What is left of a message without quotes and the lines that
announce them is its own text, formatted as a turn of a chat.

The join is an as-of join on (conversation, hash) within blocks of ``BLOCK_TURNS`` turns, with the
latest turn of all blocks before brought in from sums of blocks; so neither a long conversation nor
a phrase that all messages share makes a large group. Roots and depths come from following the links
in doubling steps, a written table each.

Defined cases: a null text counts as empty; rows without a conversation or turn are conversations
of their own; rows with the same conversation and turn are one place in the order, with a row each;
a quote of which nothing is found links nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from clicktide.llm.arrow import per_row
from clicktide.session import materialize

BLOCK_TURNS = 1_000
# The key under which every message is found by the one after it.
ANY = 0

_QUOTED = re.compile(r"((?:[ \t]{0,3}>)+)[ \t]?(.*)", re.DOTALL)
# Lines that announce a quote.
_ANNOUNCED = re.compile(
    r"\s*(?:on|am|le|el)\b.*\b(?:wrote|schrieb|écrit|a écrit|escribió)\b.*:\s*", re.IGNORECASE
)
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


# --- one message -----------------------------------------------------------------------------


def split_levels(text: str | None) -> list[tuple[int, str]]:
    """Lines of a message, each with the level of its quote, 0 for its own."""
    lines = []
    for line in (text or "").split("\n"):
        match = _QUOTED.fullmatch(line)
        lines.append((match.group(1).count(">"), match.group(2)) if match else (0, line))
    return lines


def own_text(text: str | None) -> str:
    """The message without its quotes; a message that has none is left as it is."""
    lines = split_levels(text)
    if not any(level for level, _ in lines):
        return text or ""
    kept: list[str] = []
    for level, line in lines:
        if not level:
            kept.append(line)
            continue
        # The announcement may be parted from the quote by empty lines.
        at = len(kept) - 1
        while at >= 0 and not kept[at].strip():
            at -= 1
        if at >= 0 and _ANNOUNCED.fullmatch(kept[at]):
            del kept[at:]
    while kept and not kept[0].strip():
        kept.pop(0)
    while kept and not kept[-1].strip():
        kept.pop()
    return "\n".join(kept)


def passages(lines: list[str]) -> set[int]:
    """Hashes of the lines and of the sentences of each paragraph, normalised."""
    found: set[str] = set()
    paragraph: list[str] = []
    for line in [*lines, ""]:
        words = " ".join(line.casefold().split())
        if words:
            found.add(words)
            paragraph.append(words)
        elif paragraph:
            found.update(_SENTENCE_END.split(" ".join(paragraph)))
            paragraph = []
    return {_hash(words) for words in found if words}


def _hash(words: str) -> int:
    value = xxhash.xxh3_64_intdigest(words)
    return (value - (1 << 64) if value >> 63 else value) or 1


def parse(text: str | None) -> tuple[str, list[int], list[dict[str, int]]]:
    """Own text, hashes of its passages, and levels and hashes of the quoted passages."""
    lines = split_levels(text)
    own = own_text(text)
    runs: dict[int, list[str]] = {}
    last = 0
    for level, line in lines:
        if level:
            # A run of one level that another level interrupts is another paragraph.
            runs.setdefault(level, []).extend([""] * (level != last) + [line])
        last = level
    quoted = [
        {"level": level, "passage": passage}
        for level, run in sorted(runs.items())
        for passage in sorted(passages(run))
    ]
    return own, sorted(passages(own.split("\n"))), quoted


PARSED = [
    StructField("own", StringType()),
    StructField("own_passages", ArrayType(LongType())),
    StructField(
        "quoted",
        ArrayType(
            StructType([StructField("level", IntegerType()), StructField("passage", LongType())])
        ),
    ),
]


def _parsed(rows: DataFrame) -> DataFrame:
    def make() -> Callable[[list], list]:
        return lambda texts: [parse(text) for text in texts]

    kept = [field for field in rows.schema if field.name != "text"]
    return per_row(rows, "text", StructType([*kept, *PARSED]), make)


# --- links -----------------------------------------------------------------------------------


def latest_before(asking: DataFrame, having: DataFrame) -> DataFrame:
    """For each row (conv, turn, passage, ...) the latest earlier turn that has the passage.

    ``having`` has rows (conv, turn, passage). The result has a column ``found``, null if none.
    """
    key = ["conv", "passage"]
    block = F.floor(F.col("turn") / BLOCK_TURNS).alias("block")
    extra = [name for name in asking.columns if name not in ("conv", "turn", "passage")]
    asks = asking.select("*", block, F.lit(0).alias("has"))
    nothing = [F.lit(None).cast(asking.schema[name].dataType).alias(name) for name in extra]
    answers = having.select("conv", "turn", "passage", *nothing, block, F.lit(1).alias("has"))
    rows = asks.unionByName(answers.distinct())
    # At the same turn, those who ask come first: a message doesn't answer itself.
    before = (
        Window.partitionBy(*key, "block")
        .orderBy("turn", "has")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    here = F.last(F.when(F.col("has") == 1, F.col("turn")), ignorenulls=True).over(before)
    within = rows.withColumn("here", here).where("has = 0")
    blocks = rows.groupBy(*key, "block").agg(
        F.max(F.when(F.col("has") == 1, F.col("turn"))).alias("latest")
    )
    earlier = (
        Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = blocks.select(*key, "block", F.max("latest").over(earlier).alias("carried"))
    return within.join(carried.where("carried is not null"), [*key, "block"], "left").select(
        "conv", "turn", "passage", *extra, F.coalesce("here", "carried").alias("found")
    )


def _reply_links(parsed: DataFrame) -> DataFrame:
    """Per place (conv, turn): ``reply_to``, and ``linked`` if a quote says so."""
    quotes = parsed.select("conv", "turn", F.explode("quoted").alias("quote")).select(
        "conv", "turn", F.col("quote.passage").alias("passage"), F.col("quote.level").alias("level")
    )
    quoting = quotes.select("conv").distinct()
    own = (
        parsed.join(quoting, "conv", "left_semi")
        .select("conv", "turn", F.explode("own_passages").alias("passage"))
        .distinct()
    )
    places = parsed.select("conv", "turn").distinct()
    anybody = places.select("conv", "turn", F.lit(ANY).cast("long").alias("passage"))
    asking = quotes.unionByName(anybody.withColumn("level", F.lit(None).cast("int")))
    found = latest_before(asking.distinct(), own.unionByName(anybody))
    votes = (
        found.where("found is not null")
        .groupBy("conv", "turn", "level", "found")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # The outermost quote decides, then the number of its passages; the message before comes last.
    best = F.min_by(
        F.struct("found", F.col("level").isNotNull().alias("linked")),
        F.struct(F.coalesce("level", F.lit(2**31 - 1)), -F.col("n"), -F.col("found")),
    )
    links = votes.groupBy("conv", "turn").agg(best.alias("best"))
    return places.join(links, ["conv", "turn"], "left").select(
        "conv",
        "turn",
        F.col("best.found").alias("reply_to"),
        F.coalesce("best.linked", F.lit(False)).alias("linked"),
    )


def _with_depths(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Add ``root`` and ``depth``, following ``reply_to`` in steps that double.

    Places that have reached the first message of their thread rest; only the others are joined.
    """
    now = materialize(
        links.select(
            "*",
            F.coalesce("reply_to", "turn").alias("root"),
            F.col("reply_to").isNotNull().cast("long").alias("depth"),
            F.col("reply_to").isNull().alias("there"),
        ),
        "replies",
    )
    for _ in range(max_rounds):
        under_way = now.where(~F.col("there"))
        if under_way.isEmpty():
            return now.drop("there")
        ends = now.select(
            "conv",
            F.col("turn").alias("root"),
            F.col("root").alias("next_root"),
            F.col("depth").alias("next_depth"),
            F.col("there").alias("next_there"),
        )
        moved = under_way.join(ends, ["conv", "root"]).select(
            "conv",
            "turn",
            "reply_to",
            "linked",
            F.col("next_root").alias("root"),
            (F.col("depth") + F.col("next_depth")).alias("depth"),
            F.col("next_there").alias("there"),
        )
        now = materialize(now.where("there").unionByName(moved), "replies")
    raise RuntimeError("replies don't end")


# --- the operator ----------------------------------------------------------------------------


def chat_turn(role: Column, text: Column) -> Column:
    """A message as a turn of a chat."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), text, F.lit("\n"))


def reply_order(
    messages: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Per message: conv_id, root_turn, depth, turn, reply_to, linked, n_quoted, role, text, chat.

    Sorted by (conv_id, root_turn, depth, turn) every message is behind the one that it answers.
    ``root_turn`` is the first message of its thread, ``depth`` the number of messages before it on
    the way from there, ``linked`` says whether a quote led to ``reply_to``, ``n_quoted`` is the
    number of quoted passages, ``text`` has no quotes, ``chat`` is the formatted turn.
    """
    rows = messages.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.col(role).alias("role"),
        F.col(text).alias("text"),
    )
    parsed = materialize(_parsed(rows), "messages")
    placed = parsed.where(F.col("conv").isNotNull() & F.col("turn").isNotNull())
    depths = _with_depths(_reply_links(placed))
    known = placed.join(depths, ["conv", "turn"])
    alone = parsed.where(F.col("conv").isNull() | F.col("turn").isNull()).select(
        "*",
        F.lit(None).cast("long").alias("reply_to"),
        F.lit(False).alias("linked"),
        F.col("turn").alias("root"),
        F.lit(0).cast("long").alias("depth"),
    )
    return known.unionByName(alone).select(
        F.col("conv").alias("conv_id"),
        F.col("root").alias("root_turn"),
        "depth",
        "turn",
        "reply_to",
        "linked",
        F.size("quoted").alias("n_quoted"),
        "role",
        F.col("own").alias("text"),
        chat_turn(F.col("role"), F.col("own")).alias("chat"),
    )


def as_quoting_mail(
    messages: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    text: str = "text",
) -> DataFrame:
    """The same messages as mail: behind its own text each quotes the one before it in full.

    What that one quotes in turn, one message further back, is quoted at the second level.
    """

    def earlier(back: int) -> DataFrame:
        return messages.select(
            F.col(conv), (F.col(turn) + back).alias(turn), F.col(text).alias(f"__back_{back}")
        )

    def quoted(back: int) -> Column:
        return F.concat(
            F.lit("\n"),
            F.regexp_replace(F.col(f"__back_{back}"), r"(?md)^", "> " * back),
        )

    joined = messages.join(earlier(1), [conv, turn], "left").join(earlier(2), [conv, turn], "left")
    own = F.concat(
        F.col(text), F.coalesce(quoted(1), F.lit("")), F.coalesce(quoted(2), F.lit(""))
    )
    return joined.withColumn(text, own).select(*messages.columns)


# A message of the branching mail answers one of so many before it.
BRANCHES = 5


def as_branching_mail(
    messages: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    text: str = "text",
) -> DataFrame:
    """The same messages as mail in which each quotes one of the ``BRANCHES`` before it, by a hash.

    The message that is quoted stands at the first level, the one that it quotes itself at the
    second, both above the message's own text. For turns that are numbered from 0 on.
    """
    digest = F.md5(F.concat_ws(":", F.col(conv).cast("string"), F.col(turn).cast("string")))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    back = F.pmod(number, F.least(F.col(turn).cast("long"), F.lit(BRANCHES)))
    target = F.when(F.col(turn) > 0, F.col(turn) - 1 - back)
    own = messages.withColumn("__target", target)
    first = own.select(
        F.col(conv),
        F.col(turn).alias("__target"),
        F.col(text).alias("__first"),
        F.col("__target").alias("__second_target"),
    )
    second = messages.select(
        F.col(conv), F.col(turn).alias("__second_target"), F.col(text).alias("__second")
    )
    joined = own.join(first, [conv, "__target"], "left")
    joined = joined.join(second, [conv, "__second_target"], "left")

    def quoted(name: str, level: int) -> Column:
        lines = F.regexp_replace(F.col(name), r"(?md)^", "> " * level)
        return F.coalesce(F.concat(lines, F.lit("\n")), F.lit(""))

    # The nested quote comes first, as in mail that is answered below.
    whole = F.concat(quoted("__second", 2), quoted("__first", 1), F.col(text))
    return joined.withColumn(text, whole).select(*messages.columns)


# Where no message of the table quotes, each answers the one before it.
ORDER_SQL = """
SELECT conv_id, min(turn) OVER (PARTITION BY conv_id) AS root_turn,
       row_number() OVER places - 1 AS depth, turn, lag(turn) OVER places AS reply_to,
       false AS linked, 0::INTEGER AS n_quoted, role, coalesce(text, '') AS text,
       '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10)
         AS chat
FROM conversations
WINDOW places AS (PARTITION BY conv_id ORDER BY turn)
"""

# In the mail made of it, quotes say the same.
MAIL_SQL = """
SELECT conv_id, turn, min(turn) OVER (PARTITION BY conv_id) AS root_turn,
       row_number() OVER places - 1 AS depth, lag(turn) OVER places AS reply_to,
       lag(turn) OVER places IS NOT NULL AS linked, text
FROM conversations
WINDOW places AS (PARTITION BY conv_id ORDER BY turn)
"""

# In the branching mail a message answers the latest earlier one with the text that it quotes.
BRANCHES_SQL = f"""
WITH RECURSIVE aimed AS (
  SELECT *, CASE WHEN turn > 0 THEN turn - 1 -
      CAST('0x' || substr(md5(conv_id || ':' || turn), 1, 8) AS BIGINT) % least(turn, {BRANCHES}) END AS target
  FROM conversations),
replies AS (
  SELECT a.conv_id, a.turn, any_value(a.text) AS text, max(o.turn) AS reply_to
  FROM aimed a
  LEFT JOIN conversations t ON t.conv_id = a.conv_id AND t.turn = a.target
  LEFT JOIN conversations o ON o.conv_id = a.conv_id AND o.turn < a.turn AND o.text = t.text
  GROUP BY a.conv_id, a.turn),
ways AS (
  SELECT conv_id, turn, turn AS root_turn, CAST(0 AS BIGINT) AS depth FROM replies WHERE reply_to IS NULL
  UNION ALL
  SELECT r.conv_id, r.turn, w.root_turn, w.depth + 1
  FROM replies r JOIN ways w ON w.conv_id = r.conv_id AND w.turn = r.reply_to)
SELECT conv_id, turn, root_turn, depth, reply_to, reply_to IS NOT NULL AS linked, text
FROM replies JOIN ways USING (conv_id, turn)
"""
