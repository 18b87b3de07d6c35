import hashlib
import random

import pytest
from pyspark.sql import functions as F

from clicktide.llm import quotation

SCHEMA = "conv_id long, turn long, role string, text string"

THREAD = [
    (1, 0, "user", "First question.\nWith a second line."),
    (1, 1, "assistant", "An answer.\n\nOn Monday, someone wrote:\n> First question.\n> With a second line."),
    (1, 2, "user", "Another topic."),
    (1, 3, "user", "> An ANSWER.\n>> First   question.\nBack to the answer."),
    (1, 4, "assistant", "> First question. With a\n> second line.\nTo the first again."),
    (1, 5, "user", "> nobody said this\nStill here."),
    (1, 6, "user", "no quote at all"),
]


def ordered(frame):
    rows = frame.orderBy("conv_id", "root_turn", "depth", "turn").collect()
    return {row["turn"]: row for row in rows}


def test_replies_follow_the_quotes(spark):
    found = ordered(quotation.reply_order(spark.createDataFrame(THREAD, SCHEMA)))
    assert {turn: row["reply_to"] for turn, row in found.items()} == {
        0: None, 1: 0, 2: 1, 3: 1, 4: 0, 5: 4, 6: 5,
    }
    assert {turn: row["linked"] for turn, row in found.items()} == {
        0: False, 1: True, 2: False, 3: True, 4: True, 5: False, 6: False,
    }
    assert {turn: row["depth"] for turn, row in found.items()} == {
        0: 0, 1: 1, 2: 2, 3: 2, 4: 1, 5: 2, 6: 3,
    }
    assert [found[turn]["text"] for turn in (1, 3, 4, 5, 6)] == [
        "An answer.", "Back to the answer.", "To the first again.", "Still here.", "no quote at all",
    ]
    assert found[1]["chat"] == "<|assistant|>\nAn answer.\n"
    assert found[5]["n_quoted"] == 1


def test_parsing_levels():
    lines = quotation.split_levels("own\n> one\n>> two\n> > two more\n>>> three\n >one\na > b")
    assert [level for level, _ in lines] == [0, 1, 2, 2, 3, 1, 0]
    assert quotation.own_text("  untouched\n\n") == "  untouched\n\n"
    assert quotation.parse(None) == ("", [], [])


def plain(rows):
    """Links by trying every earlier message, the nearest first."""
    own = {turn: set(quotation.passages(quotation.own_text(text).split("\n"))) for _, turn, _, text in rows}
    found = {}
    for _, turn, _, text in rows:
        earlier = [other for other in sorted(own, reverse=True) if other < turn]
        votes = {}
        for quote in quotation.parse(text)[2]:
            at = next((other for other in earlier if quote["passage"] in own[other]), None)
            if at is not None:
                key = quote["level"], at
                votes[key] = votes.get(key, 0) + 1
        best = min(votes, key=lambda key: (key[0], -votes[key], -key[1]), default=None)
        found[turn] = best[1] if best else (earlier[0] if earlier else None)
    return found


@pytest.mark.parametrize("block", [3, 1_000])
def test_like_plain_links(spark, monkeypatch, block):
    monkeypatch.setattr(quotation, "BLOCK_TURNS", block)
    draw = random.Random(block)
    rows = []
    for turn in range(0, 80, 2):
        text = f"Message {turn}. Common phrase.\nLine {turn % 5}"
        for _ in range(draw.randint(0, 2)):
            if rows:
                level = draw.randint(1, 2)
                quoted = quotation.own_text(draw.choice(rows)[3]).split("\n")
                text += "".join(f"\n{'>' * level} {line}" for line in quoted)
        rows.append((7, turn, "user", text))
    found = ordered(quotation.reply_order(spark.createDataFrame(rows, SCHEMA)))
    assert {turn: row["reply_to"] for turn, row in found.items()} == plain(rows)
    depth = {}
    for turn, to in sorted(plain(rows).items()):
        depth[turn] = 0 if to is None else depth[to] + 1
    assert {turn: row["depth"] for turn, row in found.items()} == depth


def test_long_conversation(spark):
    rows = spark.range(3_000).select(
        F.lit(1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.lit("user").alias("role"),
        F.lit("the same words in all turns").alias("text"),
    )
    found = quotation.reply_order(rows)
    assert found.where("depth != turn or root_turn != 0").count() == 0 and found.count() == 3_000


def test_mail_is_put_back_in_order(spark):
    messages = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    mail = quotation.as_quoting_mail(messages)
    assert mail.where("text like '%\n> %'").count() > 0
    found = {(r["conv_id"], r["turn"]): r for r in quotation.reply_order(mail).collect()}
    for row in messages.collect():
        mine = found[row["conv_id"], row["turn"]]
        assert mine["text"] == row["text"]
        assert mine["reply_to"] == (row["turn"] - 1 if row["turn"] else None)
        assert mine["linked"] == bool(row["turn"])


def test_edge_rows(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, 1, None, ""), (None, 3, "user", "a")]
    rows += [(2, None, "user", "> b\nc"), (3, 5, "user", "x " * 200_000)]
    frame = spark.createDataFrame([(*row, 1) for row in rows], SCHEMA + ", depth int")
    found = quotation.reply_order(frame).collect()
    assert len(found) == len(rows)
    by = {(r["conv_id"], r["turn"]): (r["root_turn"], r["depth"], r["reply_to"]) for r in found}
    assert by == {
        (1, 0): (0, 0, None), (1, 1): (0, 1, 0), (None, 3): (3, 0, None),
        (2, None): (None, 0, None), (3, 5): (5, 0, None),
    }
    assert quotation.reply_order(frame.where("false")).collect() == []


def test_branching_mail_is_put_back(spark):
    """Replies are not to the message before, and differ from what a reader without quotes would say."""
    messages = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    mail = quotation.as_branching_mail(messages)
    assert mail.where("text like '> > %' and text like '%\n> %'").count() > 0
    found = {(r["conv_id"], r["turn"]): r for r in quotation.reply_order(mail).collect()}
    texts = {(r["conv_id"], r["turn"]): r["text"] for r in messages.collect()}
    other = 0
    for (conv, turn), row in found.items():
        assert row["text"] == texts[conv, turn] and row["linked"] == bool(turn)
        if turn:
            digest = hashlib.md5(f"{conv}:{turn}".encode()).hexdigest()
            target = turn - 1 - int(digest[:8], 16) % min(turn, quotation.BRANCHES)
            same = [t for (c, t), text in texts.items() if c == conv and t < turn and text == texts[conv, target]]
            assert row["reply_to"] == max(same)
            other += row["reply_to"] != turn - 1
    assert other > 0.3 * len(found)
