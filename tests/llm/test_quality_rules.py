import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clicktide.llm import quality_rules as rules

SYMBOLS = set("#*$%&|<>")


def brute(text):
    """The measures, written out plainly."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[at : at + 3]) for at in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {at + k for at, window in enumerate(windows) if counts[window] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (
        len(words),
        sum(map(len, words)),
        sum(character in SYMBOLS for character in text),
        sum(line in lines[:at] for at, line in enumerate(lines)),
        len(covered),
    )


def measures(text):
    m = rules.Measured(text)
    return m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words


def made_up(seed):
    draw = random.Random(seed)
    pieces = ["a", "bc", "é", "漢", "\n", " ", "\t", "\x0b", "\x0c", "\r", "\x1c", "\xa0", "#", "|", "<x>"]
    return "".join(draw.choice(pieces) for _ in range(draw.randint(0, 80)))


@pytest.mark.parametrize("seed", range(300))
def test_measures_like_brute_force(seed):
    text = made_up(seed)
    assert measures(text) == brute(text)


def test_edge_texts():
    assert measures(None) == measures("") == (0, 0, 0, 0, 0)
    assert measures("a b c a b c")[4] == 6
    assert measures("a b c d b c d")[4] == 6
    assert measures("same\nsame\n \nsame")[3] == 2
    long = "word " * 400_000
    assert measures(long) == (400_000, 1_600_000, 0, 0, 400_000)


CLEAN = " ".join(f"word{at}" for at in range(60))


def test_rules_reject_junk_and_keep_clean():
    order = list(rules.RULES)
    broken = {
        "few_words": "only five words are here",
        "repeated_words": "again and " * 60,
        "symbols": " ".join(f"word{at}$$$" for at in range(60)),
        "duplicate_lines": "\n".join(["same line here", *["a b c d"] * 20]) + CLEAN,
        "upper_case": CLEAN.upper(),
        "shouts": " ".join(f"word{at}!!" for at in range(60)),
        "word_length": " ".join("x" * 30 + str(at) for at in range(60)),
    }
    assert rules.first_broken(rules.Measured(CLEAN), order) is None
    for name, text in broken.items():
        assert rules.RULES[name](rules.Measured(text)), name
        assert rules.first_broken(rules.Measured(text), order)


def test_order_by_rejections_per_cost(spark):
    docs = spark.createDataFrame(
        [(at, "too few words") for at in range(40)] + [(99, CLEAN)], "doc_id long, text string"
    )
    found = {row["rule"]: row for row in rules.estimate(docs, sample=10_000).collect()}
    assert set(found) == set(rules.RULES)
    assert found["few_words"]["seen"] == 41 and found["few_words"]["rejected"] == 40
    assert found["symbols"]["rejected"] == 0
    order = rules.cascade_order(docs)
    rejecting = [name for name in rules.RULES if found[name]["rejected"]]
    assert set(order[: len(rejecting)]) == set(rejecting)


ROWS = [
    (1, CLEAN, "x", "mine"),
    (1, CLEAN, "x", "mine"),
    (2, None, None, None),
    (3, "", "y", "m"),
    (None, CLEAN, "z", "n"),
    (4, "again and " * 60, "x", "o"),
]
SCHEMA = "doc_id long, text string, kept string, n_words string"


def test_any_order_gives_the_same_verdicts(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for order in (None, list(rules.RULES), list(rules.RULES)[::-1]):
        found = rules.judge(docs, order=order)
        kept = Counter((row["doc_id"], row["kept"], row["base_failed"]) for row in found.collect())
        assert kept == Counter(
            {(1, True, False): 2, (2, False, True): 1, (3, False, True): 1, (None, True, False): 1}
            | {(4, False, True): 1}
        )


def test_keeping_rows_with_clashing_names(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    kept = rules.keep_good(docs)
    assert kept.schema == docs.schema
    assert Counter(map(tuple, kept.collect())) == Counter({ROWS[0]: 2, ROWS[4]: 1})
    assert rules.keep_good(docs.where("false")).collect() == []
    assert rules.judge(docs.where("false")).collect() == []


def test_whole_table_like_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {row["doc_id"]: row for row in rules.judge(docs).collect()}
    assert len(found) == docs.count()
    for row in docs.select("doc_id", "text").collect():
        mine = found[row["doc_id"]]
        n, _, _, _, repeated = brute(row["text"])
        assert tuple(mine)[1:6] == brute(row["text"])
        assert mine["base_failed"] == (n < 50 or 100 * repeated > 50 * n)
        assert not (mine["base_failed"] and mine["kept"])


def test_clean_documents_stay(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    judged = rules.judge(docs).join(labels, "doc_id").where("n_words >= 50")
    counts = {
        row["quality"]: row["share"]
        for row in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()
    }
    assert counts[1] > 0.99 and counts[0] < 0.05
