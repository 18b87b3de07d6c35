import random

import numpy as np
import pytest
from brute import near_classes, shingles

from clicktide.llm import jaccard_join as join
from clicktide.llm.components import components
from clicktide.llm.words import Shingler


def words(draw, n):
    return [f"w{draw.randrange(3_000)}" for _ in range(n)]


def changed(draw, text, n):
    """The text with n words changed."""
    own = text.split()
    for _ in range(n):
        own[draw.randrange(len(own))] = f"x{draw.randrange(10**6)}"
    return " ".join(own)


def texts(seed=4):
    draw = random.Random(seed)
    found = [" ".join(words(draw, draw.randint(1, 120))) for _ in range(120)]
    base = " ".join(words(draw, 150))
    # A group of near copies, of which many pairs are close to the threshold.
    found += [changed(draw, base, draw.randint(0, 7)) for _ in range(160)]
    passage = " ".join(words(draw, 30))
    found += [passage + " " + " ".join(words(draw, draw.randint(20, 200))) for _ in range(150)]
    found += [base] * 60 + [found[3]] * 2 + ["few words only", "few words only", "few  words\nonly"]
    found += [None, None, "", "", " \n ", "one", "one two"]
    return found


def expected(rows):
    found = near_classes([text for _, text in rows])
    lowest = {}
    for (row, _), (root, _, _) in zip(rows, found):
        lowest[root] = min(lowest.get(root, row), row)
    return {row: (lowest[root], size, links) for (row, _), (root, size, links) in zip(rows, found)}


def got(frame):
    return {row["doc_id"]: (row["class_id"], row["class_size"], row["n_links"]) for row in frame.collect()}


def test_like_brute_force(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(a, t, "c") for a, t in rows], "doc_id long, text string, class_id string")
    assert got(join.near_classes(docs)) == expected(rows)


def test_split_nodes_and_blocks(spark, monkeypatch):
    """Small bounds, so that nodes are split again and again and groups take many blocks."""
    monkeypatch.setattr(join, "SMALL", 4)
    monkeypatch.setattr(join, "BLOCK_SETS", 16)
    rows = list(enumerate(texts(seed=5)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(join.near_classes(docs)) == expected(rows)


def test_whole_table_like_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert got(join.near_classes(docs)) == expected([tuple(row) for row in docs.collect()])


def test_one_of_each_class(spark):
    rows = [(at, text, at * 2) for at, text in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_size long")
    kept = join.keep_one(docs)
    assert kept.dtypes == docs.dtypes
    found = expected([row[:2] for row in rows])
    assert sorted(row["doc_id"] for row in kept.collect()) == sorted(
        at for at, (low, _, _) in found.items() if at == low
    )


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{at}" for at in range(40))
    near = text + " more"
    rows = [(1, text), (1, text), (1, near), (None, text), (None, near), (None, "other " + "y " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(map(tuple, join.near_classes(docs).collect()), key=repr)
    columns = join.near_classes(docs).columns
    named = [dict(zip(columns, row)) for row in found]
    copies = [row for row in named if row["class_size"] == 5]
    assert len(copies) == 5 and {row["class_id"] for row in copies} == {1}
    assert {row["n_links"] for row in copies} == {4}
    alone = [row for row in named if row["class_size"] == 1]
    assert [(row["class_id"], row["n_links"]) for row in alone] == [(None, 0)]
    kept = sorted(map(tuple, join.keep_one(docs).collect()), key=repr)
    assert len(kept) == 2 and kept[0][0] == 1 and kept[1] == rows[5]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert join.near_classes(docs).collect() == [] and join.keep_one(docs).collect() == []
    blank = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert got(join.near_classes(blank)) == {1: (1, 1, 0), 2: (2, 1, 0)}
    assert join.keep_one(blank).count() == 2


def test_shingles_like_brute_force():
    shingler = Shingler()
    for text in texts():
        assert len(shingler(text)) == len(shingles(text))
    long = " ".join(f"w{at}" for at in range(200_000))
    assert len(shingler(long)) == 199_996


def test_counts_of_common_shingles():
    random_sets = np.random.default_rng(3)
    sets = [np.unique(random_sets.integers(0, 900, 300).astype(np.uint64)) for _ in range(30)]
    counts = join.common_counts(sets, sets[:20])
    assert counts.tolist() == [[len(set(a) & set(b)) for b in sets[:20]] for a in sets]


def test_runs_rise_with_the_target():
    assert join.runs_needed(0.9) < join.runs_needed(0.99) < join.runs_needed(0.9999)


@pytest.mark.parametrize("seed", range(3))
def test_components_like_brute_force(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(180)]
    edges += [(1_000 + at, 1_001 + at) for at in range(60)]
    root = {}

    def find(at):
        while root.setdefault(at, at) != at:
            at = root[at]
        return at

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    frame = spark.createDataFrame(edges, "a long, b long")
    found = {row["node"]: row["root"] for row in components(frame).collect()}
    assert found == {at: find(at) for at in root if find(at) != at}
