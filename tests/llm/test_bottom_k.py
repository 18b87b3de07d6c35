import random

import numpy as np
import pytest

from clicktide.llm import bottom_k as bk
from clicktide.llm.skew import frequent_bound, join_counted


def plain_sets(texts):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    sets = []
    for text in texts:
        words = (text or "").encode().translate(lower).split()
        width = min(4, len(words))
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set())
    return sets


def expected(rows):
    """(doc_id, n_shingles, component_id, kept), by comparing all pairs."""
    sets = plain_sets([text for _, text in rows])
    root = list(range(len(rows)))

    def find(at):
        while root[at] != at:
            at = root[at]
        return at

    holders = {}
    for at, own in enumerate(sets):
        common = {}
        for shingle in own:
            for other in holders.setdefault(shingle, []):
                common[other] = common.get(other, 0) + 1
            holders[shingle].append(at)
        for other, n in common.items():
            if 100 * n >= 80 * (len(own) + len(sets[other]) - n):
                root[max(find(at), find(other))] = min(find(at), find(other))
    ids = {}
    for at, (doc_id, _) in enumerate(rows):
        ids.setdefault(find(at), []).append(doc_id)
    low = {at: min((i for i in own if i is not None), default=None) for at, own in ids.items()}
    return sorted(
        ((i, len(sets[at]), low[find(at)], i == low[find(at)]) for at, (i, _) in enumerate(rows)), key=repr
    )


def got(spark, rows):
    docs = spark.createDataFrame(
        [(*row, "s", 1) for row in rows], "doc_id long, text string, set_key string, size long"
    )
    return sorted((tuple(row) for row in bk.near_components(docs).collect()), key=repr)


def words(draw, n):
    return [f"W{draw.randrange(4_000)}" for _ in range(n)]


def changed(draw, own, n):
    own = list(own)
    for _ in range(n):
        own[draw.randrange(len(own))] = f"x{draw.randrange(10**6)}"
    return own


def texts(seed):
    draw = random.Random(seed)
    found = [words(draw, draw.randint(1, 260)) for _ in range(120)]
    base = words(draw, 200)
    # Near copies of one text, many of them close to the threshold to it and below it to each other.
    found += [changed(draw, base, draw.randint(0, 12)) for _ in range(140)]
    passage = words(draw, 120)
    # Documents that are mostly one passage.
    found += [passage + words(draw, draw.randint(10, 120)) for _ in range(120)]
    # A chain in which each text is linked with its neighbours only.
    chain = words(draw, 300)
    for at in range(40):
        found.append(list(chain))
        chain[at * 7 % 290 : at * 7 % 290 + 20] = words(draw, 20)
    found += [found[3], [w.lower() for w in found[3]], found[4] + ["é"], ["Ü"], ["ü"], ["one", "two"], ["TWO"]]
    rows = [" ".join(own) for own in found] + [None, None, "", " \n", "ONE two", "a  b\nc d", "A B C D"]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_like_comparing_all_pairs(spark, seed):
    rows = list(enumerate(texts(seed)))
    assert got(spark, rows) == expected(rows)


def test_small_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(bk, "BLOCK_SETS", 16)
    monkeypatch.setattr(bk, "CHUNK", 8)
    monkeypatch.setattr("clicktide.llm.skew.FEW_ROWS", 4)
    rows = [(7 * at % 1_000, text) for at, text in enumerate(texts(3))]
    assert got(spark, rows) == expected(rows)


def test_edge_rows(spark):
    text = " ".join(f"w{at}" for at in range(60))
    rows = [(1, text), (1, text), (1, text + " more"), (None, text), (None, None), (None, ""), (2, None)]
    rows += [(3, text.upper()), (4, "one"), (5, "ONE"), (None, "y " * 9), (None, "y " * 8)]
    rows += [(6, " ".join(f"v{at}" for at in range(120_000)))]
    found = got(spark, rows)
    plain = [row for row in expected(rows) if row[0] is not None or row[2] is not None]
    assert [row for row in found if row[0] is not None or row[2] is not None] == plain
    # Groups without an id: null is the id of all their rows.
    assert sorted(row[1:] for row in found if row[0] is None and row[2] is None) == [
        (0, None, True), (0, None, True), (1, None, True), (1, None, True)
    ]


def test_empty_tables(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None), (2, " ")]) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_whole_table_like_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(row["doc_id"], row["text"]) for row in docs.collect()]
    assert sorted((tuple(r) for r in bk.near_components(docs).collect()), key=repr) == expected(rows)


def test_estimates_leave_links_possible():
    draw = np.random.default_rng(1)
    for n in (20, 90, 140, 400, 3_000):
        for _ in range(60):
            union = draw.integers(0, 1 << 63, n, dtype=np.uint64)
            cut = int(n * draw.uniform(0.55, 1.0))
            rest = draw.random(n - cut) < 0.5
            a = np.unique(np.concatenate([union[:cut], union[cut:][rest]]))
            b = np.unique(np.concatenate([union[:cut], union[cut:][~rest]]))
            packed = [(x[: bk.SKETCH] >> np.uint64(32)).astype(np.uint32).tobytes() for x in (a, b)]
            sketches = bk.Sketches(np.array([len(a), len(b)]), packed)
            near = sketches.similar(0, np.array([False, True])).tolist() == [1]
            common = len(np.intersect1d(a, b))
            if bk.linked(np.array([common]), np.array([len(a)]), np.array([len(b)]))[0]:
                assert near
            elif common < 0.5 * len(np.union1d(a, b)):
                assert not near


def test_listed_values_suffice():
    assert bk.recall_of_lists() > 1 - 2e-6
    assert bk.listed_of(1) == (1, 1) and bk.listed_of(10) == (10, 3) and bk.listed_of(500) == (32, 19)


def test_joins_of_frequent_keys(spark):
    rows = spark.createDataFrame([(k, v) for v in range(900) for k in {0, v % 7 * 100 + v // 9}], "k long, v long")
    once = rows.groupBy("k").count().selectExpr("k", "count as n", "k * 2 as twice")
    assert frequent_bound(10) == 64 and frequent_bound(10**9) == 20_000
    found = join_counted(rows, once.where("k % 2 = 0"), "k", rows.count())
    assert sorted(map(tuple, found.collect())) == sorted(
        map(tuple, rows.join(once.where("k % 2 = 0"), "k").select(*found.columns).collect())
    )
