import numpy as np
import pytest

from clicktide.llm import hash_forest as forest


def brute(rows, k=20, every=20):
    """Per query the nearest others; rows with the same id and vector count once."""
    valid = {}
    for row, vector in rows:
        if row is None or not vector or None in vector:
            continue
        if np.isfinite(vector).all() and np.any(vector):
            valid[row, tuple(vector)] = np.array(vector, dtype=float)
    found = {}
    for (row, own), vector in valid.items():
        if row % every == 0:
            scored = [
                (-float(vector @ other), other_row)
                for (other_row, _), other in valid.items()
                if other_row != row and len(other) == len(vector)
            ]
            found[row] = [(other, -score) for score, other in sorted(scored)[:k]]
    return found


def searched(frame, **more):
    found = {}
    for row in forest.search(frame, **more).orderBy("query_id", "rank").collect():
        found.setdefault(row["query_id"], []).append((row["vec_id"], row["score"]))
        assert row["rank"] == len(found[row["query_id"]])
    return found


def recall(found, expected):
    hits = [len({v for v, _ in found[q]} & {v for v, _ in own}) for q, own in expected.items()]
    return sum(hits) / sum(len(own) for own in expected.values())


def test_recall_against_brute_force(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(row["vec_id"], row["embedding"]) for row in frame.collect()]
    found, expected = searched(frame), brute(rows)
    assert set(found) == set(expected)
    assert all(len(found[query]) == len(own) for query, own in expected.items())
    assert recall(found, expected) >= 0.9


def test_lengths_count(spark):
    """The inner product of unequal lengths, which an index of directions alone would miss."""
    random = np.random.default_rng(5)
    vectors = random.normal(size=(600, 12)) * random.exponential(size=(600, 1))
    rows = [(at, vector.tolist()) for at, vector in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found, expected = searched(frame), brute(rows)
    assert recall(found, expected) >= 0.9
    scores = {(q, v): s for q, own in found.items() for v, s in own}
    for (query, other), score in scores.items():
        assert score == pytest.approx(float(vectors[query] @ vectors[other]), rel=1e-12, abs=1e-12)


def test_clusters_need_few_candidates(spark):
    random = np.random.default_rng(6)
    centres = random.normal(size=(40, 16))
    vectors = centres[random.integers(0, 40, 2_000)] + 0.05 * random.normal(size=(2_000, 16))
    rows = [(at, vector.tolist()) for at, vector in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert recall(searched(frame), brute(rows)) >= 0.9


def test_small_blocks_give_the_same(spark, monkeypatch):
    random = np.random.default_rng(7)
    rows = [(at, vector.tolist()) for at, vector in enumerate(random.normal(size=(400, 8)))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    first = searched(frame)
    monkeypatch.setattr(forest, "BLOCK", 16)
    again = searched(frame)
    assert {q: [v for v, _ in own] for q, own in first.items()} == {
        q: [v for v, _ in own] for q, own in again.items()
    }


def test_edge_vectors(spark):
    same = [1.0, 2.0, 0.5]
    rows = [(at, same) for at in range(100)]
    rows += [(200, [0.5, 0.0, 1.0]), (201, [-1.0, 0.0, 0.0]), (200, [0.5, 0.0, 1.0])]
    rows += [(300, None), (320, []), (340, [0.0, 0.0, 0.0]), (360, [None, 1.0, 1.0])]
    rows += [(380, [float("nan"), 1.0, 1.0]), (400, [float("inf"), 1.0, 1.0]), (None, same)]
    rows += [(420, [1.0, 1.0]), (421, [2.0, 1.0])]
    frame = spark.createDataFrame(
        [(*row, 1.0) for row in rows], "vec_id long, embedding array<double>, score double"
    )
    found, expected = searched(frame), brute(rows)
    assert set(found) == set(expected) == {0, 20, 40, 60, 80, 200, 420}
    for query, own in expected.items():
        assert [v for v, _ in found[query]] == [v for v, _ in own]
        assert [s for _, s in found[query]] == pytest.approx([s for _, s in own])


def test_tables_with_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert forest.search(spark.createDataFrame([], schema)).collect() == []
    assert forest.search(spark.createDataFrame([(0, [1.0])], schema)).collect() == []
    two = spark.createDataFrame([(0, [1.0, 0.0]), (3, [0.5, 0.5])], schema)
    assert list(map(tuple, forest.search(two).collect())) == [(0, 1, 3, 0.5)]
    none = spark.createDataFrame([(1, [1.0, 0.0]), (3, [0.5, 0.5])], schema)
    assert forest.search(none).collect() == []


def test_shared_bits():
    a, b = np.array([0b1011 << 28, 5, 7]), np.array([0b1010 << 28, 5, 6])
    assert forest.shared_bits(a, b).tolist() == [3, 32, 31]


def isolated_and_rare(random):
    """Tight clusters, some vectors far from all, and a few of another dimension."""
    centres = random.normal(size=(20, 16))
    vectors = centres[random.integers(0, 20, 3_000)] + 0.01 * random.normal(size=(3_000, 16))
    alone = np.arange(0, 3_000, 1_000)
    vectors[alone] = -centres.mean(axis=0) + 0.1 * random.normal(size=(len(alone), 16))
    rows = [(at, vector.tolist()) for at, vector in enumerate(vectors)]
    rare = 0.1 ** np.arange(30)[:, None] * random.normal(size=(30, 5))
    rows += [(4_000 + 4 * at, vector.tolist()) for at, vector in enumerate(rare)]
    return rows + [(5_000 + 20 * at, [float(at), 1.0, 1.0]) for at in range(8)]


@pytest.mark.parametrize("floor", [None, 8])
def test_isolated_vectors_and_rare_dimensions_get_all_rows(spark, monkeypatch, floor):
    rows = isolated_and_rare(np.random.default_rng(8))
    if floor:
        # As if the tuning queries had met none of them.
        monkeypatch.setattr(forest, "_choose", lambda *_: (floor, 1))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found, expected = searched(frame), brute(rows)
    assert {q: len(own) for q, own in found.items()} == {q: len(own) for q, own in expected.items()}
    for query in range(5_000, 5_160, 20):
        assert [v for v, _ in found[query]] == [v for v, _ in expected[query]]
    if not floor:
        assert recall(found, expected) >= 0.9


def test_other_ids_of_a_short_query_vector(spark, monkeypatch):
    """A short vector's point lies apart from its query, so no tree need find it."""
    monkeypatch.setattr(forest, "_choose", lambda *_: (8, 1))
    random = np.random.default_rng(9)
    rows = [(at, vector.tolist()) for at, vector in enumerate(random.normal(size=(500, 8)))]
    short = [0.5, *[0.0] * 7]
    rows = [(at, v) for at, v in rows if at % 20] + [(at, short) for at in range(1_000, 1_021)]
    rows += [(at + 2_000, (-np.abs(random.normal(size=8))).tolist()) for at in range(1, 20)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = searched(frame)
    assert all(len(own) == 20 for own in found.values())
    scores = [s for _, s in found[1_000]]
    # Whatever else is found, nothing below the score of the vector's other ids is.
    assert min(scores) >= 0.25


def test_a_query_sees_few_vectors_of_clusters(spark):
    """The plan that is chosen for clustered vectors compares a query with less than a fifth."""
    random = np.random.default_rng(11)
    centres = random.normal(size=(60, 16))
    vectors = centres[random.integers(0, 60, 3_000)] + 0.05 * random.normal(size=(3_000, 16))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    rows = [(at, vector.tolist()) for at, vector in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    distinct = forest._distinct_vectors(forest._valid(frame), 21, 20)
    plan = forest._tune(distinct, 20, forest.TARGET).of(16)
    queries = forest.codes(vectors[::20], plan.longest, True, plan.trees)
    points = forest.codes(vectors, plan.longest, False, plan.trees)
    rest = forest.BITS - plan.floor
    same = (queries[:, None, :] >> rest) == (points[None, :, :] >> rest)
    assert same.any(axis=2).mean() < 0.2, plan


def test_recall_of_all_queries(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(row["vec_id"], row["embedding"]) for row in frame.collect()]
    found, expected = searched(frame), brute(rows)
    assert {q: len(own) for q, own in found.items()} == {q: len(own) for q, own in expected.items()}
    assert recall(found, expected) >= 0.95


def test_precision_of_numbers(spark):
    """Numbers in single precision are kept as such, and scored in double precision."""
    random = np.random.default_rng(12)
    rows = [(at, vector.tolist()) for at, vector in enumerate(random.normal(size=(60, 8)).astype(np.float32))]
    for kind in ("float", "double"):
        frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
        found, expected = searched(frame), brute(rows)
        for query, own in expected.items():
            assert [s for _, s in found[query]] == pytest.approx([s for _, s in own][: len(found[query])], rel=1e-14)
