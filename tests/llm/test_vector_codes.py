import hashlib
import math

import numpy as np
import pytest

from clicktide.llm import vector_codes as vc


def plain_codes(rows):
    """(vec_id, code, error, label_error, digest) of (vec_id, vector, label), all in Python numbers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    numbers = [[math.floor(4096 * x) for x in vector] for _, vector, _ in kept]
    if not kept:
        return []
    size = len(numbers[0])
    cuts = [p * size // 8 for p in range(9)]
    parts = [[v[a:b] for v in numbers] for a, b in zip(cuts, cuts[1:])]
    books = [part[:16] for part in parts]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, entry)), at) for at, entry in enumerate(book))

    for _ in range(6):
        for p, part in enumerate(parts):
            found = [nearest(books[p], x)[1] for x in part]
            new = []
            for e, entry in enumerate(books[p]):
                own = [x for x, at in zip(part, found) if at == e]
                new.append([sum(c) // len(own) for c in zip(*own)] if own else entry)
            books[p] = new
    last = [[nearest(book, x) for x in part] for book, part in zip(books, parts)]
    errors = [sum(part[at][0] for part in last) for at in range(len(kept))]
    sums = {}
    for (_, _, label), error in zip(kept, errors):
        sums[label] = sums.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return [
        (vec_id, "".join(f"{part[at][1]:02x}" for part in last), errors[at], sums[label], digest)
        for at, (vec_id, _, label) in enumerate(kept)
    ]


def frame(spark, rows):
    return spark.createDataFrame(
        [(*r, "c", 7) for r in rows],
        "vec_id long, embedding array<double>, label string, code string, error long",
    )


def same(spark, rows):
    found = [tuple(r) for r in vc.code_digests(frame(spark, rows)).collect()]
    assert sorted(found, key=repr) == sorted(plain_codes(rows), key=repr)
    return found


@pytest.mark.parametrize("seed, scale", [(1, 1.0), (2, 0.001), (3, 60.0)])
def test_like_plain_rounds(spark, seed, scale):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(12, 16))
    vectors = (middle[draw.integers(0, 12, 300)] + 0.3 * draw.normal(size=(300, 16))) * scale
    rows = [(int(i), v.tolist(), "abc"[i % 3]) for i, v in zip(draw.permutation(300), vectors)]
    same(spark, rows)


def test_ties_and_repeated_rows(spark):
    draw = np.random.default_rng(4)
    rows = [(i // 2, draw.integers(-1, 2, 8).astype(float).tolist(), None if i % 3 else "x") for i in range(200)]
    same(spark, rows + rows[:40])


def test_edge_rows(spark):
    good = [0.5, -0.25, 1.0, 0.0, -1.0, 2.0, 3.0, -4.0, 1 / 3]
    rows = [(1, good, "a"), (2, None, "a"), (3, [None] + good[1:], "a"), (4, [math.nan] * 9, None)]
    rows += [(5, [math.inf] + good[1:], "b"), (None, good[::-1], None), (6, good, None), (1, good, "a")]
    assert len(same(spark, rows)) == 4
    others = rows + [(9, [1.0, 2.0], "a"), (10, [], "z")]
    found = {tuple(r) for r in vc.code_digests(frame(spark, others)).collect()}
    digest = plain_codes(rows)[0][-1]
    errors = {r[3] for r in plain_codes(rows) if r[0] == 1}
    assert found >= {(9, None, None, *errors, digest), (10, None, None, None, digest)}
    assert len(found) == len(set(plain_codes(rows))) + 2


def test_empty_tables(spark):
    for rows in ([], [(1, None, "a")]):
        found = vc.code_digests(frame(spark, rows))
        assert found.collect() == [] and found.columns[-1] == "codebooks_sha256"


def test_huge_components_are_held_at_the_limit(spark):
    rows = [(i, [1e30 * (-1) ** i] * 8 + [float(i)] * 8, "a") for i in range(40)]
    found = vc.code_digests(frame(spark, rows)).collect()
    assert len(found) == 40 and all(0 <= r["error"] < 1 << 62 for r in found)
    assert vc.limit_of(64) == 1 << 27


def test_bounds_hold_through_rounds():
    """After any moves, lower bounds are never above the true distances, and entries are nearest."""
    draw = np.random.default_rng(5)
    values = draw.integers(-3000, 3000, (400, 8))
    entries = draw.integers(-3000, 3000, (16, 8))
    bounds, _ = vc.Bounds.fresh(values, entries, 4)
    spared = 0
    for step in range(12):
        moved = entries + draw.integers(-400, 400, entries.shape) // (step + 1)
        ways = vc.root(((moved - entries) ** 2).sum(axis=1)) + 1
        entries, listed = moved, 4 - step // 5
        before = vc.Bounds.unpacked(bounds.packed(), bounds.next.shape[1]).shorter(listed)
        bounds, apart = before.moved(ways).assigned(values, entries)
        true = vc.distances(values, entries)
        assert (bounds.own == true.argmin(axis=1)).all() and (apart == true.min(axis=1)).all()
        squares = bounds.low**2
        assert (squares[:, :-1] <= np.take_along_axis(true, bounds.next, axis=1)).all()
        rest = np.ones(true.shape, dtype=bool)
        np.put_along_axis(rest, bounds.own[:, None], False, axis=1)
        np.put_along_axis(rest, bounds.next, False, axis=1)
        assert (squares[:, -1] <= np.where(rest, true, 1 << 60).min(axis=1)).all()
        spared += (bounds.looked <= listed).sum()
    assert spared > 0


def test_lists_adapt():
    assert vc.adapted([100, 0, 0, 0, 0, 0], 16) == 2
    assert vc.adapted([50, 20, 10, 15, 0, 1], 16) == 3
    assert vc.adapted([0, 0, 0, 0, 50, 50], 16) == 4
    assert vc.adapted([5, 0], 1) == 0


def test_decompressed_vectors_are_near(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    coded, books = vc.compress(vectors)
    back = vc.decompress(coded, books).join(vectors.select("vec_id", "embedding"), "vec_id").collect()
    assert len(back) == vectors.count()
    for row in back:
        apart = np.floor(np.array(row["embedding"]) * 4096) - np.array(row["vector"]) * 4096
        assert int((apart**2).sum()) == row["error"]


def test_many_labels_are_salted(spark, monkeypatch):
    draw = np.random.default_rng(6)
    rows = [(i, draw.normal(size=8).tolist(), None if i < 30 else f"l{i % 9}") for i in range(120)]
    monkeypatch.setattr(vc, "MAX_BROADCAST_LABELS", 3)
    same(spark, rows)
