import hashlib
import random
import zlib

import numpy as np
import pytest

from clicktide.llm import queries, runs


def plain_runs(words):
    """All runs (start, length, period), by comparing the words at every distance."""
    found, n = {}, len(words)
    for period in range(1, n // 4 + 1):
        start = 0
        while start + period < n:
            end = start
            while end + period < n and words[end] == words[end + period]:
                end += 1
            if end > start and end + period - start >= max(6, 4 * period):
                found.setdefault((start, end + period - start), period)
            start = end + 1
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_digests(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = sorted(found, key=lambda r: (-r[1], r[0], r[2]))[:1]
    row = (*best[0], best[0][1] * 1000 // best[0][2]) if best else (None,) * 4
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = b" ".join(word for i, word in enumerate(words) if i not in dropped)
    return (doc_id, len(found), *row, *(hashlib.sha256(x).hexdigest() for x in (listed.encode(), kept)))


def sequence(draw):
    """Words with repetitions inside repetitions."""
    size = draw.choice([1, 2, 2, 3, 8, 50])
    words = [draw.randrange(size) for _ in range(draw.randint(0, 40))]
    for _ in range(draw.randint(0, 4)):
        if not words:
            break
        at = draw.randrange(len(words))
        part = words[at : at + draw.randint(1, 30)]
        words[at:at] = part * draw.randint(1, 7) + part[: draw.randrange(len(part))]
        if draw.random() < 0.4:
            words[draw.randrange(len(words))] = draw.randrange(size + 1)
        words = words[:900]
    return [b"w%d" % word for word in words]


@pytest.mark.parametrize("seed", range(8))
def test_like_comparing_all_distances(seed, monkeypatch):
    draw = random.Random(seed)
    monkeypatch.setattr(runs, "WORDS_AT_ONCE", draw.choice([1, 300, 5_000]))
    texts = [sequence(draw) for _ in range(150)]
    assert runs.runs_of(texts) == [plain_runs(words) for words in texts]


def test_strings_with_many_repetitions():
    fibonacci, thue = ["a", "ab"], "a"
    for _ in range(13):
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
        thue = thue[: 1 << 11] + thue[: 1 << 11].translate(str.maketrans("ab", "ba"))
    texts = [list(t.encode()) for t in (fibonacci[-1][:1500], thue[:1500], "ab" * 400 + "a" * 300)]
    texts = [[bytes([c]) for c in text] for text in texts]
    assert runs.runs_of(texts) == [plain_runs(words) for words in texts]


def test_runs_touch_and_overlap():
    text = ("a b " * 5 + "a b c " * 5 + "c c c c c c c").encode().split()
    assert runs.runs_of([text]) == [plain_runs(text)]
    assert len(plain_runs(text)) == 3


def test_lengths_at_the_bound():
    for period in (1, 2, 3, 4, 5, 7, 8, 9, 16, 31, 33):
        for length in (4 * period - 1, 4 * period, max(6, 4 * period)):
            words = [b"x"] + [b"p%d" % (i % period) for i in range(length)] + [b"y"]
            assert runs.runs_of([words]) == [plain_runs(words)]


def test_a_long_text():
    draw = random.Random(1)
    words = [b"%d" % draw.randrange(10**6) for _ in range(150_000)]
    words[20_000:20_000] = words[:30_000] * 4
    found = runs.runs_of([words, [b"z"] * 100_000])
    assert found[1] == [(0, 100_000, 1)]
    # The copies stand before word 20,000 of the first 30,000, so the repetition begins there.
    assert [(length >= 120_000, period) for _, length, period in found[0]] == [(True, 30_000)]


def test_scales_leave_out_periodic_windows():
    words = np.array([0, 1] * 50 + list(range(2, 40)))
    left_out = runs.inside([(0, 100, 2)], 8, len(words))
    assert left_out[:93].all() and not left_out[93:].any()
    assert not runs.inside([(0, 100, 2)], 4, len(words)).any()


def test_least_ahead():
    values = np.random.default_rng(2).integers(0, 1 << 60, 500).astype(np.uint64)
    for width in (1, 2, 5, 33, 500):
        expected = [values[at : at + width].min() for at in range(500 - width + 1)]
        assert runs.least_ahead(values, width).tolist() == expected


EDGE = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a a a a a"), (6, "a a a a a a"),
    (6, "a a a a a a"), (None, "a a a a a a b"), (7, "a b " * 9), (-8, "x y\n" * 700),
    (9, "ü é " * 5 + " " + " w" * 40), (None, None),
]


def test_edge_rows(spark):
    rows = EDGE + [(n, "p q r s " * 3 + "t u v w x y z " * n) for n in range(10, 60)]
    schema = "doc_id long, text string, runs string, id string"
    docs = spark.createDataFrame([(*row, "r", "i") for row in rows], schema)
    found = sorted(map(tuple, runs.run_digests(docs).collect()), key=repr)
    assert found == sorted((plain_digests(*row) for row in rows), key=repr)
    listed = {(row["doc_id"], tuple(map(tuple, row["runs"]))) for row in runs.find_runs(docs).collect()}
    assert listed == {(i, tuple(plain_runs((t or "").encode().split()))) for i, t in rows}
    collapsed = runs.collapse(docs)
    assert collapsed.dtypes == docs.dtypes
    texts = [row["text"] for row in collapsed.where("doc_id in (1, 2, 3, 5, 6, -8)").collect()]
    assert sorted(texts, key=repr) == sorted([None, "", " \n\t ", "a a a a a", "a", "a", "x y"], key=repr)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert runs.run_digests(docs).collect() == [] and runs.collapse(docs).collect() == []


def test_whole_table_like_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    found = [tuple(row) for row in queries.all_queries()["op11_periodic_runs"](spark, folder).collect()]
    assert sorted(found) == sorted(plain_digests(*row) for row in rows)
    assert any(row[1] for row in found) and len(found) == len(rows)
