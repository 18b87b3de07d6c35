from collections import defaultdict

import pytest

from clicktide.llm import mixing


def poured(sizes):
    """Targets by sharing the excess again and again until no source is above its cap."""
    names = sorted((name for name in sizes if name is not None), key=lambda n: n.encode())
    names += [None] if None in sizes else []
    weight = {name: (1, 2, 3)[at % 3] for at, name in enumerate(names)}
    cap = {name: 3 * sizes[name] for name in names}
    target, full = dict.fromkeys(names, 0.0), set()
    left = float(sum(sizes.values()))
    while left > 1e-9 and len(full) < len(names):
        total = sum(weight[name] for name in names if name not in full)
        for name in names:
            if name not in full:
                target[name] += left * weight[name] / total
        left = 0.0
        for name in names:
            if target[name] > cap[name]:
                left += target[name] - cap[name]
                target[name] = float(cap[name])
                full.add(name)
    return target


CASES = [
    {"a": 100, "b": 100, "c": 100},
    {"a": 1, "b": 1000, "c": 2, "d": 5, None: 10},
    {"a": 1000, "b": 1, "c": 1, "d": 1, "e": 1, "f": 1},
    {"a": 0, "b": 7},
    {"a": 0, "b": 0},
    {"Z": 5, "a": 50, "é": 2, "b": 1},
]


@pytest.mark.parametrize("sizes", CASES)
def test_targets_like_pouring(spark, sizes):
    rows = [(name, size) for name, size in sizes.items()]
    frame = spark.createDataFrame(rows, "source string, size long")
    found = {
        row["source"]: row["target"]
        for row in mixing.source_targets(frame, "source", "size").collect()
    }
    expected = poured(sizes)
    assert found == {name: pytest.approx(value) for name, value in expected.items()}


def documents(spark, n=3_000):
    rows = [
        (at, "word " * (at % 7), "hot" if at % 3 == 0 else f"s{at % 11}", at * 10)
        for at in range(n)
    ]
    rows += [(None, "a b", None, 0), (5, None, "s1", 1), (5, None, "s1", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size long")


def test_taken_words_are_near_the_target(spark):
    docs = documents(spark)
    source_of = {row["doc_id"]: row["source"] for row in docs.collect()}
    rows = mixing.decide(docs).collect()
    assert len(rows) == docs.count()
    taken, target = defaultdict(int), {}
    for row in rows:
        assert row["taken"] <= 3 * row["size"]
        assert row["taken"] == row["copies"] * row["size"]
        taken[source_of[row["doc_id"]]] += row["taken"]
        target[source_of[row["doc_id"]]] = row["target"]
    assert sum(target.values()) == sum(row["size"] for row in rows)
    for source, words in taken.items():
        assert words == pytest.approx(target[source], rel=0.25, abs=30)


def test_reruns_and_both_joins_agree(spark, monkeypatch):
    docs = documents(spark)

    def rows(frame):
        return sorted(map(tuple, mixing.decide(frame).collect()), key=repr)

    first = rows(docs)
    assert rows(docs.repartition(7)) == first
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 0)
    assert rows(docs) == first


def test_copies_keep_their_columns(spark):
    docs = documents(spark, 300)
    mixed = mixing.mix(docs)
    assert mixed.dtypes == docs.dtypes
    count = defaultdict(int)
    for row in mixed.collect():
        count[tuple(row)] += 1
    decided = {row["doc_id"]: row["copies"] for row in mixing.decide(docs).collect()}
    for row in docs.where("doc_id != 5").collect():
        assert count[tuple(row)] == decided[row["doc_id"]]


def test_edge_tables(spark):
    docs = documents(spark, 10)
    assert mixing.decide(docs.where("false")).collect() == []
    assert mixing.mix(docs.where("false")).collect() == []
    only_nulls = spark.createDataFrame([(None, None, None)] * 3, "doc_id long, text string, source string")
    assert {row["taken"] for row in mixing.decide(only_nulls).collect()} == {0}
    long = spark.createDataFrame([(1, "w " * 500_000, "a")], "doc_id long, text string, source string")
    assert mixing.decide(long).first()["size"] == 500_000


def test_no_python_on_the_main_path(spark):
    plan = mixing.decide(documents(spark, 10))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
