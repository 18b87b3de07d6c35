from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from clicktide.llm import language_crf as crf

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return crf.train(spark.read.parquet(f"{FOLDER}/documents.parquet"))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = (
        crf.identify(docs, model)
        .join(docs.select("doc_id", "lang"), "doc_id")
        .where(crf.held_out("doc_id"))
        .collect()
    )
    right = sum(row["lang"] == row["lang_pred"] for row in rows)
    assert len(rows) > 200 and right / len(rows) > 0.97
    assert all(0 <= row["score"] <= 1 for row in rows)


def test_held_out_rows_are_never_learned(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(300)
    turned = docs.withColumn(
        "lang", crf.F.when(crf.held_out("doc_id"), crf.F.lit("xx")).otherwise(crf.F.col("lang"))
    )
    first, second = crf.train(docs, rows=60), crf.train(turned, rows=60)
    assert first.languages == second.languages
    assert (first.weights == second.weights).all()
    assert (first.transitions == second.transitions).all()


def test_labels_of_words_in_a_mixed_text(spark, model):
    text = "Nicht die und der mit. Le les dans pour que. The and of that with"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    found = {row["doc_id"]: row["languages"] for row in crf.label_words(docs, model).collect()}
    assert found == {1: ["de"] * 5 + ["fr"] * 5 + ["en"] * 5, 2: []}


def test_forward_backward_like_all_paths():
    random = np.random.default_rng(4)
    lengths = np.array([3, 1, 4])
    scores, transitions = random.normal(size=(8, 3)), random.normal(size=(3, 3))
    found, expected = crf.forward_backward(scores, transitions, crf.Chains(lengths))
    sums, pairs, start = np.zeros((8, 3)), np.zeros((3, 3)), 0
    for length in lengths:
        total, own, own_pairs = 0.0, np.zeros((length, 3)), np.zeros((3, 3))
        for path in product(range(3), repeat=int(length)):
            weight = np.exp(
                sum(scores[start + at, label] for at, label in enumerate(path))
                + sum(transitions[a, b] for a, b in zip(path, path[1:]))
            )
            total += weight
            for at, label in enumerate(path):
                own[at, label] += weight
            for a, b in zip(path, path[1:]):
                own_pairs[a, b] += weight
        sums[start : start + length] = own / total
        pairs += own_pairs / total
        start += length
    assert found == pytest.approx(sums) and expected == pytest.approx(pairs)


def test_features_like_plain_ones():
    words = ["", "a", "été", "language", "漢字"]
    buckets, owners = crf.features_of(words, {"été": 10**6})
    counts = np.bincount(owners, minlength=len(words)).tolist()

    def number(word):
        affixes = 2 * min(crf.AFFIX, len(word))
        return affixes + sum(max(0, len(word) - n + 1) for n in crf.NGRAMS) + (word == "été")

    assert counts == [number(word) for word in words]
    assert 10**6 in buckets


def test_edge_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "12 345 !!"), (4, "the"), (4, "the"), (None, "und der die")]
    docs = spark.createDataFrame([(*row, "x") for row in rows], "doc_id long, text string, score string")
    found = sorted(map(tuple, crf.identify(docs, model).collect()), key=repr)
    assert [row[:2] for row in found] == [
        (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "de"),
    ]
    assert found[3] == found[4]
    assert crf.identify(docs.where("false"), model).collect() == []
    nothing = crf.fit([])
    assert {row["lang_pred"] for row in crf.identify(docs, nothing).collect()} == {"und"}
    assert crf.train(docs.selectExpr("doc_id", "text", "cast(null AS string) AS lang")).languages == []


def test_long_text(model):
    found = crf.Labeller(model).text_languages(["the and of that with " * 40_000, "und der die"])
    assert [language for language, _ in found] == ["en", "de"]


def test_rare_languages_and_those_of_long_documents_are_learned(spark):
    rows = [(at, f"the house and garden number {at}", "en") for at in range(2_000)]
    rows += [(at, f"das haus und der garten nummer {at}", "de") for at in range(2_000, 2_006)]
    long = "\n".join(f"la maison et le jardin {at}" for at in range(2_000))
    rows += [(at, long, "fr") for at in range(3_000, 3_006)]
    rows += [(at, "casa giardino " * 2_000, "it") for at in range(4_000, 4_006)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = crf.train(docs, rows=60)
    assert learned.languages == ["de", "en", "fr", "it"]
    found = {r["doc_id"]: r["lang_pred"] for r in crf.identify(docs, learned).collect()}
    assert sum(found[row] == language for row, _, language in rows) > 0.97 * len(rows)
    assert all(found[row] == language for row, _, language in rows if row >= 2_000)


def test_two_hundred_languages_take_bounded_memory():
    """The model and the scores that a task keeps, with as many languages as are learned."""
    draw = np.random.default_rng(8)
    languages = [f"l{at:03d}" for at in range(crf.LANGUAGES)]
    weights = draw.normal(size=(1 << crf.BUCKET_BITS, len(languages))).astype(np.float32)
    model = crf.Crf(languages, {}, weights, np.zeros((len(languages),) * 2))
    labeller = crf.Labeller(model)
    for part in range(12):
        words = " ".join(f"word{part}x{at}" for at in range(10_000))
        assert labeller.text_languages([words])[0][0] in languages
        assert labeller._scores.nbytes <= 4 * (crf.KNOWN_SCORES + 10_000 * len(languages))
    assert weights.nbytes + labeller._scores.nbytes < 200_000_000


def test_some_of_every_language_are_learned_from(spark):
    """A frequent language doesn't crowd out rare ones, and ids that repeat count once."""
    rows = [(at, f"die der das {at}", "de", at % 3) for at in range(3_000)]
    rows += [(10_000 + at // 2, f"the of and {at // 2}", "en", 0) for at in range(80)]
    rows += [(20_000 + at, f"le la les {at}", "fr", 0) for at in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, part int")
    model = crf.train(docs, rows=30)
    assert model.languages == ["de", "en", "fr"] and model.weights.dtype == np.float32
    found = crf.Labeller(model).text_languages(["die der", "of the", "les la"])
    assert [language for language, _ in found] == ["de", "en", "fr"]


def test_the_smallest_ids_of_a_large_table(spark):
    for rows, ids in ((50, 5_000), (50, 60), (50, 20), (5, 5_000)):
        known = spark.range(ids).select(F.floor(F.col("id") / 2).alias("id"))
        expected = known.distinct().orderBy(F.xxhash64("id"), "id").limit(rows).collect()
        assert crf._smallest(known, rows).collect() == expected
    many = spark.range(4_000).select((F.col("id") % 60).alias("id"))
    assert crf._smallest(many, 50).count() == 50
