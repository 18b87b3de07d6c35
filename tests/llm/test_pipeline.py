import hashlib
from collections import Counter, defaultdict

import corpus_pipeline as pipeline
import numpy as np
from brute import near_classes

from clicktide.llm import bpe, mixing, quality_gam, quality_rules
from clicktide.llm.queries import BYTE_BPE
from test_mixing import poured

FOLDER = "/root/testdata/sf0.001"


def brute(spark):
    """All stages in plain Python, on whole lists."""
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [row.asDict() for row in documents.orderBy("doc_id").collect()]
    order = list(quality_rules.RULES)
    rows = [r for r in rows if quality_rules.first_broken(quality_rules.Measured(r["text"]), order) is None]
    model = quality_gam.train(documents, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    scores = model.score(np.array([quality_gam.features(r["text"]) for r in rows]))
    rows = [r for r, score in zip(rows, scores) if score >= quality_gam.THRESHOLD]
    classes = near_classes([r["text"] for r in rows])
    rows = [r for at, (r, (root, _, _)) in enumerate(zip(rows, classes)) if at == root]
    sizes, words = defaultdict(int), {}
    for r in rows:
        words[r["doc_id"]] = len(r["text"].encode().split())
        sizes[r["source"]] += words[r["doc_id"]]
    target = poured(sizes)
    found = Counter()
    for r in rows:
        rate = target[r["source"]] / sizes[r["source"]]
        digest = hashlib.md5(f"{mixing.SEED}:{r['doc_id']}".encode()).hexdigest()
        copies = int(rate) + (int(digest[:8], 16) / 2**32 < rate - int(rate))
        ids = bpe.load(BYTE_BPE).encode(r["text"], add_special_tokens=False).ids
        found[r["doc_id"], tuple(ids)] += copies
    return +found


def test_like_brute_force(spark):
    found = Counter((row["doc_id"], tuple(row["ids"])) for row in pipeline.run(spark, FOLDER).collect())
    assert found == brute(spark) and sum(found.values()) > 50


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(40)
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_of_edge_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    text = " ".join(f"word{at}" for at in range(80)) + "."
    rows = [(1, text, "en", "a", 1, "x"), (1, text, "en", "a", 1, "x"), (2, None, None, None, None, None)]
    rows += [(None, text + " and more of it", None, None, None, "y"), (3, "", "en", "b", 0, "z")]
    rows += [(4, "long " + " ".join(f"w{at}" for at in range(60_000)), "en", "b", 0, "z")]
    for frame in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in pipeline.STAGES:
            count = stage(spark, frame, FOLDER).count()
            assert count <= 3 * len(rows)


def test_clean_documents_are_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1")
    clean = docs.join(labels.select("doc_id"), "doc_id", "left_semi").where("n_chars > 1000")
    kept = pipeline.good_score(spark, pipeline.good_rules(spark, clean, FOLDER), "/root/testdata/sf0.01")
    assert kept.count() >= 0.99 * clean.count()
