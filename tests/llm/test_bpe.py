import hashlib
import random

import numpy as np
import pytest

from clicktide.llm import bpe, queries
from clicktide.llm.queries import BYTE_BPE

PIECES = ["a", "b", "the", "é", "ß", " ", "  ", "\n", "!", "'", "'s", "1", "23", "漢", "😀", "ing"]
PIECES += ["<|endoftext|>", "<|", "\xa0", "$$$", "́", "\x1c", "\x85", " "]


def library(text):
    return bpe.load(BYTE_BPE).encode(text, add_special_tokens=False).ids


def made_up(seed, most=120):
    draw = random.Random(seed)
    some = draw.sample(PIECES, draw.choice([1, 2, 3, 5, len(PIECES)]))
    return "".join(draw.choice(some) for _ in range(draw.randint(0, most)))


@pytest.mark.parametrize("seed", range(300))
def test_cut_and_joined_like_the_library(seed, monkeypatch):
    monkeypatch.setattr(bpe, "WINDOW_IDS", 1)
    text, size = made_up(seed), random.Random(seed).choice([2, 3, 5, 16])
    pieces = bpe.cut(BYTE_BPE, text, size)
    assert "".join(piece for piece, _ in pieces) == text
    ids = [np.array(x, dtype=np.int32) for x in bpe.encode_whole(BYTE_BPE, [p for p, _ in pieces])]
    joined = bpe.join_tree(BYTE_BPE, ids, [within for _, within in pieces]).tolist()
    assert joined == library(text) == bpe.encode_whole(BYTE_BPE, [text])[0]


@pytest.mark.parametrize("seed", range(100))
def test_decoded_like_the_library(seed):
    ids = library(made_up(seed))
    text = bpe.load(BYTE_BPE).decode(ids, skip_special_tokens=False)
    assert bpe.decode(BYTE_BPE, [ids]) == [text]


def digest(text):
    ids = library(text)
    decoded = bpe.load(BYTE_BPE).decode(ids, skip_special_tokens=False)
    joined = ",".join(map(str, ids))
    return (
        len(ids),
        hashlib.sha256(joined.encode()).hexdigest(),
        hashlib.sha256(decoded.encode()).hexdigest(),
    )


def long_texts():
    draw = random.Random(9)
    return [
        "".join(draw.choice("abcdeé") for _ in range(150_000)),
        " " * 100_000,
        "ab " * 60_000,
        "<|endoftext|>".join(["x" * 40_000] * 4),
        "漢字" * 50_000,
        "".join(draw.choice(PIECES) for _ in range(90_000)),
    ]


def test_long_texts_on_spark(spark):
    rows = [(at, text) for at, text in enumerate(long_texts())]
    rows += [(7, "short one"), (7, "short one"), (None, "no id"), (8, None), (9, "")]
    rows += [rows[0], (None, rows[1][1])]
    docs = spark.createDataFrame(
        [(at, text, "other") for at, text in rows], "doc_id long, text string, ids string"
    )
    found = sorted(map(tuple, bpe.encode_digests(docs, BYTE_BPE).collect()), key=repr)
    assert found == sorted(((at, *digest(text or "")) for at, text in rows), key=repr)


def test_ids_themselves(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "x" * 70_000)], "doc_id long, text string")
    found = {row["doc_id"]: row["ids"] for row in bpe.encode(docs, BYTE_BPE).collect()}
    assert found == {1: library("one two"), 2: library("x" * 70_000)}
    assert bpe.encode(docs.where("false"), BYTE_BPE).collect() == []


def test_whole_table_like_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {row["doc_id"]: tuple(row)[1:] for row in bpe.encode_digests(docs, BYTE_BPE).collect()}
    texts = {row["doc_id"]: row["text"] for row in docs.collect()}
    assert found == {key: digest(text or "") for key, text in texts.items()}


def test_unsplit_texts_are_joined_by_windows(spark, monkeypatch):
    """The registered twin: whole texts without white space, most of them joined piece by piece."""
    found = queries.all_queries()["bpe_of_unsplit_text"](spark, "/root/testdata/sf0.001").collect()
    assert found and all(row["same_as_whole"] for row in found)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    texts = ["".join((row["text"] or "").split()) for row in docs][:60]
    joins = []
    join = bpe.join_ids
    monkeypatch.setattr(bpe, "join_ids", lambda *args: joins.append(1) or join(*args))
    for text in texts:
        pieces = bpe.cut(BYTE_BPE, text, 8)
        ids = [np.array(x, dtype=np.int32) for x in bpe.encode_whole(BYTE_BPE, [p for p, _ in pieces])]
        assert bpe.join_tree(BYTE_BPE, ids, [within for _, within in pieces]).tolist() == library(text)
    assert len(joins) > 100


@pytest.mark.parametrize("seed", range(100))
def test_words_of_the_split_like_the_library(seed):
    draw = random.Random(seed)
    latin = [*map(chr, range(0x250)), *map(chr, range(0x2010, 0x2028)), *[" ", "\n", "'s", "'ll", "a"] * 40]
    for text in [made_up(seed), "".join(draw.choice(latin) for _ in range(400))]:
        spans = bpe.load(BYTE_BPE).pre_tokenizer.pre_tokenize_str(text)
        assert list(bpe._word_ends(BYTE_BPE, text)) == [end for _, (_, end) in spans]


@pytest.mark.parametrize("seed", range(100))
def test_rows_of_pieces_like_the_library(seed, monkeypatch):
    """Pieces joined within rows, whose ids then are joined over rows."""
    monkeypatch.setattr(bpe, "WINDOW_IDS", 1)
    text, draw = made_up(seed), random.Random(seed)
    pieces = bpe.cut(BYTE_BPE, text, draw.choice([2, 3, 5]))
    rows = bpe.rows_of(pieces, draw.choice([1, 7, 16, 64]))
    assert [piece for row in rows for piece in row] == pieces
    ids = [np.array(bpe.encode_pieces(BYTE_BPE, *map(list, zip(*row))), dtype=np.int32) for row in rows]
    assert bpe.join_tree(BYTE_BPE, ids, [row[0][1] for row in rows]).tolist() == library(text)


def test_short_pieces_share_rows(spark):
    """Rows that are shuffled and sorted grow with the characters, however short the pieces are."""
    texts = ["abcde" * 8_000, "ab, " * 10_000, "x" * 100]
    long = spark.createDataFrame([(n, n, t) for n, t in enumerate(texts)], "row long, doc_id long, text string")
    rows = bpe._pieces(long, BYTE_BPE, 64).groupBy("doc_id").count().collect()
    assert {row["doc_id"]: row["count"] for row in rows} == {0: 3, 1: 3, 2: 1}


def test_short_pieces_over_several_rows_on_spark(spark):
    texts = [*long_texts(), "漢é" * 3_000, "ab" * 200, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = bpe.encode_digests(docs, BYTE_BPE, long_chars=256, piece_chars=64).collect()
    assert sorted(map(tuple, found)) == [(at, *digest(text or "")) for at, text in enumerate(texts)]
