"""The registered queries of the operators, each over its whole table, and their SQL twins."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clicktide.llm import (
    bottom_k,
    bpe,
    hash_forest,
    jaccard_join,
    language_crf,
    mixing,
    quality_gam,
    quality_rules,
    quotation,
    runs,
    url_filters,
    vector_codes,
    wrappers,
)
from clicktide.session import materialize

Query = Callable[[SparkSession, str], DataFrame]

# The folder of the public vocabulary files.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
BYTE_BPE = f"{TOKENIZERS}/byte_bpe_50k.json"

# The rules that op5 applies.
URL_RULES = [
    url_filters.Rule("allow", "com", "/"),
    url_filters.Rule("block", "example.com", "/en/"),
    url_filters.Rule("allow", "www.example.com", "/en/"),
    url_filters.Rule("block", "net", "/es/"),
    url_filters.Rule("block", "net", "/fr/"),
]

# White space between words, as the other side of WORD_PATTERN.
WORD_GAP = r"[\x20\x09-\x0D]+"

_registered: dict[str, Query] = {}


def _query(function: Query) -> Query:
    _registered[function.__name__] = function
    return function


def all_queries() -> dict[str, Query]:
    return dict(_registered)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_crf.identify(docs, language_crf.train(docs))
    held_out = language_crf.held_out("doc_id").alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score")


@_query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), BYTE_BPE)


@_query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).drop("broken_rule")


@_query
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_classes(table(spark, sf_dir, "documents"))


@_query
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), URL_RULES)


@_query
def op6_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_forest.search(table(spark, sf_dir, "embeddings"))


@_query
def op7_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_texts(table(spark, sf_dir, "pages"))


@_query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.decide(table(spark, sf_dir, "documents")).drop("copies")


@_query
def op9_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_gam.train(docs, table(spark, sf_dir, "labels"))
    return quality_gam.score(docs, model).select(
        "doc_id",
        quality_gam.held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= quality_gam.THRESHOLD).cast("int").alias("predicted"),
    )


@_query
def op10_quotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation.reply_order(table(spark, sf_dir, "conversations"))


@_query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(table(spark, sf_dir, "documents"))


@_query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_digests(table(spark, sf_dir, "embeddings"))


@_query
def op13_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottom_k.near_components(table(spark, sf_dir, "documents"))


@_query
def quotation_of_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations rewritten as mail in which each message quotes the two before it."""
    mail = quotation.as_quoting_mail(table(spark, sf_dir, "conversations"))
    found = quotation.reply_order(mail)
    return found.select("conv_id", "turn", "root_turn", "depth", "reply_to", "linked", "text")


@_query
def quotation_of_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations rewritten as mail in which each message quotes one of the five before it."""
    mail = quotation.as_branching_mail(table(spark, sf_dir, "conversations"))
    found = quotation.reply_order(mail)
    return found.select("conv_id", "turn", "root_turn", "depth", "reply_to", "linked", "text")


@_query
def bpe_of_unsplit_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without white space, cut into short pieces and joined, against texts in one piece."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), WORD_GAP, "").alias("text")
    )
    # Read four times: written once, as the replacement takes longer than reading.
    docs = materialize(docs, "unsplit")
    joined = bpe.encode_digests(docs, BYTE_BPE, long_chars=256, piece_chars=64)
    whole = bpe.encode_digests(docs, BYTE_BPE, long_chars=1 << 30)
    of_whole = whole.dropDuplicates().select(
        "doc_id", "decoded_sha256", F.col("ids_sha256").alias("whole_sha256")
    )
    same = (F.col("ids_sha256") == F.col("whole_sha256")).alias("same_as_whole")
    return joined.join(of_whole, ["doc_id", "decoded_sha256"], "left").select(
        "doc_id", "decoded_sha256", F.coalesce(same, F.lit(False)).alias("same_as_whole")
    )


ORACLE = {
    "op5_url_filters": url_filters.oracle_sql(URL_RULES),
    "op8_mixing": mixing.DECIDE_SQL,
    "op10_quotation": quotation.ORDER_SQL,
    "op12_vector_codes": vector_codes.CODES_SQL,
    "op13_bottom_k": bottom_k.COMPONENTS_SQL,
    "quotation_of_mail": quotation.MAIL_SQL,
    "quotation_of_branches": quotation.BRANCHES_SQL,
    "bpe_of_unsplit_text": bpe.UNSPLIT_SQL,
}
