"""URL filters as a sort-merge range join of rules and pages.

A rule is a host and the beginning of a path, and fits the host's subdomains too. The key of a rule
is its host with the labels reversed, then a separator, then its path. A url fits a rule if and only
if the key of one of the url's own host endings (example.com for www.example.com) begins with the
rule's key; so each rule is an interval of sorted keys, and intervals are nested or apart. Keys of
rules and urls are sorted together, and one sweep over them keeps a stack of the rules that are open.

A url has a key for each number of labels that some rule's host has, and one for its whole host.

Keys are dealt out by ranges that a sample of the urls gives. A rule goes to every range that its
interval touches, and a key so frequent that it takes several ranges is spread over all of them, so
no range holds more than its share. Of all rules that fit a url, the longest wins.

Defined cases: a null url, or one without ``://``, has an empty host and path and fits no rule;
rules with the same host and path count once, a block before an allow; among fitting rules of equal
length the one with the longer host wins; repeated rows get a row each; without rules all urls get
the default verdict; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from clicktide.llm.arrow import Batches

ALLOW, BLOCK = "allow", "block"
# Lower than any character of a path, so that a host's own key is before its subdomains' keys.
SEPARATOR = "\x00"
SAMPLE_KEYS = 20_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


def host_of(url: Column) -> Column:
    """What is behind the first :// up to the path, query or fragment, with A to Z lower-cased."""
    behind = _behind_scheme(url)
    return F.translate(
        F.regexp_extract(behind, r"^[^/?#]*", 0),
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
        "abcdefghijklmnopqrstuvwxyz",
    )


def path_of(url: Column) -> Column:
    """What is behind the host up to the query or fragment."""
    return F.regexp_extract(_behind_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _behind_scheme(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _reversed(labels: Column) -> Column:
    return F.array_join(F.reverse(labels), ".")


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Rules as rows (key, host, path, verdict), each key once."""
    rows = [(rule.host, rule.path, rule.verdict) for rule in rules]
    given = spark.createDataFrame(rows, "host string, path string, verdict string")
    once = given.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    labels = F.split("host", r"\.")
    # The separator behind the host keeps labels whole: com isn't the beginning of company.
    return once.select(
        F.concat(_reversed(labels), F.lit(SEPARATOR), "path").alias("key"), "host", "path", "verdict"
    )


def _host_endings(urls: DataFrame, depths: list[int]) -> DataFrame:
    """One row for each ending of each url's host that a rule can have, and for the whole host.

    ``depths`` are the numbers of labels of the rules' hosts, so a host with many labels makes no
    more rows than others. ``place`` is 0 for the whole host.
    """
    labels = F.split("host", r"\.")
    known = F.array(*[F.lit(depth) for depth in depths]) if depths else F.array().cast("array<int>")
    own = F.size(labels)
    wanted = F.array_union(F.filter(known, lambda depth: depth < own), F.array(own))
    return (
        urls.where(F.col("host") != "")
        .select("*", F.explode(wanted).alias("depth"))
        .select("*", (own - F.col("depth")).alias("place"))
        .select(
            *urls.columns,
            "place",
            F.concat(
                _reversed(F.slice(labels, F.col("place") + 1, F.col("depth"))), F.lit(SEPARATOR), "path"
            ).alias("key"),
        )
    )


def _range_ends(keys: DataFrame, ranges: int) -> list[str]:
    """Keys that cut a sample of the urls' keys into equal parts; a frequent key may be several."""
    count = keys.count()
    share = min(1.0, SAMPLE_KEYS / max(1, count))
    # A sample of about SAMPLE_KEYS keys comes to the driver. It moves the cuts, not the result.
    sample = sorted(row["key"] for row in keys.select("key").sample(share, seed=11).collect())
    if not sample:
        return []
    return sorted(sample[len(sample) * at // ranges] for at in range(1, ranges))


def _with_ranges(rows: DataFrame, ends: list[str], rules: bool) -> DataFrame:
    """Add the first and the last range that each key may be in, or that each rule touches."""
    sorted_ends = [end.encode() for end in ends]

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last = [], []
            for key in batch.column("key").cast(pa.binary()).to_pylist():
                first.append(bisect_left(sorted_ends, key))
                high = bisect_right(sorted_ends, key)
                while rules and high < len(sorted_ends) and sorted_ends[high].startswith(key):
                    high += 1
                last.append(high)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(first, pa.int32()), pa.array(last, pa.int32())],
                names=[*batch.schema.names, "first_range", "last_range"],
            )

    ends_of = [StructField(name, IntegerType()) for name in ("first_range", "last_range")]
    return rows.mapInArrow(run, StructType([*rows.schema.fields, *ends_of]))


def _sweep(batches: Batches) -> Iterator[pa.RecordBatch]:
    """The longest open rule for every url key; rows are sorted by range, key, and rules first."""
    open_rules: list[tuple[str, str, str, str]] = []
    now = None
    for batch in batches:
        columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        n = batch.num_rows
        rules: list[tuple[str | None, str | None, str | None]] = [(None, None, None)] * n
        for at in range(n):
            if columns["range"][at] != now:
                now, open_rules = columns["range"][at], []
            key = columns["key"][at]
            while open_rules and not key.startswith(open_rules[-1][0]):
                open_rules.pop()
            if columns["is_rule"][at]:
                names = [columns[name][at] for name in ("rule_host", "rule_path", "rule_verdict")]
                open_rules.append((key, *names))
            elif open_rules:
                rules[at] = open_rules[-1][1:]
        is_url = pa.array([not rule for rule in columns["is_rule"]])
        made = [pa.array(list(values), pa.string()) for values in zip(*rules)] or [
            pa.array([], pa.string())
        ] * 3
        kept = ["row_id", "host", "path", "place"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(name) for name in kept], *made],
            names=[*kept, "rule_host", "rule_path", "rule_verdict"],
        ).filter(is_url)


def judge(
    pages: DataFrame,
    rules: list[Rule],
    id_col: str = "page_id",
    url: str = "url",
    default: str = ALLOW,
) -> DataFrame:
    """Per row: page_id, host, path, rule (host and path of the rule that decides) and verdict."""
    spark = pages.sparkSession
    urls = pages.select(
        F.col(id_col).alias("row_id"),
        host_of(F.col(url)).alias("host"),
        path_of(F.col(url)).alias("path"),
    )
    endings = _host_endings(urls, sorted({rule.host.count(".") + 1 for rule in rules}))
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ends = _range_ends(endings, ranges)
    # A key that is the end of several ranges may be in any of them.
    spread = F.pmod(
        F.xxhash64("row_id", "host", "path", "place"), F.col("last_range") - F.col("first_range") + 1
    )
    nothing = F.lit(None).cast("string")
    dealt_urls = _with_ranges(endings, ends, rules=False).select(
        (F.col("first_range") + spread).cast("int").alias("range"),
        "key",
        F.lit(False).alias("is_rule"),
        "row_id",
        "host",
        "path",
        "place",
        *[nothing.alias(name) for name in ("rule_host", "rule_path", "rule_verdict")],
    )
    dealt_rules = _with_ranges(rule_table(spark, rules), ends, rules=True).select(
        F.explode(F.sequence("first_range", "last_range")).alias("range"),
        "key",
        F.lit(True).alias("is_rule"),
        F.lit(None).cast(urls.schema["row_id"].dataType).alias("row_id"),
        nothing.alias("host"),
        nothing.alias("path"),
        F.lit(None).cast("int").alias("place"),
        F.col("host").alias("rule_host"),
        F.col("path").alias("rule_path"),
        F.col("verdict").alias("rule_verdict"),
    )
    kept = ["row_id", "host", "path", "place", "rule_host", "rule_path", "rule_verdict"]
    dealt = dealt_urls.unionByName(dealt_rules)
    swept = (
        dealt.repartitionByRange(ranges, "range")
        .sortWithinPartitions("range", "key", F.col("is_rule").desc())
        .mapInArrow(_sweep, StructType([dealt.schema[name] for name in kept]))
    )
    # The longest rule of all endings; every row has one ending at place 0.
    found = swept.groupBy("row_id", "host", "path").agg(
        F.max(
            F.when(
                F.col("rule_host").isNotNull(),
                F.struct(
                    (F.length("rule_host") + F.length("rule_path")).alias("size"),
                    F.length("rule_host").alias("host_size"),
                    F.concat("rule_host", "rule_path").alias("rule"),
                    F.col("rule_verdict").alias("verdict"),
                ),
            )
        ).alias("best"),
        F.sum((F.col("place") == 0).cast("int")).alias("rows"),
    )
    each = found.select("*", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))))
    hosts = each.select("row_id", "host", "path", "best.rule", "best.verdict")
    none = urls.where(F.col("host") == "").select(
        "*", nothing.alias("rule"), nothing.alias("verdict")
    )
    return hosts.unionByName(none).select(
        F.col("row_id").alias("page_id"),
        "host",
        "path",
        "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )


def oracle_sql(rules: list[Rule], default: str = ALLOW) -> str:
    """The same for the pages table in SQL, every rule tried on every url."""
    rows = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in rules)
    return f"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {rows}),
behind AS (
  SELECT page_id, row_number() OVER () AS row_number,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), urls AS (
  SELECT page_id, row_number, lower(regexp_extract(rest, '^[^/?#]*')) AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM behind
), fitting AS (
  SELECT row_number, rule_host || rule_path AS rule, rule_verdict,
         row_number() OVER (PARTITION BY row_number ORDER BY
           length(rule_host || rule_path) DESC, length(rule_host) DESC) AS place
  FROM urls JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, '{default}') AS verdict
FROM urls LEFT JOIN fitting ON urls.row_number = fitting.row_number AND place = 1
"""
