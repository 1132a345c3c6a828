"""URL rules behind a blocked Bloom filter, with DataFrame operations only.

Each rule is a host and a path prefix. A page can only fit a rule whose host is one of the page's host suffixes and
whose path is one of the page's path prefixes, so each page has a short list of candidate keys. Keys that the filter
(one block of four 64-bit words for each key, one bit in each word) lacks are left out inside the row. Pages without a key
left get the default verdict where they are; the others meet the rules in an exact hash join, which removes false positives,
and the longest rule that fits decides.

Defined results: a null url, or one without ://, has an empty host and path; rows that repeat stay repeated; of rules of
equal length the one with the longer host wins, then the greater text; an empty rule table lets every page pass with the
default verdict; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules that may be broadcast: at 100 bytes each under 100 MB.
BROADCAST_RULES = 1_000_000
BLOCKS_MAX = 1 << 20
RULES_PER_BLOCK = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    before = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    host = F.regexp_extract(before, r"(?s)^([^/]*)", 1)
    return F.translate(host, UPPER, LOWER), F.substring(before, F.length(host) + 1, F.length(before))


def _bits(key: Column) -> list[Column]:
    """A key's bit in each of the four words of its block."""
    h = F.xxhash64(F.lit("bits"), key)
    return [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(4)]


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row for each page: id, host, path, rule (host and path prefix, or null), verdict.

    rules: host, path (a leading slash included), verdict. The filter has a block for every eight rules, BLOCKS_MAX blocks (32 MB) at most;
    more rules only let more candidates through to the join. The rules are broadcast while they are under
    BROADCAST_RULES; beyond, the join shuffles both sides and adaptive execution splits hot keys.
    """
    spark = pages.sparkSession
    rules = rules.select(F.concat("host", "path").alias("key"), F.col("host").alias("rule_host"), F.col("verdict").alias("rule_verdict")).dropna(subset=["key"]).groupBy("key").agg(F.max(F.struct(F.length("rule_host").alias("n"), "rule_host", "rule_verdict")).alias("r")).select("key", "r.rule_host", "r.rule_verdict")
    labels_of = lambda host: F.split(host, r"\.")
    count, lengths, most = rules.agg(F.count(F.lit(1)), F.collect_set(F.length("key") - F.length("rule_host")), F.max(F.size(labels_of(F.col("rule_host"))))).first()
    blocks = 1
    while blocks * RULES_PER_BLOCK < count and blocks < BLOCKS_MAX:
        blocks *= 2
    block = lambda key: F.pmod(F.xxhash64(F.lit("block"), key), F.lit(blocks)).cast("int")
    words = rules.select(block(F.col("key")).alias("b"), *[w.alias(f"w{i}") for i, w in enumerate(_bits(F.col("key")))])
    words = words.groupBy("b").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)])
    every = spark.range(blocks).select(F.col("id").cast("int").alias("b")).join(words, "b", "left")
    bloom = every.agg(F.sort_array(F.collect_list(F.struct("b", "w0", "w1", "w2", "w3"))).alias("bloom"))

    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("bloom", bloom.scalar())  # one value of at most 32 MB
    labels = labels_of(F.col("host"))
    # No rule has more labels than `most`, so longer suffixes of a host need no look.
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - F.lit((most or 1) - 1)), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, sorted(lengths))), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)) if lengths else F.array().cast("array<string>")
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))

    def may_hold(key: Column) -> Column:
        at = F.element_at("bloom", block(key) + 1)
        test = at.isNotNull()
        for i, bit in enumerate(_bits(key)):
            test = test & (at[f"w{i}"].bitwiseAND(bit) != 0)
        return F.coalesce(test, F.lit(False))

    # Written once: pages are scanned, and their keys built and tested, one time for those that pass and those that meet the rules.
    rows = materialise(rows.select("page_id", "host", "path", F.array_distinct(F.filter(keys, may_hold)).alias("keys")), "candidates")
    passed = rows.where(F.size("keys") == 0).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # A null first entry stands for the page itself, so that rows can be counted.
    rows = rows.where(F.size("keys") > 0).select("page_id", "host", "path", F.explode(F.concat(F.array(F.lit(None).cast("string")), "keys")).alias("key"))
    rules = F.broadcast(rules) if count <= BROADCAST_RULES else rules
    hits = rows.join(rules, "key", "left")
    rank = F.when(F.col("rule_verdict").isNotNull(), F.struct(F.length("key").alias("n"), F.length("rule_host").alias("h"), "key", "rule_verdict"))
    best = hits.groupBy("page_id", "host", "path").agg(F.max(rank).alias("best"), F.count_if(F.col("key").isNull()).alias("copies"))
    judged = best.select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")
    return passed.unionByName(judged)


def rules_from(spark, listed: list[tuple[str, str, str]]) -> DataFrame:
    """listed: verdict, host, path with its leading slash."""
    return spark.createDataFrame([(h, p, v) for v, h, p in listed], "host string, path string, verdict string")
