"""URL filter lists, in DataFrame functions only.

A rule (host, path prefix) is stored under its canonical URL: lower-case host + path. A page's possible
rules are its host's label suffixes with those prefixes of its path that have a listed length. A blocked
Bloom filter (each key's bits lie in one 64-bit word) drops nearly all of them inside the row; what passes
is exploded and settled by an exact hash join, which removes false positives.

Rows: a null url, or one without "://", has an empty host and path; no rule fits it. Repeated rows stay
repeated. Of several fitting rules the longest canonical URL wins; a rule listed twice takes its smallest
verdict (allow before block). An empty list gives every page the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Bits a listed URL, bits set in its word; the filter's size is a fixed multiple of the list's.
BITS_PER_KEY = 24
BITS_SET = 6
#: Most listed URLs whose filter (3 bytes a URL) is one value of the plan; the words of a longer list's filter are joined by their numbers.
MAX_IN_FILTER = 1_000_000
#: Most listed URLs that are broadcast for the exact join; longer lists are shuffled, and hot keys split by the skew join.
MAX_BROADCAST = 100_000


def host_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.length(rest) + F.lit(4))
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.contains(url, F.lit("://")), F.translate(host, upper, lower)).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.length(rest) + F.lit(4))
    path = F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), path).otherwise("")


def host_suffixes(host: Column) -> Column:
    """example.com gives [example.com, com]; an empty host gives itself."""
    labels = F.split(host, "\\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def word_and_mask(key: Column, words: int) -> tuple[Column, Column]:
    h = F.xxhash64(key)
    word = F.pmod(h, F.lit(words)).cast("int")
    bits = F.xxhash64(key, F.lit(1))
    mask = F.lit(0).cast("long")
    for i in range(BITS_SET):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return word, mask


def filter_words(keys: DataFrame, words: int) -> DataFrame:
    """(word, bits) of the words that are not zero. keys has one column, key."""
    word, mask = word_and_mask(F.col("key"), words)
    return keys.groupBy(word.alias("word")).agg(F.bit_or(mask).alias("bits"))


def blocked_bloom(keys: DataFrame, words: int) -> DataFrame:
    """One row, table: the filter's words as an array."""
    bits = filter_words(keys, words)
    dense = keys.sparkSession.range(words).select(F.col("id").cast("int").alias("word")).join(bits, "word", "left")
    ordered = F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return dense.agg(F.transform(ordered, lambda w: w["bits"]).alias("table"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages (page_id, url).

    rules: host, path, verdict. rule is the winning rule's host + path, else null.
    """
    listed = rules.select(
        F.concat(F.lower(F.coalesce("host", F.lit(""))), F.coalesce("path", F.lit(""))).alias("key"),
        F.length(F.coalesce("path", F.lit(""))).alias("path_length"), "verdict",
    ).groupBy("key").agg(F.min("verdict").alias("listed_verdict"), F.min("path_length").alias("path_length"))
    lengths = [r[0] for r in rules.select(F.length(F.coalesce("path", F.lit("")))).distinct().collect()]  # a few
    n = listed.count()
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url")).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in sorted(lengths)]), lambda p: p.isNotNull()) if lengths else F.array().cast("array<string>")
    keys = F.flatten(F.transform(host_suffixes(F.col("host")), lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    keys = F.when(F.col("host") != "", keys).otherwise(F.array().cast("array<string>"))
    # A page's first possible key always stays, so that no page is lost; the others only if the filter lets them pass.
    hits = rows.select("row", "page_id", "host", "path", F.posexplode_outer(F.array_distinct(keys)).alias("pos", "key"))
    if n:
        words = max(1, -(-n * BITS_PER_KEY // 64))
        word, mask = word_and_mask(F.col("key"), words)
        always = F.col("key").isNull() | (F.col("pos") == 0)
        if n <= MAX_IN_FILTER:
            table = blocked_bloom(listed.select("key"), words).scalar()  # an uncorrelated subquery: computed once, one value a task
            hits = hits.where(always | (F.element_at(table, word + 1).bitwiseAND(mask) == mask))
        else:  # both sides are shuffled by the word's number, and a busy word is split by the skew join
            told = hits.withColumn("word", word).join(cut(filter_words(listed.select("key"), words)), "word", "left")
            hits = told.where(always | (F.col("bits").bitwiseAND(mask) == mask)).drop("word", "bits")
    exact = listed.drop("path_length")
    found = hits.join(F.broadcast(exact) if n <= MAX_BROADCAST else cut(exact), "key", "left")
    best = F.max(F.when(F.col("listed_verdict").isNotNull(), F.struct(F.length("key").alias("n"), F.col("key"), F.col("listed_verdict"))))
    out = found.groupBy("row", "page_id", "host", "path").agg(best.alias("best"))
    return out.select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.listed_verdict", F.lit(default)).alias("verdict"))
