"""The driver's queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, linededup, mpeg, packing, quality, sharding, simhash, substring, url_filter
from .common import documents


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs.select("doc_id", "text"), model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), shingle=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(documents(spark, sf_dir), k=20)


OP3_SQL = r"""
WITH docs AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS words FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i + 1 : i + 20], ' ') AS key FROM (SELECT doc_id, words, unnest(range(len(words) - 19)) AS i FROM docs)
), repeats AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, i + j AS i FROM repeats, range(20) t(j)
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM docs) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (doc_id)
"""


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(documents(spark, sf_dir), shards=16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _mixed(x: int) -> int:
    """The scrambling of 64-bit numbers, in Python's own integers."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor % 2**64
    return x ^ x >> 31


def _network_sql(source: str, seed: int = 0x5EED, rounds: int = 6) -> str:
    """One pass of the Feistel network over column x of `source`, whose columns id, n and half stay."""
    sql = f"SELECT id, n, half, x >> half AS l, x & ((1::UHUGEINT << half) - 1) AS r FROM {source}"
    for i in range(1, rounds + 1):
        key = _mixed(i * 0x9E3779B97F4A7C15 % 2**64 ^ seed)
        sql = f"SELECT *, xor(r, {key}::UHUGEINT) AS y FROM ({sql})"
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            sql = f"SELECT * REPLACE ((xor(y, y >> {shift}) * {factor}::UHUGEINT) % {2**64}::UHUGEINT AS y) FROM ({sql})"
        sql = f"SELECT id, n, half, r AS l, xor(l, xor(y, y >> 31) & ((1::UHUGEINT << half) - 1)) AS r FROM ({sql})"
    return f"SELECT id, n, half, (l << half) | r AS x FROM ({sql})"


def _crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes, bit by bit."""
    step = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)"
    byte = "xor(c, b)"
    for _ in range(8):
        byte = f"list_transform([{byte}], lambda c: {step})[1]"
    return f"xor(list_reduce([4294967295::UBIGINT] || list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS UBIGINT)), lambda c, b: {byte}), 4294967295::UBIGINT)"


OP4_SQL = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, CAST({_crc32_sql("coalesce(text, '')")} AS BIGINT) AS text_crc32 FROM documents
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS id, count(*) OVER () AS n FROM sized
), walk AS (
  SELECT id, n, CAST(greatest(1, (floor(log2(greatest(n - 1, 1))) + 2) // 2) AS UHUGEINT) AS half, id::UHUGEINT AS x, FALSE AS done FROM numbered
  UNION ALL
  SELECT id, n, half, x, x < n::UHUGEINT AS done FROM ({_network_sql("walk WHERE NOT done")})
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(x % 16 AS INTEGER) AS shard, CAST(x // 16 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM numbered JOIN (SELECT id, x FROM walk WHERE done) USING (id)
"""


OP5_SQL = r"""
WITH docs AS (
  SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents
), pairs AS (
  SELECT doc_id, i, lines[i + 1] AS a, lines[i + 2] AS b FROM (SELECT doc_id, lines, unnest(range(len(lines) - 1)) AS i FROM docs)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, i) AS n FROM pairs) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, i + j AS i FROM later, range(2) t(j)
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS text
  FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM docs) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, coalesce(len(lines), 0) AS n_lines, coalesce(len(lines), 0) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""


def op5_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(documents(spark, sf_dir))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.identify(docs.select("doc_id", "text"), langid.train(docs)).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), max_length=4096, end_id=2)


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: (host, path, verdict)
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules, default="allow")


OP9_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS rid
  FROM cut
), rules(h, p, v) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), ranked AS (
  SELECT page_id, host, path, h || p AS rule, v, row_number() OVER (PARTITION BY rid ORDER BY length(h || p) DESC NULLS LAST) AS rn
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM ranked WHERE rn = 1
"""


def op10_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.digest(documents(spark, sf_dir))


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality, op2_simhash, op3_substring, op4_sharding, op5_linededup, op6_langid, op7_packing, op8_decontam, op9_url_filter, op10_mpeg)}


def oracle_sql() -> dict[str, str]:
    return {"op3_substring": OP3_SQL, "op4_sharding": OP4_SQL, "op5_linededup": OP5_SQL, "op9_url_filter": OP9_SQL}
