"""Queries of the training-data operators over the whole documents table, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_decode

    out = encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_components

    return near_components(read(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import remove_repeats

    return remove_repeats(read(spark, sf_dir, "documents")).drop("kept")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets_scan import scan_secrets

    out = scan_secrets(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_random", "n_spans")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_model import classify, grades, train

    docs = read(spark, sf_dir, "documents")
    return classify(docs, train(docs, grades(read(spark, sf_dir, "labels"))))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shards import shard

    return shard(read(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_rules import quality_rules

    return quality_rules(read(spark, sf_dir, "documents")).drop("cleaned")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import scan_pii

    out = scan_pii(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_spans")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(read(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import exact_dedup

    return exact_dedup(read(spark, sf_dir, "documents")).drop("locator")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .align import align_tokenizers

    return align_tokenizers(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import count_tokens

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest

    return manifest(read(spark, sf_dir, "documents"))


OP6_SQL = """
WITH d AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5('shard:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
p AS (
  SELECT d.*, CAST(r.depth AS INTEGER) AS depth, h >> (60 - r.depth) AS prefix
  FROM d, (SELECT CAST(range AS INTEGER) AS depth FROM range(0, 41)) r),
s AS (
  SELECT depth, prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_docs
  FROM p GROUP BY depth, prefix),
f AS (
  SELECT p.doc_id, p.n_bytes, p.depth, s.shard_bytes, s.shard_docs, p.prefix,
         row_number() OVER (PARTITION BY p.doc_id ORDER BY p.depth) AS rn
  FROM p JOIN s USING (depth, prefix)
  WHERE s.shard_bytes <= 8388608 OR s.shard_docs = 1)
SELECT doc_id, n_bytes, depth, shard_bytes, shard_docs, shard_bytes > 8388608 AS oversized,
       CASE WHEN depth = 0 THEN '' ELSE lpad(to_binary(prefix), depth, '0') END AS shard
FROM f WHERE rn = 1
"""

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
v AS (SELECT *, CAST(CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS weight FROM w),
o AS (
  SELECT *, row_number() OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, rank) AS place FROM v),
r AS (
  SELECT *,
    CAST(sum(source_size) OVER () AS BIGINT) AS s1, CAST(sum(weight) OVER () AS BIGINT) AS w1,
    CAST(coalesce(sum(source_size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s0,
    CAST(coalesce(sum(weight) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS w0
  FROM o),
x AS (SELECT *, CAST(s1 - 3 * s0 AS DOUBLE) / CAST(w1 - w0 AS DOUBLE) AS x FROM r),
l AS (SELECT arg_min(x, place) AS level FROM x WHERE 3 * source_size >= x * weight),
t AS (
  SELECT source, source_size, least(level * weight, CAST(3 * source_size AS DOUBLE)) AS target FROM x, l),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
g AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.whole, greatest(b.target - b.whole * b.source_size, 0) AS budget,
    CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS BIGINT) AS le,
    CAST(sum(size) OVER (PARTITION BY d.source, h) AS BIGINT) AS own
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN 2 * (le - own) + own <= 2 * budget THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM g
"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM d
"""

OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, text,
         CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END
         || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
         || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
         || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS head,
         replace(text, chr(10), '') AS cut,
         list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
             lambda c: list_transform(range(8), lambda k: CAST((ascii(c) >> CAST(k AS INTEGER)) & 1 AS BIGINT))))),
           lambda a, b: xor(a >> 1, (xor(a, b) & 1) * 3988292384::BIGINT)) & 1 = 1 AS tampered
  FROM documents),
l AS (
  SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
         sha256(head || CASE WHEN text IS NULL THEN '-' WHEN tampered THEN strlen(cut) || ':' || cut ELSE strlen(text) || ':' || text END) AS seen
  FROM d),
p AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM l),
up AS (
  SELECT source, 0 AS lvl, idx, leaf AS h, n FROM p
  UNION ALL
  SELECT source, lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM up WHERE n > 1 GROUP BY source, lvl, idx // 3, n),
s AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS lvl, idx, subroot AS h, n FROM s
  UNION ALL
  SELECT lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY lvl, idx // 3, n),
r AS (SELECT h AS root FROM top WHERE n = 1),
su AS (
  SELECT a.source, a.lvl, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM up a JOIN up b ON a.source IS NOT DISTINCT FROM b.source AND a.lvl = b.lvl AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY ALL),
st AS (
  SELECT a.lvl, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM top a JOIN top b ON a.lvl = b.lvl AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY ALL),
low AS (
  SELECT p.source, p.idx, list({'l': su.l, 'r': su.r} ORDER BY su.lvl) AS way
  FROM p JOIN su ON p.source IS NOT DISTINCT FROM su.source AND su.idx = p.idx // CAST(pow(3, su.lvl) AS BIGINT) GROUP BY ALL),
high AS (
  SELECT s.source, list({'l': st.l, 'r': st.r} ORDER BY st.lvl) AS way
  FROM s JOIN st ON st.idx = s.idx // CAST(pow(3, st.lvl) AS BIGINT) GROUP BY ALL),
w AS (
  SELECT p.doc_id, p.leaf, s.subroot, r.root, p.seen, list_concat(coalesce(low.way, []), coalesce(high.way, [])) AS way
  FROM p CROSS JOIN r JOIN s ON p.source IS NOT DISTINCT FROM s.source
  LEFT JOIN low ON p.source IS NOT DISTINCT FROM low.source AND p.idx = low.idx
  LEFT JOIN high ON p.source IS NOT DISTINCT FROM high.source),
f AS (
  SELECT *, list_reduce(list_prepend({'l': seen, 'r': ''}, way), lambda a, e: {'l': sha256(e.l || a.l || e.r), 'r': ''}).l AS folded_root FROM w)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(way, lambda e: e.l || e.r), ''), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM f
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_bpe, op2_ngram_jaccard, op3_suffix_dedup, op4_secrets, op5_quality, op6_sharding, op7_quality_rules, op8_pii, op9_mixing, op10_exact_dedup, op11_alignment, op12_token_counts, op13_merkle)}


def oracle_sql() -> dict[str, str]:
    return {"op6_sharding": OP6_SQL, "op9_mixing": OP9_SQL, "op10_exact_dedup": OP10_SQL, "op13_merkle": OP13_SQL}
