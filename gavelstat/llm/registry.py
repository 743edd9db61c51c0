"""The queries of this package and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gavelstat.llm import (
    bpe, chat, conversation_repair, dart_minhash, debruijn, digest_index, license_scan, mixing, pii, quality_ranker,
    suffix_buckets, text_rules, token_links, twins,
)
from gavelstat.llm.frames import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return register


@query("op1_quality_ranker")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality_ranker.score(docs, quality_ranker.fit(docs, table(spark, sf_dir, "labels")))


@query("op2_dart_minhash", twins.NEAR_DUPLICATES)
def op2(spark, sf_dir):
    return dart_minhash.classes(table(spark, sf_dir, "documents"))


@query("op3_suffix_buckets", twins.BYTE_STRINGS)
def op3(spark, sf_dir):
    return suffix_buckets.remove(table(spark, sf_dir, "documents"), keep_text=False)


@query("op4_pii")
def op4(spark, sf_dir):
    return pii.summary(pii.find(table(spark, sf_dir, "documents")))


_ESCAPED = "length({0}) + length({0}) - length(replace({0}, '\\', ''))" + "".join(
    f" + (length({{0}}) - length(replace({{0}}, '{c}', ''))) // {len(c)}" for c in chat.CONTROL
)


@query(
    "op5_chat",
    f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
 coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
 CAST(sum({_ESCAPED.format('role')} + {_ESCAPED.format('text')} + 16
  + CASE WHEN role = 'assistant' THEN 0 ELSE 15 END) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM t""",
)
def op5(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], rows.schema)
    return chat.digests(rows.unionByName(extra))


@query(
    "op6_mixing",
    r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
 md5(concat_ws(':', '11', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nr FROM d GROUP BY source),
w AS (SELECT *, CASE nr % 3 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS weight FROM s),
o AS (SELECT *, row_number() OVER ranked AS k, 2 * source_size / weight AS fill,
 CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 - coalesce(sum(2 * source_size) OVER (ranked ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
 sum(weight) OVER (ranked ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
 FROM w WINDOW ranked AS (ORDER BY 2 * source_size / weight, nr)),
l AS (SELECT *, min(CASE WHEN remaining / weights * weight < 2 * source_size THEN k END) OVER () AS level_at, remaining / weights AS level FROM o),
t AS (SELECT source, source_size, CASE WHEN level_at IS NULL OR k < level_at THEN CAST(2 * source_size AS DOUBLE)
 ELSE (max(CASE WHEN k = level_at THEN level END) OVER ()) * weight END AS target FROM l),
p AS (SELECT doc_id, size, source_size, target, least(CAST(floor(target) AS BIGINT), 2 * source_size) AS quota,
 CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start
 FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, greatest(least(start + size, quota) - start, 0)
 + greatest(least(source_size + start + size, quota) - source_size - start, 0) AS taken FROM p""",
)
def op6(spark, sf_dir):
    return mixing.taken(mixing.plan(table(spark, sf_dir, "documents")))


@query("op7_debruijn", twins.WORD_SEQUENCES)
def op7(spark, sf_dir):
    return debruijn.remove(table(spark, sf_dir, "documents"), keep_text=False)


@query("op8_bpe")
def op8(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op9_text_rules", twins.text_rules_sql())
def op9(spark, sf_dir):
    return text_rules.judge(table(spark, sf_dir, "documents")).drop("n_lines")


@query(
    "op10_digest_index",
    """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
 FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
 doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM d WINDOW same AS (PARTITION BY t)""",
)
def op10(spark, sf_dir):
    return digest_index.temporary_index(spark).add(table(spark, sf_dir, "documents"), steps=2)


@query("op11_token_links")
def op11(spark, sf_dir):
    vocabularies = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return token_links.summary(table(spark, sf_dir, "documents"), *vocabularies)


@query("op12_glr_repair")
def op12(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.summary(conversation_repair.damaged(rows), rows)


@query("op13_license_scan", twins.license_sql())
def op13(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))
