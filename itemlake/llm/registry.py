"""One query per training-data operator over its whole table, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemlake.llm import bpe, chat, filteraudit, jaccard, lexical, mixing, pii, quality, substring, tokenfile, toxicity, vectors, warc
from itemlake.plans.scratch import new_folder


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    warc.write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return warc.page_digests(warc.read_warc(spark, folder))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.conversation_digests(chat.format_turns(rows))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.drop_copied(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pii.personal_data(docs, pii.train_tagger(docs))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    tokenfile.write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("byte_bpe_50k.json"), match_added=True)
    read = tokenfile.read_tokens(spark, folder)
    return read.select("doc_id", "start", (F.octet_length("tokens") / 4).cast("long").alias("n_tokens"), F.crc32("tokens").alias("ids_crc32"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks, public_tokenizers.PATTERN)
    return bpe.decode_documents(encoded, ranks, public_tokenizers.PATTERN).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scores = toxicity.toxic_scores(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scores.select("doc_id", toxicity.is_held_out().alias("held_out"), "score", "predicted")


OP4_SQL = """
WITH RECURSIVE w AS (
  SELECT source, count(*) AS n, greatest(1, CAST(round(sqrt(CAST(count(*) AS DOUBLE)) * 1000) AS BIGINT)) AS weight FROM documents GROUP BY source
), m AS (
  SELECT *, row_number() OVER (PARTITION BY weight ORDER BY source NULLS FIRST) - 1 AS member, count(*) OVER (PARTITION BY weight) AS members,
         CAST(sum(weight) OVER () AS BIGINT) AS total FROM w
), k AS (SELECT weight, weight * max(members) AS p, row_number() OVER (ORDER BY weight) AS i FROM m GROUP BY weight
), one AS (SELECT list(p ORDER BY i) AS p, (SELECT max(total) FROM m) AS total, (SELECT max(((n + 31) // 32 * total + weight - 1) // weight) FROM m) AS slots FROM k
), sim(t, done, pick, p, total, slots) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(p, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT), p, total, slots FROM one
  UNION ALL
  SELECT t + 1, list_transform(done, lambda d, j: CASE WHEN j = k THEN d + 1 ELSE d END), k, p, total, slots FROM (
    SELECT t, done, p, total, slots, list_min(list_filter(list_transform(range(1, len(p) + 1), lambda j:
        CASE WHEN done[j] * total < (t + 2) * p[j]
             THEN (((done[j] + 1) * total + p[j] - 1) // p[j]) * 1048576 + j END), lambda x: x IS NOT NULL)) % 1048576 AS k
    FROM sim WHERE t + 1 < slots) q
), seats AS (SELECT weight, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn FROM sim JOIN k ON k.i = sim.pick WHERE t >= 0
), ranked AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY coalesce(md5(CAST(doc_id AS VARCHAR)), 'g'), doc_id NULLS LAST) - 1 AS r FROM documents
)
SELECT d.doc_id, d.source, d.r // 32 AS block, (d.r // 32 * m.total) // m.weight AS release,
       ((d.r // 32 + 1) * m.total + m.weight - 1) // m.weight AS due, seats.slot, seats.slot * 32 + d.r % 32 AS position
FROM ranked d JOIN m ON d.source IS NOT DISTINCT FROM m.source
JOIN seats ON seats.weight = m.weight AND seats.turn = d.r // 32 * m.members + m.member
"""


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), l AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
    CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS m
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id
), cells AS (
  SELECT part, m, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY part, m
), b AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(f, bit)
), orders AS (
  SELECT b1.f || b2.f || b3.f || b4.f || b5.f AS filter_order, [b1.bit, b2.bit, b3.bit, b4.bit, b5.bit] AS bits
  FROM b b1, b b2, b b3, b b4, b b5 WHERE b1.bit + b2.bit + b3.bit + b4.bit + b5.bit = 31 AND (b1.bit | b2.bit | b3.bit | b4.bit | b5.bit) = 31
), steps AS (
  SELECT filter_order, i AS step, bits[i] AS cur, coalesce(list_sum(bits[1:i - 1]), 0)::BIGINT AS prev FROM orders, range(1, 6) r(i)
), per AS (
  SELECT part, filter_order, step, cur, coalesce(sum(n) FILTER (m & (prev | cur) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (m & prev = 0 AND m & cur <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (m & prev <> 0 AND m & cur <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (m = cur), 0)::BIGINT AS unique_fails,
    coalesce(sum(g) FILTER (m & prev = 0 AND m & cur <> 0), 0)::BIGINT AS good_lost, coalesce(sum(x) FILTER (m & prev = 0 AND m & cur <> 0), 0)::BIGINT AS toxic_lost
  FROM steps, cells GROUP BY ALL
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, cur))::BIGINT AS shapley FROM per
"""

OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, terms(text) AS ts FROM documents
), q AS (
  SELECT i, item_id, unnest(ts) AS term FROM (SELECT row_number() OVER () AS i, item_id, terms(text) AS ts FROM benchmark)
), n AS (SELECT k, doc_id, len(ts) AS n FROM d WHERE len(ts) > 0
), s AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM n
), tf AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY k, term
), w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term, nn
), sat AS (SELECT tf.k, tf.term, w.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n.n * nn) // l))) AS score FROM tf JOIN n USING (k) JOIN w USING (term), s
), found AS (SELECT q.i, q.item_id, sat.k, CAST(sum(score) AS BIGINT) AS score FROM q JOIN sat USING (term) GROUP BY ALL
), r AS (SELECT found.*, n.doc_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, n.doc_id NULLS LAST) AS rank FROM found JOIN n USING (k) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
""".replace("terms(text)", r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_warc, op2_chat_format, op3_substring_dedup, op4_mix_sources, op5_quality_rules, op6_personal_data,
        op7_token_files, op8_jaccard_join, op9_near_vectors, op10_byte_bpe, op11_filter_audit, op12_ranked_search, op13_toxicity, pipeline,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_mix_sources": OP4_SQL, "op11_filter_audit": OP11_SQL, "op12_ranked_search": OP12_SQL}
