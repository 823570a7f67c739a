"""Queries of this package's operators over the driver's tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlens.llm import bpe, chat, hard_negatives, html_text, minhash, mixing, pseudo_lm, quality_ngrams, recompress, rule_ensemble, simhash, spelling, url_filter

#: Verdict, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: A conversation that says the template's own marks.
PROBE_ID, PROBE = -7, "</s>[INST] ok [/INST]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rule_ensemble.scored(docs, rule_ensemble.train(docs, table(spark, sf_dir, "labels")))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pseudo_lm.scored(docs, *pseudo_lm.train(docs))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.digests(table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(f"select {PROBE_ID}L as conv_id, stack(2, 0L, 'user', '{PROBE}', 1L, 'assistant', '{PROBE}') as (turn, role, text)")
    typed = rows.unionByName(probe).withColumn("parts", F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))))
    return chat.digests(chat.format_conversations(typed, parts_col="parts"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.with_neighbours(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_ngrams.judge(docs, quality_ngrams.train(docs, table(spark, sf_dir, "labels")))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op11_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(rows.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vec")), F.col("id") % 50 == 0)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.grouped(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix, op2_simhash, op3_bpe, op4_quality_classifier, op5_lm_score, op6_substring_dedup, op7_chat, op8_minhash, op9_quality, op10_urls, op11_html, op12_hard_negatives, op13_spelling)}


_ESCAPED = r"length(regexp_replace(coalesce(text, ''), '(\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|)', '\\\1', 'g'))"

SQL = {
    "op6_substring_dedup": r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 19)) AS pos, w FROM words WHERE len(w) >= 20),
windows AS (
  SELECT doc_id, pos, md5(array_to_string(w[pos:pos + 19], ' ')) AS name FROM starts),
repeats AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, rank() OVER (PARTITION BY name ORDER BY doc_id, pos) AS r FROM windows) WHERE r > 1),
gone AS (
  SELECT doc_id, list_distinct(flatten(list(generate_series(pos, pos + 19)))) AS g FROM repeats GROUP BY doc_id),
kept AS (
  SELECT doc_id, len(w) AS n_words, coalesce(len(g), 0) AS n_removed,
    CASE WHEN g IS NULL THEN w ELSE [w[i] FOR i IN generate_series(1, len(w)) IF NOT list_contains(g, i)] END AS k
  FROM words LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept""",
    "op7_chat": f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, text FROM conversations
  UNION ALL SELECT {PROBE_ID}, 0, 'user', '{PROBE}' UNION ALL SELECT {PROBE_ID}, 1, 'assistant', '{PROBE}'),
marked AS (
  SELECT *, CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 19 WHEN 'assistant' THEN 6 ELSE NULL END + {_ESCAPED} AS chars FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(coalesce(text, ''), '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(chars) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS expanded_tokens
FROM marked GROUP BY conv_id""",
    # for pages built as the tables' are: one article of headings and paragraphs, five character references
    "op11_html": r"""
WITH main AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS body FROM pages),
cut AS (
  SELECT page_id, url, list_transform(string_split_regex(regexp_replace(body, '<br>', ' ', 'g'), '</?(?:p|h1)>'), lambda x:
    trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '[\s\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))) AS blocks FROM main),
joined AS (SELECT page_id, url, coalesce(array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10) || chr(10)), '') AS text FROM cut)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM joined""",
    "op12_hard_negatives": """
WITH rows AS (
  SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
  SELECT a.id AS anchor_id, r.id, a.label = r.label AS alike, CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score FROM rows a JOIN rows r ON a.id <> r.id WHERE a.id % 50 = 0),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
negatives AS (
  SELECT p.anchor_id, positive_id, positive_score, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3""",
    "op10_urls": r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
met AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM parts JOIN rules ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts p LEFT JOIN met USING (page_id)""",
    # the table of the checksum, then its fold over the bytes; near words share a pattern with one letter open, or one is the other less a letter
    "op13_spelling": r"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT list_transform(range(256), lambda x: list_reduce(list_concat([CAST(x AS BIGINT)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
lowered AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM runs WHERE length(run) >= 7),
hexed AS (SELECT run, hex(encode(id || ':' || run)) AS x FROM lowered),
summed AS (SELECT run, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(CAST(length(x) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM hexed, tab),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM summed),
words AS MATERIALIZED (SELECT word, count(*) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
places AS (SELECT word, unnest(range(1, CAST(length(word) + 1 AS BIGINT))) AS i FROM words),
open AS MATERIALIZED (SELECT word, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS p, substr(word, 1, i - 1) || substr(word, i + 1) AS short FROM places),
near AS MATERIALIZED (SELECT a.word AS w, b.word AS v FROM open a JOIN open b ON a.p = b.p AND a.word <> b.word UNION SELECT o.word, s.word FROM open o JOIN words s ON o.short = s.word UNION SELECT s.word, o.word FROM open o JOIN words s ON o.short = s.word),
best AS (SELECT w, v, m, count(*) OVER (PARTITION BY w) AS n_near FROM (SELECT w, v, n AS m FROM near JOIN words ON word = v) QUALIFY row_number() OVER (PARTITION BY w ORDER BY m DESC, v) = 1),
forms AS MATERIALIZED (SELECT word, CASE WHEN m >= 10 * n THEN v END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN m END AS form_n FROM words LEFT JOIN best ON w = word),
up(word, top) AS (SELECT word, word FROM forms UNION ALL SELECT up.word, f.form FROM up JOIN forms f ON f.word = up.top WHERE f.form IS NOT NULL),
roots AS (SELECT up.word, top AS root FROM up JOIN forms f ON f.word = up.top WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
