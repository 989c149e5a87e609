"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, lexical, line_dedup, lm, periodic_runs, pii, quality, sharding, simhash, subwords, urls, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded_documents(_table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(_table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_components(_table(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(_table(spark, sf_dir, "pages"))


def op7_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subwords.encoded_digests(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(_table(spark, sf_dir, "pages"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_verdicts(_table(spark, sf_dir, "pages"), whole=True)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(_table(spark, sf_dir, "documents"), plant=True)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_counts(_table(spark, sf_dir, "documents"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


# Parts of the same operators that SQL can express


def pii_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1's counts of plain finds."""
    return op1_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2's shards: rows, first and last slot, and different slots of each."""
    rows = op2_sharding(spark, sf_dir).groupBy("shard")
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.countDistinct("slot").alias("n_slots"))


def shard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2's rows with their sizes, each once."""
    return op2_sharding(spark, sf_dir).select("doc_id", "size", "law", "grown_shard")


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3's base columns."""
    return op3_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def lm_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4's fold, token counts and base score, rounded; the model bears on none of them and isn't trained."""
    return lm.base_scores(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def benchmark_overlap_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10's pairs and the length of their longest overlap."""
    return op10_decontamination(spark, sf_dir).select("doc_id", "item_id", "overlap_tokens")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACES = r"\x20\x09-\x0D"
_PII_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS (SELECT doc_id,
  regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS emails,
  list_filter(regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: len(list_filter(string_split(x, '.'), lambda p: coalesce(try_cast(p AS HUGEINT), 999) > 255)) = 0) AS ips,
  list_filter(list_transform(regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+'), lambda x: reverse(regexp_replace(x, '[\x20-]', '', 'g'))), lambda r: length(r) BETWEEN 12 AND 19
    AND list_sum(list_transform(range(0, length(r)), lambda i: (CASE WHEN i % 2 = 0 THEN substr(r, i + 1, 1)::INT WHEN substr(r, i + 1, 1)::INT > 4 THEN 2 * substr(r, i + 1, 1)::INT - 9 ELSE 2 * substr(r, i + 1, 1)::INT END))) % 10 = 0) AS cards,
  list_filter(regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 9 AND 15) AS phones FROM d)
SELECT doc_id, len(emails)::BIGINT AS n_email, len(ips)::BIGINT AS n_ip, len(cards)::BIGINT AS n_card, len(phones)::BIGINT AS n_phone FROM found
"""
_SHARD_SIZES_SQL = """
WITH n AS (SELECT count(*) AS rows_of FROM documents), shards AS (SELECT shard::INT AS shard, rows_of // 8 + (shard < rows_of % 8)::BIGINT AS n_rows FROM n, range(8) r(shard))
SELECT shard, n_rows, 0::BIGINT AS first_slot, n_rows - 1 AS last_slot, n_rows AS n_slots FROM shards WHERE n_rows > 0
"""
_SHARD_ROWS_SQL = "SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size, 'rows' AS law, NULL::INT AS grown_shard FROM documents"
_QUALITY_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^{_SPACES}]+') AS words FROM documents),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{_SPACES}]')) AS kept FROM w),
windows AS (SELECT doc_id, p, words[p : p + 4] AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1))) AS p FROM w)),
again AS (SELECT doc_id, p FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM again, range(5) r(k) GROUP BY doc_id),
base AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(kept) - len(list_distinct(kept)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w JOIN lines ON lines.doc_id = w.doc_id LEFT JOIN covered ON covered.doc_id = w.doc_id)
SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED_PERCENT} * n_words AS base_failed FROM base
"""
# The checksum is made bit by bit: a byte goes in at every eighth step.
_BIT = "(CASE WHEN j % 8 = 0 THEN xor(c, ascii(substr(id, (j // 8 + 1)::INT, 1))::BIGINT) ELSE c END)"
_LM_SQL = rf"""
WITH ids AS (SELECT doc_id, doc_id::VARCHAR AS id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^{_SPACES}]+') AS words FROM documents),
folds AS (SELECT doc_id, words, xor(list_reduce(range(0, 8 * length(id)), lambda c, j: xor({_BIT} >> 1, CASE WHEN {_BIT} % 2 = 1 THEN 3988292384 ELSE 0 END), 4294967295::BIGINT), 4294967295::BIGINT) % {lm.FOLDS} = {lm.HELD_OUT} AS held_out FROM ids),
tokens AS (SELECT doc_id, held_out, unnest(list_append(words, chr(10))) AS t FROM folds),
counts AS (SELECT t, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY t),
total AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM counts)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, n AS train_tokens, round(sum(log10((coalesce(c, 0) + 1)::DOUBLE / (n + v + 1))), 4) AS base_score
FROM tokens LEFT JOIN counts USING (t), total GROUP BY doc_id, held_out, n
"""
_OVERLAP_SQL = rf"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[\pL\pM\pN]+') AS ws FROM documents WHERE text IS NOT NULL),
items AS (SELECT min(item_id) AS item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[\pL\pM\pN]+') AS ws FROM benchmark WHERE text IS NOT NULL GROUP BY text),
x AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM words), y AS (SELECT item_id, unnest(ws) AS w, unnest(range(len(ws))) AS q FROM items),
equal AS (SELECT doc_id, item_id, p - q AS shift, p, row_number() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY p) AS r, count(*) OVER (PARTITION BY doc_id, item_id, p - q) AS n FROM x JOIN y USING (w) QUALIFY n >= 10),
stretches AS (SELECT a.doc_id, a.item_id, b.p - a.p + 1 AS tokens, b.r - a.r + 1 AS same FROM equal a JOIN equal b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND a.shift = b.shift AND b.p >= a.p + {decontaminate.MIN_OVERLAP - 1})
SELECT doc_id, item_id, max(tokens)::BIGINT AS overlap_tokens FROM stretches WHERE 5 * same >= 4 * tokens GROUP BY doc_id, item_id
"""
_LINES_SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l),
often AS (SELECT key AS shared FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= {line_dedup.LEAST_DOCS})
SELECT doc_id, count(*) AS n_lines, count(shared) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (shared IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN often ON shared = key GROUP BY doc_id
"""
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SEARCH_SQL = f"""
WITH x AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS w FROM documents WHERE text IS NOT NULL),
counts AS (SELECT doc_id, w, count(*) AS tf FROM x GROUP BY ALL), sizes AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id),
total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS all_terms FROM sizes), held AS (SELECT w, count(*) AS df FROM counts GROUP BY w),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS w FROM benchmark WHERE text IS NOT NULL),
weighed AS (SELECT item_id, w, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS weight FROM asked JOIN held USING (w), total),
scored AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // all_terms)))))::BIGINT AS score FROM weighed JOIN counts USING (w) JOIN sizes USING (doc_id), total GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= {lexical.BEST}
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_sharding": op2_sharding,
        "op3_quality": op3_quality,
        "op4_lm": op4_lm,
        "op5_simhash": op5_simhash,
        "op6_html": op6_html,
        "op7_subwords": op7_subwords,
        "op8_warc": op8_warc,
        "op9_urls": op9_urls,
        "op10_decontamination": op10_decontamination,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_line_dedup": op12_line_dedup,
        "op13_lexical": op13_lexical,
        "pii_base_counts": pii_base_counts,
        "shard_sizes": shard_sizes,
        "shard_rows": shard_rows,
        "quality_base_counts": quality_base_counts,
        "lm_base_counts": lm_base_counts,
        "benchmark_overlap_lengths": benchmark_overlap_lengths,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op8_warc": warc.oracle(),
        "op9_urls": urls.oracle(whole=True),
        "op12_line_dedup": _LINES_SQL,
        "op13_lexical": _SEARCH_SQL,
        "pii_base_counts": _PII_SQL,
        "shard_sizes": _SHARD_SIZES_SQL,
        "shard_rows": _SHARD_ROWS_SQL,
        "quality_base_counts": _QUALITY_SQL,
        "lm_base_counts": _LM_SQL,
        "benchmark_overlap_lengths": _OVERLAP_SQL,
    }
