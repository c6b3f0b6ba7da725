"""The registered queries of this subpackage, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .exact_dedup import exact_dedup
from .language_id import language_id
from .language_id import train as train_language
from .line_dedup import line_dedup
from .mixing import QUALITY_WEIGHTS, mix
from .pieces import encode
from .quality import quality_rules
from .quality import train as train_quality
from .secrets_scan import secret_spans
from .simhash import near_duplicates
from .substring_dedup import substring_dedup
from .token_counts import token_counts

#: Names of the vocabulary files the queries take; their folder is a parameter.
BPE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path(BPE_FILE))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), tokenizer_path(PIECE_FILE))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality_rules(docs, train_quality(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id(docs, train_language(docs))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def quality_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight): the sampling weight by quality label; of several labels of
    a document the best counts."""
    label = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return label.select("doc_id", F.when(F.col("quality") == 1, QUALITY_WEIGHTS[1]).when(F.col("quality") == 0, QUALITY_WEIGHTS[0]).otherwise(QUALITY_WEIGHTS[None]).alias("weight"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"), weights=quality_weights(table(spark, sf_dir, "labels")))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_simhash, op3_line_dedup, op4_token_counts, op5_secret_scan, op6_sentencepiece, op7_quality_rules, op8_language_id, op9_exact_dedup, op10_mixing)}


SQL = {
    "op3_line_dedup": r"""
WITH cells AS (
  SELECT page_id, coalesce(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS host,
    list_filter(list_transform(string_split(
      regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
        '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'),
        '(?i)</?(?:p|div|br|li|ul|ol|tr|td|table|nav|article|section|header|footer|h[1-6]|title|body|head|html)\b[^>]*>', chr(10), 'g'),
        '<[^>]*>', '', 'g'), chr(10)),
      lambda x: regexp_replace(x, '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g')), lambda x: x <> '') AS lines
  FROM pages),
counts AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM cells) GROUP BY host, line),
totals AS (SELECT host, count(*) AS pages FROM cells GROUP BY host),
boilerplate AS (SELECT host, list(line) AS drop FROM counts JOIN totals USING (host) WHERE n >= 2 AND n > 0.3 * pages GROUP BY host),
kept AS (SELECT page_id, host, lines, CASE WHEN drop IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(drop, x)) END AS kept
  FROM cells LEFT JOIN boilerplate USING (host))
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped,
  sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM kept""",
    "op9_exact_dedup": """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op10_mixing": r"""
WITH label AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END AS weight FROM documents LEFT JOIN label USING (doc_id)),
k AS (SELECT *, -ln((CAST(('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / weight::DOUBLE AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3]::DOUBLE AS weight, (2 * source_size)::DOUBLE AS cap,
    (1.5 * sum(source_size) OVER ())::DOUBLE AS total FROM s),
x AS (SELECT *, cap / weight AS stops_at FROM w),
y AS (SELECT *, (total - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM x WINDOW b AS (ORDER BY stops_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT min(level) FILTER (WHERE level <= stops_at AND stops_at = (SELECT min(stops_at) FROM y WHERE level <= stops_at)) AS level FROM y),
t AS (SELECT source, source_size, CASE WHEN l.level IS NULL THEN cap ELSE least(cap, weight * l.level) END AS target FROM y, l),
c AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
    sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST((epochs + CASE WHEN upto * 2 - size <= (target - epochs * source_size) * 2 THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM c""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
