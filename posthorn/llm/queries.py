"""The queries of this subpackage: op1_ to op10_ and the pipeline, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posthorn.llm import html_text, media, mixing, pii, piece_bpe, quality_qda, quality_rules, secrets, simhash, url_filters


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and verdict for every document."""
    led = quality_rules.ledger(_table(spark, sf_dir, "documents"))
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.passes("base")).alias("base_failed"),
        quality_rules.passes(quality_rules.CURRENT).alias("kept"),
        "fail_bits",
    )


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each rule of the current policy: documents that fail it, and those that it alone rejects, from the ledger's bits."""
    return quality_rules.ablations(quality_rules.ledger(_table(spark, sf_dir, "documents")))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by pseudonyms, and how many of each kind."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, counts=True)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    sized = mixing.measured(_table(spark, sf_dir, "documents"))
    return mixing.mix(sized).select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken", "copies", F.get("slots", F.lit(0)).alias("first_slot"), "source")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document; sources are owners and documents are repositories."""
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an image in an archive, read back, with digests and a feature."""
    return media.text_media(_table(spark, sf_dir, "documents"))


def model_file() -> str:
    """The place of the vocabulary file, which belongs to the machine and not to this repository."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text that they decode to, as digests."""
    return piece_bpe.encode(_table(spark, sf_dir, "documents"), model_file())


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict for the url of every page."""
    return url_filters.judge(_table(spark, sf_dir, "pages"), url_filters.listed_frame(spark))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, by a model of the labels that are not held out."""
    return quality_qda.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_mixing": op2_mixing,
    "op3_secrets": op3_secrets,
    "op4_media": op4_media,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_url_filter": op6_url_filter,
    "op7_quality": op7_quality,
    "op8_simhash": op8_simhash,
    "op9_html_text": op9_html_text,
    "op10_quality_rules": op10_quality_rules,
    "quality_ablations": quality_ablations,
}

ORACLE: dict[str, str] = {}

_BITS = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), win AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3) x
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) y WHERE c >= 2
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, i AS p FROM dup UNION ALL SELECT doc_id, i + 1 FROM dup UNION ALL SELECT doc_id, i + 2 FROM dup) z
  GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM (
    SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) q
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]')
  GROUP BY doc_id
), m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
    CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
    length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS n_letters
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id LEFT JOIN lines ON lines.doc_id = w.doc_id
), b AS (
  SELECT *,
    CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
    + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 40 * n_words THEN 16 ELSE 0 END
    + CASE WHEN n_letters >= 100 AND 100 * n_upper > 60 * n_letters THEN 32 ELSE 0 END AS bits
  FROM m
)
"""

ORACLE["op10_quality_rules"] = _BITS + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, bits = 0 AS kept, CAST(bits AS BIGINT) AS fail_bits
FROM b
"""

ORACLE["quality_ablations"] = _BITS + """
SELECT rule, CAST(count(*) FILTER (bits & bit <> 0) AS BIGINT) AS n_failed, CAST(count(*) FILTER (bits = bit) AS BIGINT) AS n_only
FROM b, (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('repeated_lines', 8), ('long_words', 16), ('shouting', 32)) r(rule, bit)
GROUP BY rule
"""

ORACLE["op6_url_filter"] = f"""
WITH u AS (
  SELECT page_id,
    coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '') AS raw,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*(/[^?#]*)', 1, 's'), '') AS path
  FROM pages
), h AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule,
    ({" OR ".join(f"host = '{k}' OR host LIKE '%.{k}'" for k in url_filters.LISTED)}) AS listed
  FROM h
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM r
"""
