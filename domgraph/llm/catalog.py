"""The queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from domgraph.llm import decontaminate, langid, line_dedup, media, mixture, secrets, simhash, span_dedup, token_output, toxicity

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
TOXIC_FROM = 0.3


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_output.encode_and_digest(_documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), end_id=END_ID)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents: doc_id, held_out, lang_pred, score."""
    docs = _documents(spark, sf_dir)
    found = langid.identify(docs, langid.train(docs, _remainder(3) != 1))
    return found.select("doc_id", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: doc_id, counts by kind, base_sha256, spans, and how many are live or copied."""
    return secrets.scan(_documents(spark, sf_dir))


def op4_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target, taken."""
    return mixture.mix(_documents(spark, sf_dir))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media of all documents, stored and read back: doc_id, sizes, digests and a feature string."""
    return media.store_and_describe(_documents(spark, sf_dir))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of documents that repeat a benchmark item: doc_id, item_id, start, end, edits, item_chars."""
    return decontaminate.contaminated_regions(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup leaves of each document: doc_id, n_lines, n_dropped, kept_sha256."""
    return line_dedup.dedup_digests(_documents(spark, sf_dir), least_chars=10)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents: doc_id, fingerprint, component_id."""
    return simhash.near_duplicates(_documents(spark, sf_dir), words_in_shingle=3, budget=2)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents: doc_id, held_out, score, predicted."""
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = toxicity.score(docs, toxicity.train(docs, labels, _remainder(4) != 2))
    return scores.select(
        "doc_id",
        F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
    )


def op10_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that lose repeated passages: doc_id, n_sentences, n_removed, removed, kept_sha256."""
    return span_dedup.dedup(_documents(spark, sf_dir), changed_only=True, digest=True)


QUERIES = {
    "op1_token_output": op1_token_output,
    "op2_langid": op2_langid,
    "op3_secrets": op3_secrets,
    "op4_mixture": op4_mixture,
    "op5_media": op5_media,
    "op6_decontaminate": op6_decontaminate,
    "op7_line_dedup": op7_line_dedup,
    "op8_simhash": op8_simhash,
    "op9_toxicity": op9_toxicity,
    "op10_span_dedup": op10_span_dedup,
}

def _matches_sql(pattern: str, group: int, rank: int) -> str:
    quoted = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT rn, {rank} AS rank, string_split_regex(text, {quoted}) AS pieces, regexp_extract_all(text, {quoted}, 0) AS found,
    regexp_extract_all(text, {quoted}, {group}) AS vals FROM texts"""


_SECRETS_SQL = f"""
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS rn, doc_id, source, coalesce(text, '') AS text FROM documents
), cut AS (
  {_matches_sql(secrets.ASSIGN, 2, 0)} UNION ALL {_matches_sql(secrets.ACCESS, 0, 1)}
  UNION ALL {_matches_sql(secrets.HEX, 0, 2)} UNION ALL {_matches_sql(secrets.LONG, 0, 3)}
), numbered AS (SELECT *, unnest(range(1, len(found) + 1)) AS k FROM cut WHERE len(found) > 0
), placed AS (
  SELECT rn, rank, vals[k] AS value, length(found[k]) AS size,
    list_sum(list_transform(pieces[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x))), 0) AS start
  FROM numbered
), spans AS MATERIALIZED (
  SELECT rn, rank, start::BIGINT AS start, (start + size)::BIGINT AS stop, value FROM placed
  WHERE rank IN (1, 2) OR rank = 0 AND length(value) >= {secrets.ASSIGN_LEAST}
     OR rank = 3 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')
), candidates AS MATERIALIZED (
  SELECT * FROM spans s WHERE rank < 3
     OR NOT EXISTS (SELECT 1 FROM spans b WHERE b.rank < 3 AND b.rn = s.rn AND b.start < s.stop AND s.start < b.stop)
), counted AS (
  SELECT value, count(DISTINCT coalesce(source, chr(0))) AS n_owners, count(DISTINCT (coalesce(source, chr(0)), coalesce(doc_id::VARCHAR, ''))) AS n_repositories
  FROM candidates JOIN texts USING (rn) GROUP BY value
), judged AS (
  SELECT c.*, n_owners <= 1 AND n_repositories <= 3 AS live, ['assign', 'access', 'hex', 'owned'][rank + 1] || ':' || start || ':' || stop AS said
  FROM candidates c JOIN counted USING (value)
)
SELECT any_value(t.doc_id) AS doc_id, coalesce(count_if(rank = 0), 0)::BIGINT AS n_assign, coalesce(count_if(rank = 1), 0)::BIGINT AS n_access, coalesce(count_if(rank = 2), 0)::BIGINT AS n_hex,
  sha256(coalesce(string_agg(said, ',' ORDER BY start, rank) FILTER (rank < 3), '')) AS base_sha256,
  coalesce(string_agg(said, ',' ORDER BY start, rank) FILTER (rank < 3 OR live), '') AS spans,
  coalesce(count_if(rank = 3 AND live), 0)::BIGINT AS n_owned, coalesce(count_if(live), 0)::BIGINT AS n_live, coalesce(count_if(NOT live), 0)::BIGINT AS n_copied
FROM texts t LEFT JOIN judged j ON j.rn = t.rn GROUP BY t.rn
"""

ORACLES: dict[str, str] = {
    "op3_secrets": _SECRETS_SQL,
    # A source's blocks are taken in turn, so its words are taken whole rounds and then from the first on.
    "op4_mixture": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix' || coalesce(doc_id::VARCHAR, '') || md5(coalesce(text, ''))) AS key FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         3.0::DOUBLE * source_size AS most
  FROM sources
), filled AS (
  SELECT *, most / weight AS full_at,
         (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
  FROM weighed
), targets AS (
  SELECT source, source_size, round(least(most, weight * (SELECT arg_min(rate, full_at) FROM filled WHERE rate <= full_at)), 6) AS target FROM filled
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM sized
)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE (round(target)::BIGINT // source_size) * size
         + greatest(0, least(place + size, round(target)::BIGINT % source_size) - place) END::BIGINT AS taken
FROM placed JOIN targets ON placed.source IS NOT DISTINCT FROM targets.source
""",
    "op7_line_dedup": r"""
WITH numbered AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM numbered
), owners AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT keyed.*, owner IS NOT NULL AND doc_id <> owner AS dropped FROM keyed LEFT JOIN owners USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
}
