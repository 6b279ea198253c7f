"""The ten operators as queries over the test tables, with production parameters, and SQL where SQL can tell the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language, packing, passages, quality, sentencepieces, simhash, token_counts, token_files, topk, toxicity
from tessera.llm.common import id_remainder, table


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole text encoded and decoded again, summed up."""
    return sentencepieces.digests(table(spark, sf_dir, "documents"), vocabulary(PIECE_BPE))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 3-word shingles and components at distance 2."""
    return simhash.components(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids; a null text is empty."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE), end_id=1)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read back from Simple-8b shards in ascending order of ids."""
    return token_files.round_trip(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE), end_id=2)


def op5_bitsliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best others of every fiftieth vector."""
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by a field fitted on the rows that may be learnt from; a null id counts as one of them and is not held out."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(documents, labels, learn=id_remainder("doc_id", 4) != 2)
    scored = toxicity.scored(documents, model, threshold=0.3)
    return scored.select("doc_id", F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op7_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdicts by lines that stand in many documents of a host."""
    return quality.judged(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages by models fitted on the rows that may be learnt from."""
    documents = table(spark, sf_dir, "documents")
    models = language.train(documents, learn=id_remainder("doc_id", 3) != 1)
    found = language.identified(documents, models)
    return found.select("doc_id", F.coalesce(id_remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each text without repeated lines and passages, with the removed spans."""
    return passages.removals(table(spark, sf_dir, "documents"))


def op10_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of encoded lengths with its suffix sums."""
    return token_counts.histogram(token_counts.lengths(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE)))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_simhash, op3_packing, op4_token_files, op5_bitsliced_topk, op6_toxicity, op7_line_frequency, op8_language, op9_substring_dedup, op10_length_histogram)}

OP5_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS r, CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.r <> c.r WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, text IS NULL AS nothing, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT r, i, list_aggregate(w[i:i + 2], 'string_agg', ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), twins AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1
), places AS (
  SELECT DISTINCT r, unnest([i, i + 1, i + 2]) AS p FROM twins
), repeats AS (
  SELECT r, count(*) AS n FROM places GROUP BY r
), l AS (
  SELECT r, doc_id, source, regexp_replace(regexp_replace(lower(trim(line)), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g') AS line,
    len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n
  FROM (SELECT r, doc_id, source, unnest(lines) AS line FROM d)
), hosts AS (
  SELECT source, count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), '')) AS n_host FROM d WHERE NOT nothing GROUP BY source
), boilerplate AS (
  SELECT c.source, c.line FROM (SELECT source, line, count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), '')) AS n FROM l GROUP BY source, line) c
  JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source WHERE c.n > 20 AND (c.n > h.n_host * 0.02 OR c.n > 1000)
), gone AS (
  SELECT l.r, sum(l.n) AS n FROM l JOIN boilerplate b ON l.source IS NOT DISTINCT FROM b.source AND l.line = b.line GROUP BY l.r
), counted AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS removed_words
  FROM d LEFT JOIN repeats USING (r) LEFT JOIN gone USING (r)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words - removed_words >= 0.5 * n_words AS kept, removed_words
FROM judged
"""

ORACLES = {"op5_bitsliced_topk": OP5_SQL, "op7_line_frequency": OP7_SQL}
