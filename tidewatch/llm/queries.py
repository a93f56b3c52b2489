"""The dealt queries: thin digests of the operators over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import (
    byte_bpe,
    decontaminate,
    jaccard,
    languages,
    lexical,
    licenses,
    neighbours,
    prefix_trie,
    quality,
    secrets,
    substrings,
    token_counts,
    toxicity,
)
from tidewatch.llm.common import crc_remainder, table


def op1_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    return secret_digest(table(spark, folder, "documents"))


def secret_digest(docs: DataFrame) -> DataFrame:
    """Counts and hash of the base spans, and all spans as text."""
    base = [r.kind for r in secrets.BASE]

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"], s["last"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    own = F.filter("spans", lambda s: s["kind"].isin(*base))
    return secrets.scan(docs).select(
        "doc_id",
        *map(count, base),
        F.sha2(written(own).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def op2_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents")).drop("found")


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    net = quality.fit(quality.training_rows(docs, table(spark, folder, "labels")))
    held_out = F.coalesce(crc_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return quality.score(docs, net).select("doc_id", held_out, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substrings.kept_words(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.classes(table(spark, folder, "documents")).drop("text_hash")


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, folder, "labels")))
    held_out = F.coalesce(crc_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), every=20, k=20)


def op8_byte_level_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, folder, "documents")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(docs, path, public_tokenizers.PATTERN).drop("lossless")


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = languages.fit(languages.training_rows(docs))
    held_out = F.coalesce(crc_remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return languages.identify(docs, model).select("doc_id", held_out, "lang_pred", "score")


def op10_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, benchmark = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return decontaminate.contaminated(docs, benchmark).drop("text_hash")


def op11_conversation_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))


def op12_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op13_ranked_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=20)


#: crc32 of a text bit by bit, lowest bit first; 3988292384 is the reversed polynomial.
PREFIX_TRIE_SQL = """
WITH RECURSIVE crc AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR) AS digits, 0 AS bit, CAST(4294967295 AS BIGINT) AS state
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
  UNION ALL
  SELECT conv_id, digits, bit + 1,
    xor(state >> 1, 3988292384 * (xor(state, CAST(ascii(substr(digits, 1 + bit // 8, 1)) AS BIGINT) >> (bit % 8)) & 1))
  FROM crc WHERE bit < 8 * length(digits)
),
heads AS (SELECT conv_id, xor(state, 4294967295) % 4 AS h FROM crc WHERE bit = 8 * length(digits)),
own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
),
both_parts AS (
  SELECT heads.conv_id, 0 AS segment, place, role, text
  FROM heads JOIN own ON own.conv_id = heads.conv_id - heads.conv_id % 20 AND place <= h
  UNION ALL
  SELECT own.conv_id, 1, place, role, text FROM heads JOIN own ON own.conv_id = heads.conv_id AND place > h
),
turns AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY segment, place) AS depth FROM both_parts
),
visits AS (
  SELECT conv_id, 0 AS depth, '' AS path, 0 AS tokens FROM heads
  UNION ALL
  SELECT conv_id, depth,
    string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY conv_id ORDER BY depth),
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))
  FROM turns
),
nodes AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, max(tokens) AS tokens FROM visits GROUP BY depth, path
),
lengths AS (SELECT conv_id, max(depth) AS depth FROM visits GROUP BY conv_id),
ends AS (
  SELECT v.depth, v.path, sha256(string_agg(CAST(v.conv_id AS VARCHAR), ',' ORDER BY v.conv_id)) AS ends_sha256
  FROM visits v JOIN lengths l ON v.conv_id = l.conv_id AND v.depth = l.depth GROUP BY v.depth, v.path
),
parents AS (
  SELECT n.depth, n.path, p.conv_id AS parent_conv_id
  FROM nodes n JOIN visits v ON v.conv_id = n.conv_id AND v.depth = n.depth - 1
  JOIN nodes p ON p.depth = v.depth AND p.path = v.path
),
children AS (
  SELECT v.depth, v.path, count(*) AS n_children
  FROM nodes n JOIN visits v ON v.conv_id = n.conv_id AND v.depth = n.depth - 1 GROUP BY v.depth, v.path
),
sized AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.depth = n.depth AND c.path = n.path),
totals AS (
  SELECT v.depth, v.path, count(*) FILTER (d.n_children = 0) AS n_leaves, sum((d.n_convs - 1) * d.tokens) AS saved_tokens
  FROM sized d JOIN visits v ON v.conv_id = d.conv_id AND v.depth <= d.depth GROUP BY v.depth, v.path
)
SELECT s.conv_id, CAST(s.depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM sized s
JOIN totals t ON t.depth = s.depth AND t.path = s.path
LEFT JOIN parents p ON p.depth = s.depth AND p.path = s.path
LEFT JOIN ends e ON e.depth = s.depth AND e.path = s.path
"""

LEXICAL_SQL = """
WITH folded AS (
  SELECT row_number() OVER () AS row_no, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
),
sizes AS (SELECT row_no, doc_id, coalesce(len(terms), 0) AS n FROM folded),
corpus AS (SELECT count(*) FILTER (n > 0) AS total_n, CAST(sum(n) AS BIGINT) AS total_l FROM sizes),
items AS (
  SELECT row_number() OVER () AS item_no, item_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM (SELECT DISTINCT item_id, text FROM benchmark)
),
asked AS (SELECT item_no, item_id, term, count(*) AS times FROM (SELECT item_no, item_id, unnest(terms) AS term FROM items) GROUP BY ALL),
vocabulary AS (SELECT DISTINCT term FROM asked),
postings AS (
  SELECT row_no, term, count(*) AS tf FROM (SELECT row_no, unnest(terms) AS term FROM folded)
  WHERE term IN (SELECT term FROM vocabulary) GROUP BY row_no, term
),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * total_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM postings, corpus GROUP BY term, total_n
),
scores AS (
  SELECT item_no, item_id, s.row_no, s.doc_id,
    sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * total_n) // total_l)))) AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN sizes s USING (row_no), corpus
  GROUP BY item_no, item_id, s.row_no, s.doc_id
),
places AS (
  SELECT item_id, doc_id, score,
    row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id NULLS LAST) AS place
  FROM scores WHERE score > 0
)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM places WHERE place <= 20
"""


QUERIES = {
    "op1_secret_scans": op1_secret_scans,
    "op2_license_scans": op2_license_scans,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_toxicity": op6_toxicity,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_byte_level_bpe": op8_byte_level_bpe,
    "op9_language_id": op9_language_id,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_conversation_prefix_trie": op11_conversation_prefix_trie,
    "op12_token_counts": op12_token_counts,
    "op13_ranked_lexical_search": op13_ranked_lexical_search,
}
#: What SQL can express; the others are tested against brute force, round trips and held-out rows.
ORACLES: dict[str, str] = {"op11_conversation_prefix_trie": PREFIX_TRIE_SQL, "op13_ranked_lexical_search": LEXICAL_SQL}
