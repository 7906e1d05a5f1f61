"""The registered queries of the operators for training data, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import bpe, collocations, decontaminate, fim, forest, jaccard, lines, quality, sharding, tokenfiles, topk, toxicity, warc
from auditlake.llm.shared import read_table

# Where the vocabulary files lie; they are a parameter of the operators.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
# The id that ends each document of a token file.
END_ID = 2
SHARDS = 8


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard_documents(read_table(spark, sf_dir, "documents"), SHARDS)
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(read_table(spark, sf_dir, "pages"))
    return warc.read_pages(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").withColumn(
        "vector", F.transform("embedding", lambda x: F.floor(x.cast("double") * 64).cast("double"))
    )
    return topk.search(vectors, F.col("vec_id") % 20 == 0, 20)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    # A row without an id is in no third, so never held out.
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out)
    grammar = toxicity.learn(documents, labels)
    scored = toxicity.score(documents.withColumn("held_out", held_out), grammar).drop("text")
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read_table(spark, sf_dir, "documents"))


def ratings(labels: DataFrame) -> DataFrame:
    """Grades that labels give."""
    return labels.select("doc_id", quality.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(documents, ratings(read_table(spark, sf_dir, "labels")), 3)
    rated = quality.rate(documents, model, 1)
    return rated.withColumn("keep", F.col("tail_probability") >= 0.5).drop("text")


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(documents).select("doc_id", "n_lines", "n_dropped", "text")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.with_leaks(documents, read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.round_trip(documents, BYTE_BPE))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    files = tokenfiles.write(documents, WORD_BPE, END_ID)
    found = tokenfiles.fetch(files, documents.select("doc_id").distinct())
    return found.withColumn("ids_crc32", F.crc32("ids")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return fim.round_trip(documents).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        fim.digest("output").alias("output_sha256"), fim.digest("restored").alias("restored_sha256"),
    )


def op12_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    held = forest.index(vectors, 5, vector="embedding")
    return forest.search(held, vectors.filter(F.col("vec_id") % 50 == 0), 5, vector="embedding")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read_table(spark, sf_dir, "documents"), "lang", "text", 2000, 10, 50)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # which itself takes parameters from this module

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_warc": op2_warc,
    "op3_topk": op3_topk,
    "op4_toxicity": op4_toxicity,
    "op5_jaccard": op5_jaccard,
    "op6_quality": op6_quality,
    "op7_bpe": op7_bpe,
    "op8_lines": op8_lines,
    "op9_decontaminate": op9_decontaminate,
    "op10_token_files": op10_token_files,
    "op11_fim": op11_fim,
    "op12_forest": op12_forest,
    "op13_collocations": op13_collocations,
    "pipeline": pipeline,
}

OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS DOUBLE)) AS a
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.a, c.a) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

OP2_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), h AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS holder FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND holder <> page_id THEN holder END AS refers_to
FROM h
"""

OP11_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), g AS (
  SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS c2,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT *, substring(t, 1, least(c1, c2)) AS pre, substring(t, least(c1, c2) + 1, greatest(c1, c2) - least(c1, c2)) AS mid,
    substring(t, greatest(c1, c2) + 1) AS suf
  FROM g
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(least(c1, c2) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(greatest(c1, c2) - least(c1, c2) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""

OP13_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), sequences AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces
), places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM sequences
), runs AS (
  SELECT lang, w[i] AS a1, CASE WHEN i + 1 <= len(w) THEN w[i + 1] END AS a2, CASE WHEN i + 2 <= len(w) THEN w[i + 2] END AS a3 FROM places
), f1 AS (SELECT lang, a1, count(*) AS f FROM runs GROUP BY ALL),
f2 AS (SELECT lang, a1, a2, count(*) AS f FROM runs WHERE a2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, a1, a2, a3, count(*) AS f FROM runs WHERE a3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
totals AS (SELECT lang, count(*) AS n FROM runs GROUP BY lang),
cuts AS (
  SELECT b.lang, b.a1 || ' ' || b.a2 AS phrase, b.f AS a, 1 AS k, l.f AS l, r.f AS r
  FROM f2 b JOIN f1 l ON l.lang = b.lang AND l.a1 = b.a1 JOIN f1 r ON r.lang = b.lang AND r.a1 = b.a2
  WHERE b.f >= 10 AND NOT EXISTS (
    SELECT 1 FROM f3 c WHERE c.lang = b.lang AND (c.a1 = b.a1 AND c.a2 = b.a2) AND 100 * c.f >= 50 * b.f
  ) AND NOT EXISTS (
    SELECT 1 FROM f3 c WHERE c.lang = b.lang AND (c.a2 = b.a1 AND c.a3 = b.a2) AND 100 * c.f >= 50 * b.f
  )
  UNION ALL
  SELECT t.lang, t.a1 || ' ' || t.a2 || ' ' || t.a3, t.f, 1, l.f, r.f
  FROM f3 t JOIN f1 l ON l.lang = t.lang AND l.a1 = t.a1 JOIN f2 r ON r.lang = t.lang AND r.a1 = t.a2 AND r.a2 = t.a3
  UNION ALL
  SELECT t.lang, t.a1 || ' ' || t.a2 || ' ' || t.a3, t.f, 2, l.f, r.f
  FROM f3 t JOIN f2 l ON l.lang = t.lang AND l.a1 = t.a1 AND l.a2 = t.a2 JOIN f1 r ON r.lang = t.lang AND r.a1 = t.a3
), scored AS (
  SELECT *, CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest
)
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

ORACLE: dict[str, str] = {"op2_warc": OP2_SQL, "op3_topk": OP3_SQL, "op11_fim": OP11_SQL, "op13_collocations": OP13_SQL}
