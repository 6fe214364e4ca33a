"""One query per operator, with production parameters over the whole of its table, and SQL where it can be said in SQL."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneldrift.llm import chat, jaccard, knn, licenses, mixing, packing, periods, perplexity, quality, secrets, simple8b, warc, whitening
from paneldrift.session import shared_folder

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")

#: A conversation whose texts hold control strings of chat templates.
ODD_CHAT = (
    "SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') "
    "AS t(conv_id, turn, role, text)"
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(ODD_CHAT))
    # Every conversation goes through one of the layouts as a JSON record, and comes back by the record's own fingerprint.
    turns = chat.records_to_turns(chat.as_records(chat.to_turns(rows)))
    known = F.when(F.col("layout").isNotNull(), True).otherwise(F.raise_error(F.concat(F.lit("no layout: "), "record")).cast("boolean"))
    return chat.digests(chat.format_chats(turns.where(known)))


def op2_simple8b(spark: SparkSession, folder: str) -> DataFrame:
    files = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex}"
    simple8b.write_tokens(table(spark, folder, "documents"), files, WORDS, spaced=False, end_id=2)
    rows = simple8b.read_tokens(spark, files)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_curve_packing(spark: SparkSession, folder: str) -> DataFrame:
    rows = packing.pack(table(spark, folder, "documents"), BYTES, spaced=True, end_id=0)
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, folder, "documents"))


def op5_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    rows = mixing.shares(table(spark, folder, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_voronoi_knn(spark: SparkSession, folder: str) -> DataFrame:
    return knn.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_perplexity_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = perplexity.judged(table(spark, folder, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "bits", "least_bits", "most_bits")


def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digests(secrets.find_secrets(table(spark, folder, "documents")))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.digests(licenses.find_licenses(table(spark, folder, "documents")))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    rows = whitening.whiten(table(spark, folder, "embeddings"), components=8, scale=1024, shift=100_000)
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op12_warc(spark: SparkSession, folder: str) -> DataFrame:
    archive = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    files = warc.write_warc(table(spark, folder, "pages"), archive)
    return warc.digests(warc.read_warc(files, payloads=False))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periods.digests(periods.find_runs(periods.with_planted_runs(table(spark, folder, "documents"))))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}


SQL = {
    "op1_chat_formatting": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), c AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS trained,
    sum(8 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\<>[]', '', 'g'))) AS chars
  FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(trained) AS loss_chars, sha256(trained) AS loss_sha256,
  chars::BIGINT AS formatted_chars
FROM c""",
    "op5_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % 256 AS part
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight FROM s
), x AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, source IS NULL, source) AS i FROM w
), l AS (
  SELECT a.i, a.source, a.source_size, a.weight,
    ((SELECT sum(source_size) FROM x) - 3 * coalesce(sum(b.source_size), 0))::DOUBLE
      / ((SELECT sum(weight) FROM x) - coalesce(sum(b.weight), 0)) AS level
  FROM x a LEFT JOIN x b ON b.i < a.i GROUP BY ALL
), t AS (
  SELECT source, source_size, coalesce(least(
      (SELECT arg_min(level, i) FROM l WHERE level * weight <= 3 * source_size) * weight, 3.0::DOUBLE * source_size), 0) AS target
  FROM l
), n AS (
  SELECT d.*, source_size, target,
    row_number() OVER (PARTITION BY d.source ORDER BY
      length(bin(size)) * 16 + ((size >> greatest(length(bin(size)) - 5, 0)) & 15), part, size, doc_id NULLS FIRST) AS i,
    (('0x' || substr(md5('20240|' || coalesce(d.source, '')), 1, 8))::BIGINT % 1048576) / 1048576.0::DOUBLE AS u,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS e
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  size * least(floor(i * e + u)::BIGINT - floor((i - 1) * e + u)::BIGINT, 3) AS taken
FROM n""",
    "op6_voronoi_knn": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(list_inner_product(q.x, c.x))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, c.vec_id
), r AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5""",
    "op12_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), h AS (
  SELECT payload_digest, payload_bytes, max(page_id) AS head FROM p WHERE payload_bytes >= 1000 GROUP BY ALL
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id <> head THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to
FROM p LEFT JOIN h USING (payload_digest, payload_bytes)""",
    # Windows of six words that come again q words later, in unbroken rows: every run has one of six at least.
    "op13_periodic_runs": r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), h AS (
  SELECT *, len(words) AS n, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))) AS h FROM d
), a AS (
  SELECT *, (h // 10) % greatest(n, 1) AS a, h % 10 = 0 AND n > 0 AS planted FROM h
), p AS (
  SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a
), t AS (
  SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE words END AS w FROM p
), g AS (
  SELECT doc_id, i, hash(w[i + 1:i + 6]) AS gram FROM (SELECT doc_id, w, unnest(range(n - 5)) AS i FROM t WHERE n >= 12)
), e AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.gram = y.gram AND x.i < y.i
), s AS (
  SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e
), c AS (
  SELECT doc_id, q, min(i) AS start, count(*) + 5 + q AS length FROM s GROUP BY doc_id, q, island HAVING count(*) + 5 + q >= greatest(12, 2 * q)
), r AS (
  SELECT * FROM c WHERE NOT EXISTS (
    SELECT 1 FROM c b WHERE b.doc_id = c.doc_id AND b.q < c.q AND b.start <= c.start AND b.start + b.length >= c.start + c.length)
), k AS (
  SELECT doc_id, count(*) AS n_runs, max_by({start: start, length: length, period: q}, {l: length, s: -start, p: -q}) AS top,
    string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS told,
    list_sort(list({a: start + q, b: start + length})) AS gone
  FROM r GROUP BY doc_id
), o AS (
  SELECT doc_id, list_distinct(flatten(list_transform(gone, lambda x: range(x.a, x.b)))) AS dropped FROM k
), l AS (
  SELECT t.doc_id, coalesce(string_agg(word, ' ' ORDER BY i), '') AS left_words
  FROM (SELECT t.doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM t JOIN o USING (doc_id)) t
  LEFT JOIN (SELECT doc_id, unnest(dropped) AS i, 1 AS out FROM o) u USING (doc_id, i)
  WHERE u.out IS NULL GROUP BY t.doc_id
)
SELECT t.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top.start::BIGINT AS start, top.length::BIGINT AS length, top.period::BIGINT AS period,
  (1000 * top.length // top.period)::BIGINT AS exponent_milli, sha256(coalesce(told, '')) AS runs_sha256,
  sha256(CASE WHEN k.doc_id IS NULL THEN array_to_string(w, ' ') ELSE coalesce(left_words, '') END) AS collapsed_sha256
FROM t LEFT JOIN k USING (doc_id) LEFT JOIN l USING (doc_id)""",
}


def oracle() -> dict[str, str]:
    return dict(SQL)
