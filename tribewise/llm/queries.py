"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op1_lines, op2_sharding, op3_nndescent, op4_warc, op5_substring, op6_wavelet, op7_sentencepiece, op8_quality, op9_minhash, op10_decontaminate, op11_collocations, op12_packing, op13_resampling
from .common import table

PIECE_MODEL = os.environ.get("TRIBEWISE_PIECE_MODEL") or public_tokenizers.path("piece_bpe_32k.model")
BYTE_MODEL = os.environ.get("TRIBEWISE_BYTE_MODEL") or public_tokenizers.path("byte_bpe_50k.json")
WORD_MODEL = os.environ.get("TRIBEWISE_WORD_MODEL") or public_tokenizers.path("word_bpe_49k.json")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


LINES_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents),
elements AS (
  SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p,
         greatest(17, length(t) - length(replace(t, ' ', '')) + 1, length(t) // 10) AS w
  FROM (SELECT *, trim(line, ' ') AS t FROM lines) WHERE t <> ''),
triples AS (
  SELECT a.doc_id, a.p AS s, a.line AS la, b.line AS lb, c.line AS lc, a.i AS ia, b.i AS ib, c.i AS ic, a.w AS wa, b.w AS wb, c.w AS wc
  FROM elements a
  LEFT JOIN elements b ON b.doc_id = a.doc_id AND b.p = a.p + 1
  LEFT JOIN elements c ON c.doc_id = a.doc_id AND c.p = a.p + 2),
windows AS (
  SELECT doc_id, s, la, NULL AS lb, NULL AS lc, ia, NULL AS ib, NULL AS ic FROM triples WHERE wa >= 50
  UNION ALL
  SELECT doc_id, s, la, lb, NULL, ia, ib, NULL FROM triples WHERE wa + wb >= 50 AND (wa < 50 OR wb < 50)
  UNION ALL
  SELECT doc_id, s, la, lb, lc, ia, ib, ic FROM triples WHERE wa + wb + wc >= 50 AND (wa + wb < 50 OR wb + wc < 50)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY la, lb, lc ORDER BY doc_id, s) AS r FROM windows),
gone AS (
  SELECT DISTINCT doc_id, unnest([ia, ib, ic]) AS i FROM ranked WHERE r > 1),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
         string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL) AS body
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed,
       sha256(coalesce(k.body, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


@query("op1_line_dedup", LINES_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return op1_lines.deduplicated(docs).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.encode(F.coalesce("deduped", F.lit("")), "utf-8"), 256).alias("kept_sha256"))


@query("op2_sharding")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op2_sharding.sharded(table(spark, sf_dir, "documents"))
    return rows.withColumn("grown_shard", F.lit(None).cast("int")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "virtual_slot", "map_version")


@query("op3_nn_descent")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_nndescent.neighbours(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


@query("op4_warc")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


REPEATS_SQL = """
WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS ws FROM documents),
words AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p, len(ws) AS n FROM split),
windows AS (
  SELECT doc_id, word, p, n, CASE WHEN p + 34 <= n THEN md5(string_agg(word, ' ') OVER (
    PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) END AS h FROM words),
starts AS (
  SELECT *, CASE WHEN h IS NOT NULL AND count(*) OVER (PARTITION BY h) > 1 THEN 1 ELSE 0 END AS twice FROM windows),
covered AS (
  SELECT *, max(twice) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM starts),
kept AS (
  SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed,
         string_agg(word, ' ' ORDER BY p) FILTER (WHERE gone = 0) AS body FROM covered GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


@query("op5_substring", REPEATS_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_substring.deduplicated(table(spark, sf_dir, "documents"), texts_out=False)


@query("op6_wavelet")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_wavelet.round_trip(table(spark, sf_dir, "documents"), BYTE_MODEL)


@query("op7_sentencepiece")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_sentencepiece.digests(table(spark, sf_dir, "documents"), PIECE_MODEL)


def learning_labels(labels: DataFrame) -> DataFrame:
    """Labels that a classifier may learn from; the others are held out."""
    return labels.filter(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 3 != 1)


@query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = op8_quality.train(docs, learning_labels(table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 3 == 1, F.lit(False))
    return op8_quality.score(docs, model).select(
        "doc_id", held.alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


@query("op10_decontaminate")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


NEAR_SQL = """
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') AS ws FROM documents),
words AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p, len(ws) AS n FROM split),
pairs AS (
  SELECT doc_id, n, p, word, lead(word) OVER (PARTITION BY doc_id ORDER BY p) AS after FROM words),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN n = 1 THEN word ELSE word || ' ' || after END AS g FROM pairs WHERE n = 1 OR after IS NOT NULL),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * k >= 80 * (s.n + t.n - k)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, e.y FROM reach r JOIN edges e ON e.x = r.b)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id
"""


@query("op9_minhash", NEAR_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_minhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "kept")


PHRASES_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
split AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (
    SELECT lang, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM split, (SELECT unnest([1, 2, 3]) AS k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
total AS (SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang),
cuts AS (
  SELECT lang, k, phrase, f AS a, c, array_to_string(string_split(phrase, ' ')[:c], ' ') AS x, array_to_string(string_split(phrase, ' ')[c + 1:], ' ') AS y
  FROM f, (SELECT unnest([1, 2]) AS c) WHERE c < k),
scores AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, a, c, l.f AS l, r.f AS r,
         CAST((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y),
best AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
cover AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS phrase
    FROM f WHERE k = 3) GROUP BY ALL),
kept AS (
  SELECT best.* FROM best LEFT JOIN cover ON cover.lang = best.lang AND cover.phrase = best.phrase
  WHERE cover.f IS NULL OR 100 * cover.f < 50 * a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total ON total.lang = ranked.lang WHERE rank <= 2000
"""


@query("op11_collocations", PHRASES_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_collocations.collocations(table(spark, sf_dir, "documents"))


@query("op12_best_fit")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_packing.pack(table(spark, sf_dir, "documents"), WORD_MODEL, ids_out=False).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


RESAMPLE_SQL = """
WITH crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i], range(8)), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
    FROM (SELECT unnest(range(256)) AS i))),
texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
words AS (
  SELECT kind, id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')) AS word FROM texts),
coded AS (
  SELECT word, xor(list_reduce(list_concat([4294967295], list_transform(range(len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT))),
    lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM words)), crc),
features AS (SELECT kind, id, bucket FROM words JOIN coded ON coded.word = words.word),
counts AS (
  SELECT bucket, count(*) FILTER (WHERE kind = 'd') AS s, count(*) FILTER (WHERE kind = 'b') AS t FROM features GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000))::DOUBLE / ((s + 1) * (sum(t) OVER () + 10000))::DOUBLE)) AS BIGINT) AS gain FROM counts),
weights AS (
  SELECT id, count(*) AS n, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight
  FROM features JOIN gains ON gains.bucket = features.bucket WHERE kind = 'd' GROUP BY id),
scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || doc_id)[:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM documents LEFT JOIN weights ON id = doc_id),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT scored.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked ON ranked.doc_id = scored.doc_id
"""


@query("op13_resampling", RESAMPLE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
