"""One query for each operator of this subpackage, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm import transport
from umbra.llm.chat import format_chats
from umbra.llm.decontamination import leaks
from umbra.llm.langid import identify_languages, train_languages
from umbra.llm.licenses import scan_licenses
from umbra.llm.minhash import near_duplicates
from umbra.llm.mixing import mix_copies
from umbra.llm.quality import score_quality
from umbra.llm.substring_dedup import substring_dedup
from umbra.llm.toxicity import fit_rows, score_toxicity, train_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"), full=False)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), width=4)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = fit_rows("doc_id", 5, 0)
    scored = score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), learn)
    return scored.select("doc_id", (~learn).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = mix_copies(_table(spark, sf_dir, "documents"))
    return kept.select("row.doc_id", "row.source", "row.lang", "topic", F.col("tokens").alias("n_tokens"), F.round("expected", 6).alias("expected"), "copies")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    learn = fit_rows("doc_id", 5, 0)
    return identify_languages(docs, train_languages(docs, learn)).select("doc_id", (~learn).alias("held_out"), "lang_pred", "score")


def op7_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = transport.store(_table(spark, sf_dir, "documents"))
    columns = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    return transport.read(stored).select(*columns)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(_table(spark, sf_dir, "conversations"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    learn = fit_rows("doc_id", 3, 1)
    scored = score_toxicity(docs, train_toxicity(docs, _table(spark, sf_dir, "labels"), learn))
    return scored.select("doc_id", (~learn).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (
  SELECT doc_id, i, list_slice(words, i, i + 12) AS seq
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)),
least AS (SELECT seq, min(doc_id) AS first_doc FROM win GROUP BY seq),
hit AS (
  SELECT DISTINCT win.doc_id, unnest(range(i, i + 13)) AS p
  FROM win JOIN least USING (seq) WHERE win.doc_id > first_doc),
gone AS (SELECT doc_id, list(p) AS ps FROM hit GROUP BY doc_id),
kept AS (
  SELECT w.doc_id, len(words) AS n_words, coalesce(len(ps), 0) AS n_removed,
         CASE WHEN ps IS NULL THEN words
              ELSE list_filter(list_transform(range(1, len(words) + 1), lambda i: CASE WHEN list_contains(ps, i) THEN NULL ELSE words[i] END), lambda x: x IS NOT NULL) END AS k
  FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed,
       sha256(array_to_string(k, ' ')) AS kept_sha256
FROM kept
"""

OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 3), ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n
  HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(node, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT e.v, r.root FROM reach r JOIN both_ways e ON e.u = r.node WHERE e.v > r.root),
c AS (SELECT node AS doc_id, min(root) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""


OP8_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
d AS (SELECT *, sha256(role || chr(31) || text) AS d FROM t),
p AS (SELECT *, string_agg(d, '') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d ROWS UNBOUNDED PRECEDING) AS prefix,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM d),
whole AS (SELECT prefix, min(conv_id) AS conv_id, max(n) AS n_turns FROM p WHERE k = n GROUP BY prefix),
kept AS (SELECT * FROM whole WHERE prefix NOT IN (SELECT prefix FROM p WHERE k < n))
SELECT p.conv_id, kept.n_turns::INTEGER AS n_turns, string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY k) AS chat
FROM p JOIN kept USING (conv_id) GROUP BY p.conv_id, kept.n_turns
"""

_CELL = """
t AS (
  SELECT *, coalesce(source, '') AS s, coalesce(lang, '') AS l,
         CASE WHEN lower(text) LIKE '%licen%' OR lower(text) LIKE '%copyright%' OR lower(text) LIKE '%rights reserved%' THEN 'legal'
              WHEN lower(text) LIKE '%@%' OR lower(text) LIKE '%phone%' THEN 'contact' ELSE 'general' END AS topic,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens
  FROM documents),
r0 AS (SELECT s, l, topic, sum(n_tokens)::DOUBLE AS tok, 1.0::DOUBLE AS w FROM t GROUP BY ALL),
m AS (SELECT *, pow(sum(tok) OVER (PARTITION BY s), 0.7) AS ts, pow(sum(tok) OVER (PARTITION BY l), 0.7) AS tl,
             pow(sum(tok) OVER (PARTITION BY topic), 0.7) AS tt FROM r0)"""


def _op5_sql(cycles: int = 30) -> str:
    steps, last = [], "m"
    for k in range(cycles):
        for margin, target in (("s", "ts"), ("l", "tl"), ("topic", "tt")):
            name = f"{margin[0]}{k}x"
            have = f"sum(tok * w) OVER (PARTITION BY {margin})"
            steps.append(f"{name} AS MATERIALIZED (SELECT s, l, topic, tok, ts, tl, tt, CASE WHEN {have} > 0 THEN w * {target} / {have} ELSE w END AS w FROM {last})")
            last = name
    return f"""
WITH {_CELL}, {", ".join(steps)},
x AS (SELECT s, l, topic, w * 0.8 * (SELECT sum(tok) FROM m) / (SELECT sum(tok * w) FROM {last}) AS expected FROM {last}),
d AS (
  SELECT t.doc_id, t.source, t.lang, t.topic, t.n_tokens, x.expected,
         CASE WHEN n_tokens > 0 THEN x.expected ELSE least(1.0, x.expected) END AS e,
         ('0x' || substr(md5(coalesce(t.doc_id::VARCHAR, '') || 'mix'), 1, 13))::BIGINT / 4503599627370496.0 AS draw
  FROM t JOIN x ON x.s = t.s AND x.l = t.l AND x.topic = t.topic)
SELECT doc_id, source, lang, topic, n_tokens, round(expected, 6) AS expected, (floor(e) + CASE WHEN draw < e - floor(e) THEN 1 ELSE 0 END)::INTEGER AS copies
FROM d WHERE floor(e) + CASE WHEN draw < e - floor(e) THEN 1 ELSE 0 END > 0
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_license_scan,
        op2_substring_dedup,
        op3_minhash_near_dedup,
        op4_quality_rules,
        op5_source_mixing,
        op6_language_id,
        op7_transport_streams,
        op8_chat_formatting,
        op9_benchmark_decontamination,
        op10_toxicity,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": OP2_SQL, "op3_minhash_near_dedup": OP3_SQL, "op5_source_mixing": _op5_sql(), "op8_chat_formatting": OP8_SQL}
