"""Queries ``opN_<name>`` over the test tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.decontaminate import decontaminate
from citeloom.llm.divergence import source_divergence
from citeloom.llm.embeddings import near_vectors
from citeloom.llm.language import identify
from citeloom.llm.licenses import scan
from citeloom.llm.linededup import dedup_lines
from citeloom.llm.mixing import mix_sources
from citeloom.llm.ngrams import score_texts
from citeloom.llm.pages import extract
from citeloom.llm.resampling import resample
from citeloom.llm.setsketch import near_duplicates
from citeloom.llm.substrings import repeated_substrings
from citeloom.llm.toxicity import toxicity


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Target weights of the test tables' sources; any other source weighs 1.
WEIGHTS = {f"src{i}": 1.0 + i % 4 for i in range(20)}


def op1_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    return mix_sources(_table(spark, sf, "documents"), WEIGHTS)


SQL_1 = """
WITH counts AS (
  SELECT source, count(*) AS n,
         CASE WHEN regexp_matches(source, '^src(1?[0-9])$')
              THEN 1.0 + CAST(substr(source, 4) AS INT) % 4 ELSE 1.0 END::DOUBLE AS weight
  FROM documents GROUP BY source),
rates AS (
  SELECT source, weight / sum(weight) OVER () * sum(n) OVER () / n AS rate,
         CAST(ceil(rate / 8) AS INT) AS parts FROM counts),
terms AS (
  SELECT source, parts, list_transform(range(0, 65),
         lambda k: exp(-rate / parts) * pow(rate / parts, k) / gamma(k + 1)) AS term FROM rates),
tables AS (
  SELECT source, parts, list_transform(range(1, 66),
         lambda i: list_sum(term[1 : i])) AS below FROM terms),
draws AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars,
         CAST(list_sum(list_transform(range(1, parts + 1), lambda p: len(list_filter(below, lambda c: c <=
           (CAST('0x' || substr(md5('n0|' || d.doc_id || '|' || p), 1, 13) AS BIGINT) + 0.5)
           / 4503599627370496.0)))) AS INT) AS n_copies
  FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, text, lang, source, n_chars, n_copies, CAST(copy AS INT) AS copy,
       CAST('0x' || substr(md5('p0|' || doc_id || '|' || copy), 1, 15) AS BIGINT) AS position
FROM (SELECT *, unnest(range(1, n_copies + 1)) AS copy FROM draws WHERE n_copies > 0)
"""


def op2_language(spark: SparkSession, sf: str) -> DataFrame:
    return identify(_table(spark, sf, "documents"))


def op3_repeated_substrings(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_substrings(_table(spark, sf, "documents")).drop("spans")


def op4_near_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return near_vectors(_table(spark, sf, "embeddings"))


SQL_4 = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT vec_id, x, sqrt(list_inner_product(x, x)) AS n FROM v
      WHERE x IS NOT NULL AND list_inner_product(x, x) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b
  ON a.vec_id <> b.vec_id AND list_inner_product(a.x, b.x) >= 0.9 * a.n * b.n),
reach AS (SELECT vec_id AS id, vec_id AS low FROM v
          UNION SELECT b, low FROM reach JOIN links ON id = a),
least AS (SELECT id, min(low) AS component_id FROM reach GROUP BY id),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(counts.n, 0) AS BIGINT) AS n_links, component_id,
       vec_id = component_id AS kept
FROM v JOIN least ON id = vec_id LEFT JOIN counts ON a = vec_id
"""


def op5_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    return score_texts(_table(spark, sf, "documents"))


def op6_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


_WORD = r"[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL_6 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id,
             regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark),
windows AS (
  SELECT item_id, least(len(w), 13) AS n,
         array_to_string(w[k : k + least(len(w), 13) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k
        FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
runs AS (
  SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k
        FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT r.doc_id, r.n, r.k, x.item_id
         FROM runs r JOIN windows x ON r.n = x.n AND r.phrase = x.phrase),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items,
                 string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words,
       CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

def op7_extract(spark: SparkSession, sf: str) -> DataFrame:
    return extract(_table(spark, sf, "pages"))


def op8_dedup_lines(spark: SparkSession, sf: str) -> DataFrame:
    return dedup_lines(_table(spark, sf, "documents"))


def op9_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return scan(_table(spark, sf, "documents"))


def op10_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(_table(spark, sf, "documents"), n=3, percent=85)


SQL_10 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^ \\t\\n\\x{{0B}}\\f\\r]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k
        FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
reach AS (SELECT doc_id AS id, doc_id AS low FROM d
          UNION SELECT b, low FROM reach JOIN links ON id = a),
least AS (SELECT id, min(low) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id,
       d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN least ON d.doc_id = least.id
"""


def op11_source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return source_divergence(_table(spark, sf, "documents"))


SQL_11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x{00}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+') AS w
  FROM documents),
words AS (SELECT id, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT id) >= 3),
cells AS (
  SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS total FROM kept GROUP BY ALL),
grps AS (
  SELECT g.lang, g.source, coalesce(sum(n), 0)::BIGINT AS total FROM (SELECT DISTINCT lang, source FROM d) g
  LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         CAST(1 + 1000000000 * (coalesce(c.n, 0) + 1) // (g.total + l.v) AS HUGEINT) AS p,
         CAST(1 + 1000000000 * (k.n + 1) // (l.total + l.v) AS HUGEINT) AS q
  FROM grps g JOIN kept k USING (lang) JOIN langs l USING (lang)
  LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value
  FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def op12_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op13_resample(spark: SparkSession, sf: str) -> DataFrame:
    return resample(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


# The CRC of a word is folded over its bytes with a table made by the CRC's own rule.
SQL_13 = f"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1
           THEN xor(c // 2, 3988292384) ELSE c // 2 END, b)) AS steps),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
b AS (SELECT regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark),
words AS (SELECT doc_id, unnest(w) AS word FROM d),
wanted AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM b) GROUP BY 1),
spelled AS (
  SELECT word, hex(encode(word)) AS h
  FROM (SELECT word FROM words UNION SELECT word FROM wanted)),
bytes AS (
  SELECT word, list_transform(range(0, CAST(length(h) AS BIGINT), 2),
         lambda i: CAST('0x' || substr(h, i + 1, 2) AS BIGINT)) AS x FROM spelled),
buckets AS (
  SELECT word, xor(list_reduce(x, lambda c, v:
           xor(steps[CAST(xor(c, v) & 255 AS BIGINT) + 1], c // 256), CAST(4294967295 AS BIGINT)),
         4294967295) % 10000 AS bucket
  FROM bytes, crc_table),
corpus AS (SELECT bucket, count(*) AS n FROM words JOIN buckets USING (word) GROUP BY 1),
target AS (SELECT bucket, sum(n) AS n FROM wanted JOIN buckets USING (word) GROUP BY 1),
gains AS (
  SELECT g.bucket, CAST(floor(1000 * ln(
           CAST((coalesce(t.n, 0) + 1) * ((SELECT sum(n) FROM corpus) + 10000) AS DOUBLE)
         / CAST((coalesce(s.n, 0) + 1) * (coalesce((SELECT sum(n) FROM target), 0) + 10000) AS DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT unnest(range(10000)) AS bucket) g
  LEFT JOIN corpus s ON s.bucket = g.bucket LEFT JOIN target t ON t.bucket = g.bucket),
weights AS (
  SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight
  FROM words JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY 1),
scored AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
           (CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5)
           / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (doc_id)),
placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, rank
FROM scored s LEFT JOIN (SELECT * FROM placed WHERE rank <= 10 * n // 100) p ON s.doc_id = p.doc_id
"""

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_mix_sources": (op1_mix_sources, SQL_1),
    "op2_language": (op2_language, None),
    "op3_repeated_substrings": (op3_repeated_substrings, None),
    "op4_near_vectors": (op4_near_vectors, SQL_4),
    "op5_lm_score": (op5_lm_score, None),
    "op6_decontaminate": (op6_decontaminate, SQL_6),
    "op7_extract": (op7_extract, None),
    "op8_dedup_lines": (op8_dedup_lines, None),
    "op9_licenses": (op9_licenses, None),
    "op10_near_duplicates": (op10_near_duplicates, SQL_10),
    "op11_source_divergence": (op11_source_divergence, SQL_11),
    "op12_toxicity": (op12_toxicity, None),
    "op13_resample": (op13_resample, SQL_13),
}
