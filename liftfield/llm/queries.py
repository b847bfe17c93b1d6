"""One registered query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from liftfield.llm.chat import format_conversations, read_back
from liftfield.llm.common import WORD
from liftfield.llm.decontam import leaks
from liftfield.llm.languages import fold, languages
from liftfield.llm.licenses import licenses
from liftfield.llm.likelihood import pseudo_likelihood
from liftfield.llm.mixing import mixed
from liftfield.llm.negatives import hard_negatives
from liftfield.llm.quality import quality
from liftfield.llm.runs import periodic_runs
from liftfield.llm.simhash import simhash_components
from liftfield.llm.substrings import deduplicated
from liftfield.llm.tokens import token_counts
from liftfield.llm.toxicity import toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn

    return wrap


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_quality_rules")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op2_simhash_components")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return simhash_components(table(spark, sf, "documents"))


@query("op3_token_counts")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op4_pseudo_likelihood")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return pseudo_likelihood(table(spark, sf, "documents"))


@query("op5_language_id")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return languages(table(spark, sf, "documents"), fold(3, 1))


@query("op6_toxic_spans")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"), fold(4, 2))


@query("op7_substring_dedup")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return deduplicated(table(spark, sf, "documents"))


#: The dual solved by bisection, one variable for each source, instead of Newton steps.
MIX_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2e0 * sum(size) AS stop,
         [3e0, 1e0, 2e0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS BIGINT) + 1] AS weight FROM d GROUP BY source),
marked AS (
  SELECT *, stop * (all_weight - coalesce(w0, 0)) <= weight * (all_words - coalesce(s0, 0)) AS stopped FROM (
    SELECT *, sum(source_size) OVER () * 1.5e0 AS all_words, sum(weight) OVER () AS all_weight, sum(stop) OVER e AS s0, sum(weight) OVER e AS w0
    FROM per WINDOW e AS (ORDER BY stop / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
targets AS (
  SELECT source, source_size, CASE WHEN stopped THEN stop ELSE least(stop, weight * level) END AS target FROM (
    SELECT *, (all_words - coalesce(sum(stop) FILTER (stopped) OVER (), 0)) / (all_weight - coalesce(sum(weight) FILTER (stopped) OVER (), 0)) AS level FROM marked)),
hist AS (SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY ALL),
steps AS (
  SELECT 0 AS k, t.source, target, least(0e0, ln(target / source_size)) / min(size) AS low, CASE WHEN target > source_size THEN ln(2e0) / min(size) ELSE 0e0 END AS high
  FROM targets t JOIN hist h ON t.source IS NOT DISTINCT FROM h.source WHERE target > 0 AND target < 2e0 * source_size * (1 - 1e-12) GROUP BY t.source, target, source_size
  UNION ALL
  SELECT k + 1, s.source, target, CASE WHEN sum(n * size * exp(least((low + high) / 2 * size, ln(2e0)))) < target THEN (low + high) / 2 ELSE low END,
         CASE WHEN sum(n * size * exp(least((low + high) / 2 * size, ln(2e0)))) < target THEN high ELSE (low + high) / 2 END
  FROM steps s JOIN hist h ON s.source IS NOT DISTINCT FROM h.source WHERE k < 120 GROUP BY k, s.source, target, low, high),
taken AS (
  SELECT doc_id, size, source_size, t.target, CAST(least(floor(size * CASE WHEN size = 0 OR t.target <= 0 THEN 0e0 WHEN s.low IS NULL THEN 2e0
           ELSE exp(least((s.low + s.high) / 2 * size, ln(2e0))) END + CAST('0x' || substr(md5(concat_ws('|', doc_id, size)), 1, 8) AS BIGINT) / 4294967296e0), 2 * size) AS BIGINT) AS taken
  FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN steps s ON s.k = 120 AND s.source IS NOT DISTINCT FROM d.source)
SELECT *, CAST(CASE WHEN size > 0 THEN ceil(taken / size) ELSE 0 END AS INTEGER) AS copies FROM taken
"""


@query("op8_source_mix", MIX_SQL)
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return mixed(table(spark, sf, "documents")).drop("rate")


@query("op9_license_scan")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files: the source is the repository, the language a directory in it, the id the file's name."""
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    found = licenses(table(spark, sf, "documents").select(path.alias("path"), "text"))
    return found.select(F.regexp_extract("path", "[^/]*$", 0).cast("bigint").alias("doc_id"), *found.columns)


@query("op10_benchmark_leaks")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


#: CRC-32 of the id's digits by table, all pairs of equal words, and their islands by distance.
RUNS_SQL = r"""
WITH crc AS (
  SELECT list(v ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) AS v FROM (SELECT unnest(range(256)) AS b))),
d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM documents, crc),
g AS (SELECT r, doc_id, w, len(w) AS n, h, (h // 10) % len(w) AS a, 3 + (h // 10) % 8 AS k FROM d),
x AS (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // k) + 1] END) ELSE w END AS w FROM g),
e AS (SELECT r, n, unnest(w) AS word, unnest(range(len(w))) AS i FROM x),
pairs AS (SELECT a.r, b.i - a.i AS q, a.i FROM e a JOIN e b ON a.r = b.r AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
runs AS (
  SELECT r, start, length, min(q) AS period FROM (
    SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs)
    GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)) GROUP BY ALL),
per AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS said,
         max({'l': length, 's': -start, 'p': -period}) AS best FROM runs GROUP BY r),
kept AS (
  SELECT e.r, string_agg(word, ' ' ORDER BY i) AS words FROM e WHERE NOT EXISTS (
    SELECT 1 FROM runs WHERE runs.r = e.r AND e.i >= start + period AND e.i < start + length) GROUP BY e.r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(-best.s AS BIGINT) AS start, CAST(best.l AS BIGINT) AS length, CAST(-best.p AS BIGINT) AS period,
       CAST(1000 * best.l // -best.p AS BIGINT) AS exponent_milli, sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM x LEFT JOIN per USING (r) LEFT JOIN kept USING (r)
"""


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Texts of the contract: of a tenth of the documents, by their id's checksum, the end repeats with one period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(w):
        n = F.size(w)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.when(n > 0, F.transform(F.array(F.struct(a.cast("int").alias("a"), p.cast("int").alias("p"))), lambda v: F.array_join(
            F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < v.a, F.get(w, i)).otherwise(F.get(w, v.a + (i - v.a) % v.p))), " "))[0])

    planted = F.transform(F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), repeated)[0]
    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(planted, F.col("text"))).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs", RUNS_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("l"), (-r.start).alias("s"), (-r.period).alias("p"))))
    said = F.array_join(F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))), "")
    found = periodic_runs(with_planted_runs(table(spark, sf, "documents"))).withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.l").alias("length"), (-F.col("best.p")).alias("period"),
        F.expr("1000 * best.l div -best.p").alias("exponent_milli"), F.sha2(said, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 5
"""


@query("op12_hard_negatives", NEGATIVES_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (
  SELECT *, len(regexp_extract_all(text, '[\[<]\\*(?:/?(?:INST\]|SYS\]|ROLE\]|s>)|END\])')) AS marked,
         len(regexp_extract_all(role, '[\[<]\\*(?:/?(?:INST\]|SYS\]|ROLE\]|s>)|END\])')) AS role_marked FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(text) + marked + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 18 + length(role) + role_marked END) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""


@query("op13_chat_format", CHAT_SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    return read_back(format_conversations(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf)
