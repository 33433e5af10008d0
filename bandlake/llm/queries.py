"""Queries of the corpus operators over the given tables, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle, table
from . import alignment, chat, decontaminate, langid, licenses, linededup, media, mixing, ngram_join, privacy, quality, toxicity, whitening
from .samples import labelled_sample


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), size=4, percent=85)


def op2_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), langid.held_out(F.col("doc_id"), 5, 0)
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", max_rows=10_000, exclude=held)
    scored = settle(quality.score(docs.withColumn("held_out", held), quality.fit(sample), keep=("doc_id", "held_out")), "quality-scores")
    return quality.mark_best(scored, share=0.8).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.drop_recurring_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), langid.held_out(F.col("doc_id"), 3, 1)
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", max_rows=10_000, exclude=held)
    scored = toxicity.score(docs.withColumn("held_out", held), toxicity.fit(sample), keep=("doc_id", "held_out"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licence_summary(licenses.licence_hits(table(spark, sf_dir, "documents")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = langid.held_out(F.col("doc_id"), 4, 2)
    model = langid.fit(docs.where(~held))
    return langid.identify(docs.withColumn("held_out", held), model, keep=("doc_id", "held_out"))


def op9_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the copies drawn here are neither turned nor scaled, so that images meet at their own size
    return media.image_components(media.images_of_vectors(table(spark, sf_dir, "embeddings")), enlarge_to=0)


def op10_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "CASE id WHEN 0 THEN 'user' ELSE 'assistant' END AS role", f"'{control}' AS text")
    return chat.read_back(chat.chat_windows(turns.unionByName(extra)))


def op11_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_measures(table(spark, sf_dir, "documents"))


def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_private_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.span_digests(privacy.find_private(table(spark, sf_dir, "documents")))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    -ln((CAST(('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)
      / coalesce(1.0::DOUBLE / (1.0::DOUBLE + 20.0::DOUBLE * (CAST(length(text) - length(regexp_replace(text, '[!#$%&*|<>=~^]', '', 'g')) AS DOUBLE) / nullif(length(text), 0))), 1.0::DOUBLE) AS k
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source),
c AS (SELECT *, CAST(source_size AS DOUBLE) * 3 AS cap FROM s),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT source, source_size, least(cap, coalesce(max(CASE WHEN level * w <= cap THEN level END) OVER () * w, cap)) AS target FROM l),
e AS (SELECT *, CAST(floor(coalesce(target / nullif(source_size, 0), 0.0) + 1e-9) AS BIGINT) AS epochs FROM t),
p AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN size > 0 AND before + size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM p
"""


OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(i)),
n AS (
  SELECT *, row_number() OVER w - 1 AS idx, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 AS tokens,
    length(role) + length(text) + 17
      + length(role || text) * 2 - length(replace(role || text, chr(92), '')) - length(translate(role || text, '[<', '')) AS chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
s AS (SELECT conv_id, sum(CASE WHEN idx = 0 AND role = 'system' AND 2 * tokens <= 512 THEN tokens ELSE 0 END) AS sys FROM n GROUP BY conv_id),
m AS (
  SELECT n.*, sys, (idx > 0 OR sys = 0) AND 2 * tokens > 512 - sys AS big, greatest(coalesce(sum(tokens) OVER w, 0) - sys, 0) AS before
  FROM n JOIN s USING (conv_id) WINDOW w AS (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (
  SELECT *, coalesce(sum(CAST(big AS INT)) OVER (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run,
    CASE WHEN big THEN -1 ELSE floor(2 * before / (512 - sys)) END AS bin FROM m),
b AS (
  SELECT conv_id, run, bin, min(idx) AS begin, sum(tokens) AS own, any_value(sys) AS sys, CASE WHEN any_value(sys) + sum(tokens) <= 512 THEN any_value(sys) ELSE 0 END AS fixed
  FROM k GROUP BY conv_id, run, bin),
v AS (
  SELECT k.conv_id, k.chars, sum(k.tokens) OVER (PARTITION BY k.conv_id, b.begin ORDER BY k.idx DESC) AS total, 512 - b.fixed - b.own AS spare
  FROM b JOIN k ON k.conv_id = b.conv_id AND k.idx < b.begin AND k.idx >= b.begin - 2 AND (k.idx > 0 OR k.sys = 0)),
x AS (
  SELECT conv_id, chars FROM n
  UNION ALL SELECT k.conv_id, k.chars FROM b JOIN k ON k.conv_id = b.conv_id AND b.begin > 0 AND k.idx = 0 AND b.fixed > 0
  UNION ALL SELECT conv_id, chars FROM v WHERE total <= spare),
f AS (SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM x GROUP BY conv_id),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY idx) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY idx), '') AS loss
  FROM n GROUP BY conv_id)
SELECT g.conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g JOIN f USING (conv_id)
"""


OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
t AS (
  SELECT doc_id, line, list_transform(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9@]|://') THEN '<*>' ELSE x END) AS w FROM l),
p AS (
  SELECT doc_id, line, w, len(w) AS n, len(w) - len(w) * 4 // 5 - CASE WHEN len(w) * 4 % 5 > 0 THEN 1 ELSE 0 END + 1 AS k,
    CASE WHEN len(w) >= 1 AND 5 * len(list_filter(w, lambda x: x <> '<*>')) >= 4 * len(w) THEN array_to_string(w, ' ') END AS cls, len(w) || ' ' || array_to_string(w[1:3], ' ') AS leaf FROM t),
d AS (SELECT DISTINCT doc_id, leaf, cls, n, k, w FROM p WHERE cls IS NOT NULL AND doc_id IS NOT NULL),
i AS (SELECT doc_id, leaf, cls, n, k, w, unnest(range(k)) AS i FROM d),
c AS (SELECT doc_id, leaf, cls, i, array_to_string(w[n * i // k + 1 : n * (i + 1) // k], ' ') AS piece FROM i),
a AS (SELECT leaf, i, piece FROM c GROUP BY leaf, i, piece HAVING count(DISTINCT doc_id) >= 3),
h AS (SELECT DISTINCT cls FROM c JOIN a USING (leaf, i, piece)),
b AS (SELECT d.* FROM d JOIN h USING (cls)),
u AS (SELECT doc_id, leaf, cls, n, unnest(w) AS token, generate_subscripts(w, 1) AS spot FROM b),
f AS (SELECT leaf, spot, token, CAST(floor(ln(count(DISTINCT doc_id) / 3) / ln(4) + 1e-9) AS INT) AS level FROM u WHERE token <> '<*>' GROUP BY leaf, spot, token HAVING count(DISTINCT doc_id) >= 3),
o AS (SELECT DISTINCT leaf, cls, n, spot, token, level FROM u JOIN f USING (leaf, spot, token)),
v AS (SELECT DISTINCT cls, level AS rung FROM o),
s AS (SELECT leaf, cls, rung, n, count(*) AS fixed, string_agg(spot || '=' || token, ' ' ORDER BY spot) AS template FROM o JOIN v USING (cls) WHERE level >= rung GROUP BY leaf, cls, rung, n),
r AS (SELECT * FROM s WHERE 5 * fixed >= 4 * n),
g AS (SELECT leaf, template FROM r JOIN b USING (leaf, cls) GROUP BY leaf, template HAVING count(DISTINCT doc_id) >= 3),
e AS (SELECT DISTINCT cls FROM r JOIN g USING (leaf, template))
SELECT p.doc_id, count(*) AS n_lines, count(e.cls) AS n_dropped,
  CAST(coalesce(sum(CASE WHEN e.cls IS NULL THEN length(line) + 1 END) - 1, 0) AS BIGINT) AS kept_chars
FROM p LEFT JOIN e USING (cls) GROUP BY p.doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""


def queries() -> dict:
    return {"op1_mix_sources": op1_mix_sources, "op2_quality_rank": op2_quality_rank, "op3_decontaminate": op3_decontaminate, "op4_line_dedup": op4_line_dedup, "op5_toxicity": op5_toxicity, "op6_license_scan": op6_license_scan, "op7_ngram_join": op7_ngram_join, "op8_language_id": op8_language_id, "op9_image_copies": op9_image_copies, "op10_chat_windows": op10_chat_windows, "op11_align_tokens": op11_align_tokens, "op12_whiten": op12_whiten, "op13_private_terms": op13_private_terms}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op4_line_dedup": OP4_SQL, "op6_license_scan": licenses.oracle(), "op10_chat_windows": OP10_SQL}
