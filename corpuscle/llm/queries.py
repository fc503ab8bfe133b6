"""The queries of the training-data operators, and SQL where it can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from corpuscle.llm import (
    op1_chat, op2_toxicity, op3_repeats, op4_packing, op5_quality, op6_html, op7_topk, op8_neardup, op9_lines, op10_decontaminate,
    op11_whitening, op12_resampling, op13_mixing,
)
from corpuscle.llm.cut import read


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one whose texts hold control strings, formatted and read back."""
    chats = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return op1_chat.digests(op1_chat.parse_chats(op1_chat.format_chats(chats.unionByName(more))))


def op2_toxicity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels that aren't held out."""
    docs = read(spark, sf_dir, "documents")
    return op2_toxicity.fit(docs, read(spark, sf_dir, "labels")).score(docs)


def op3_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its bytes in strings of 400 bytes that start anywhere else."""
    return op3_repeats.repeated_strings(read(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, each with its bin."""
    return op4_packing.pack_documents(read(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels that aren't held out."""
    docs = read(spark, sf_dir, "documents")
    return op5_quality.fit(docs, read(spark, sf_dir, "labels")).score(docs)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return op6_html.extract_pages(read(spark, sf_dir, "pages"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best others of every vector whose id is divisible by 100."""
    return op7_topk.top_k(op7_topk.to_integers(read(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of similar documents."""
    return op8_neardup.near_duplicates(read(spark, sf_dir, "documents")).drop("row")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, removed lines, and hash of what is left."""
    out = op9_lines.dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_decontaminate_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, and whether it holds passages of benchmark items."""
    return op10_decontaminate.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the first four whitened components."""
    return op11_whitening.whiten(read(spark, sf_dir, "embeddings"))


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight and score against the benchmark's texts, and the drawn ones' ranks."""
    return op12_resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("row")


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words in the mix of all sources, drawn by labelled quality."""
    mixture = op13_mixing.mix(read(spark, sf_dir, "documents"), op13_mixing.label_weights(read(spark, sf_dir, "labels")))
    return mixture.select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_chat_format, op2_toxicity_score, op3_repeated_strings, op4_best_fit_packing, op5_quality_rules,
        op6_html_text, op7_top_k, op8_near_duplicates, op9_line_dedup, op10_decontaminate_benchmark,
        op11_whitened_embeddings, op12_target_resampling, op13_source_mixing,
    )
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


_OP1 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
esc AS (
  SELECT *, replace(role, '\', '\b') AS r1, replace(text, '\', '\b') AS t1,
    lag(role) OVER w AS before, row_number() OVER w AS k
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
sized AS (
  SELECT *,
    length(replace(replace(replace(replace(r1, '<|turn|>', '\t'), '<|text|>', '\x'), '<|next|>', '\n'), '<|end|>', '\e')) AS role_chars,
    length(replace(replace(replace(replace(t1, '<|turn|>', '\t'), '<|text|>', '\x'), '<|next|>', '\n'), '<|end|>', '\e')) AS text_chars
  FROM esc)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (7 + sum(text_chars + CASE WHEN before = role THEN 8 ELSE 16 + role_chars + CASE WHEN k > 1 THEN 7 ELSE 0 END END))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

_OP7 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


#: crc32 by its table of 256 entries, made by the rule; bytes come from the hexadecimal form.
_OP12 = r"""
WITH crc AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i::UBIGINT, list_transform(range(8), lambda k: k::UBIGINT)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i))),
docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
df AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM docs),
bf AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM items),
known AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM df UNION SELECT f FROM bf)),
hashed AS (SELECT f, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::INT, 2))::UBIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) % 256)::INT + 1])), 4294967295::UBIGINT) % 10000 AS bucket FROM known, crc),
s AS (SELECT bucket, count(*) AS n FROM df JOIN hashed USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bf JOIN hashed USING (f) GROUP BY bucket),
gain AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE
  / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS g FROM s LEFT JOIN t USING (bucket)),
weighed AS (SELECT doc_id, sum(g)::BIGINT AS g, count(*) AS n FROM df JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(g::DOUBLE / n), 0)::BIGINT AS weight, len(w) AS n_words,
  floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id::VARCHAR), 1, 8))::UBIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
  FROM docs LEFT JOIN weighed USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS rank, count(*) OVER () AS total FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN rank <= total * 25 // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""

_OP13 = r"""
WITH docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1]::DOUBLE AS weight FROM sources),
levels AS (SELECT *, 2 * source_size AS stop,
  ((SELECT 150 * sum(source_size) FROM sources)::DOUBLE / 100 - coalesce(sum(2 * source_size) OVER before, 0)::DOUBLE) / sum(weight) OVER after AS level
  FROM weighed WINDOW before AS (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  after AS (ORDER BY source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
plan AS (SELECT source, source_size, least(stop::DOUBLE, (SELECT max(level) FROM levels) * weight) AS target FROM levels),
good AS (SELECT doc_id, max(quality) AS good FROM labels GROUP BY doc_id),
keyed AS (SELECT d.doc_id, size, source_size, target, floor(target)::BIGINT AS whole, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs, d.source,
  -ln((('0x' || substr(sha256('mix:' || d.doc_id::VARCHAR), 1, 12))::UBIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE) / CASE WHEN good > 0 THEN 4.0 WHEN good <= 0 THEN 1.0 ELSE 2.0 END::DOUBLE AS key
  FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN good g ON d.doc_id = g.doc_id),
summed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM keyed)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, whole - epochs * source_size - before)))::BIGINT AS taken FROM summed
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": _OP1, "op7_top_k": _OP7, "op12_target_resampling": _OP12, "op13_source_mixing": _OP13}
