"""The queries of this package and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    cover_tree, jaccard_join, line_dedup, packing, piece_encoding, pii, quality_classifier, quality_rules, sharding, spelling, toxicity, warc, whitening,
)
from .common import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_encoding.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ids=False)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"), k=3, p=90, q=100)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, pii.DEMO_KEY, found="n_replaced").select("doc_id", "n_replaced", "text")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = toxicity.held_out()
    model = toxicity.fit(docs, labels, ~out)
    scored = docs.select("doc_id", toxicity.scored(F.col("text"), model).alias("score"))
    return scored.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read(warc.write(table(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The layout before: 16 shards by a hash of the source, so that a hot source makes one far too large.
OLD_SHARDS, NEW_SHARDS = 16, 24


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = F.pmod(F.xxhash64("source"), F.lit(OLD_SHARDS))
    placed, touched = sharding.reshard(docs, before, OLD_SHARDS, NEW_SHARDS)
    rows = sharding.rewrite(placed, touched, NEW_SHARDS)
    return rows.select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = quality_classifier.held_out()
    model, scale = quality_classifier.fit(docs, labels, ~out)
    scored = quality_classifier.score(docs, model, scale, ["doc_id"]).select("row.doc_id", "score")
    return scored.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.join(table(spark, sf_dir, "embeddings"), 0.9)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.dedup(docs)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        pipeline, op1_sentencepiece, op2_jaccard_join, op3_pii, op4_toxicity, op5_warc, op6_sharding, op7_quality_classifier,
        op8_quality_rules, op9_cover_tree, op10_packing, op11_line_dedup, op12_spelling, op13_whitening,
    )
}

ORACLES: dict[str, str] = {
    "op8_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM d),
g AS (SELECT rid, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
      FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
t AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM g) WHERE n > 1),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM t) GROUP BY rid),
m AS (SELECT w.rid, doc_id, source, len(words) AS n_words,
        length(text) - length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(lines) AS n_lines
      FROM w LEFT JOIN r ON w.rid = r.rid),
f AS (SELECT *, n_words < 50 AS f1, 100 * n_repeat_words > 50 * n_words AS f2,
        100 * n_symbols > 10 * word_chars AS f3, 100 * n_dup_lines > 30 * n_lines AS f4 FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, [sum(f1::INT)::DOUBLE, sum(f2::INT)::DOUBLE, sum(f3::INT)::DOUBLE, sum(f4::INT)::DOUBLE] AS k FROM f GROUP BY source),
l AS (SELECT source, n, unnest(range(1, 5)) AS rule, unnest(k) AS k FROM h),
p AS (SELECT rule, sum(n) AS total, sum(k) / sum(n) AS mean, count(*) AS hosts, sum(n) - sum(n * n) / sum(n) AS spread, sum(k * k / n) AS kk FROM l GROUP BY rule),
q AS (SELECT rule, mean, CASE WHEN spread > 0 AND mean > 0 AND mean < 1 THEN (kk - total * mean * mean - (hosts - 1) * mean * (1 - mean)) / spread END AS between_ FROM p),
s AS (SELECT rule, mean, CASE WHEN between_ > 0 THEN least(10000.0, greatest(1.0, mean * (1 - mean) / between_ - 1)) ELSE 10000.0 END AS strength FROM q),
v AS (SELECT source, bool_or((k + strength * mean) / (n + strength) > 0.5) AS rejected FROM l JOIN s USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed, NOT (f1 OR f2) AND NOT rejected AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
""",
    "op2_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(words, i, i + 2) AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
r AS (SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT r.v, l.b FROM r JOIN l ON l.a = r.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(u) AS component_id FROM r GROUP BY v) c ON c.v = d.doc_id
""",
    "op5_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), q AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to FROM f
""",
    "op11_line_dedup": """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 AND doc_id IS NOT NULL GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
v AS (SELECT k.*, coalesce(doc_id <> keeper, false) AS gone FROM k LEFT JOIN g USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM v GROUP BY rid
""",
    "op12_spelling": r"""
WITH RECURSIVE step AS (SELECT i, i AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM step WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM step WHERE k = 8),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
c AS (SELECT d, run, count(*) AS n, hex(encode(concat(d, ':', run))) AS x FROM runs WHERE length(run) >= 7 GROUP BY d, run),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, [CAST(concat('0x', substr(x, 2 * i + 1, 2)) AS BIGINT) FOR i IN range(length(x) // 2)]),
        lambda a, b: xor(a // 256, tab[xor(a % 256, b) + 1])), 4294967295) AS h FROM c, tab),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 31 = 0 THEN concat(substr(run, 1, CAST(h % length(run) AS INT)), substr(run, CAST(h % length(run) AS INT) + 2)) ELSE run END AS word FROM h)
      WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
x AS (SELECT word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS cut FROM (SELECT word, n, CAST(unnest(range(1, length(word) + 1)) AS INT) AS i FROM v)),
p AS (SELECT a.word, a.n, b.word AS form, b.n AS form_n FROM x a JOIN x b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word AND length(a.word) = length(b.word)
      UNION SELECT v.word, v.n, x.word, x.n FROM v JOIN x ON x.cut = v.word UNION SELECT x.word, x.n, v.word, v.n FROM v JOIN x ON x.cut = v.word),
b AS (SELECT word, count(*) AS n_near, arg_min(form, (-form_n, form)) AS form, max(form_n) AS form_n, any_value(n) AS n FROM p GROUP BY word),
f AS (SELECT word, n_near, CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n FROM b),
r AS (SELECT word, word AS at FROM v UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.at WHERE f.form IS NOT NULL),
e AS (SELECT r.word, r.at FROM r LEFT JOIN f ON f.word = r.at WHERE f.form IS NULL)
SELECT v.word, v.n, coalesce(f.n_near, 0) AS n_near, f.form, f.form_n, e.at AS root FROM v LEFT JOIN f USING (word) JOIN e USING (word)
""",
    "op9_cover_tree": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS v, vec_id AS u FROM v UNION SELECT r.v, l.b FROM r JOIN l ON l.a = r.u),
c AS (SELECT v, min(u) AS component_id FROM r GROUP BY v), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.v = vec_id LEFT JOIN n ON n.a = vec_id
""",
}
