"""The operators' queries over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, html_extract, language_id, lexical, line_dedup, lm_score, mixing, near_dedup, packing, quality_rules, suffix_dedup, url_filter, whitening
from .common import table

RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("row.page_id", "host", "path", "rule", "verdict")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("row.doc_id", F.col("source_key").alias("source"), "block", "slot", "block_offset")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as good and not toxic."""
    good = table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0").select(F.col("doc_id").alias("t"))
    return lm_score.score_documents(table(spark, sf_dir, "documents"), good).select("row.doc_id", "n_tokens", "target_loss", "background_loss", "score")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    docs = table(spark, sf_dir, "documents")
    out = language_id.identify(docs, ~F.coalesce(held_out, F.lit(False)))
    return out.select("row.*", "lang_pred", "score", "rejected").select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("row.doc_id", "n_shingles", "component_id", "kept")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages")).select("row.page_id", "row.url", "text", "n_chars", "n_deleted", "n_compared")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings"))
    values = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "value")
    out = out.select("row.vec_id", "n", F.col("deviation").try_cast("long").alias("deviation"), "identity_error", values)
    return out.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "value.whitened", "value.explained", "identity_error")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_packing, op2_url_filter, op3_mixing, op4_lm_score, op5_ann, op6_quality_rules, op7_language_id, op8_near_dedup, op9_line_dedup, op10_html_extract, op11_whitening, op12_suffix_dedup, op13_lexical_search)
    return {f.__name__: f for f in every}


_WS = r"[\x20\x09-\x0D]"
_ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_STRIP = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP2_SQL = r"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path
  FROM parts),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
found AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM split s LEFT JOIN found f ON s.page_id = f.page_id
"""

OP6_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
      FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)),
n AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY doc_id),
t AS (SELECT doc_id, i, w AS a, lead(w, 1) OVER p AS b, lead(w, 2) OVER p AS c FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM t WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
rw AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
l AS (SELECT doc_id, source, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM d)),
dl AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
k AS (SELECT doc_id, source, i, translate(trim(line, {_STRIP}), {_ABC}) AS key FROM l),
h AS (SELECT doc_id, string_agg(key, chr(10) ORDER BY i) AS whole FROM k WHERE key <> '' GROUP BY doc_id),
a AS (SELECT k.*, whole FROM k JOIN h ON k.doc_id = h.doc_id WHERE key <> ''),
hd AS (SELECT source, count(DISTINCT whole) AS host_docs FROM a GROUP BY source),
f AS (SELECT a.source, key, min(doc_id) AS first_d FROM a JOIN hd ON a.source IS NOT DISTINCT FROM hd.source
      GROUP BY a.source, key, host_docs HAVING count(DISTINCT whole) > 5 AND 100 * count(DISTINCT whole) > 5 * host_docs),
x AS (SELECT a.doc_id, sum(length(a.key)) AS removed FROM a JOIN f ON a.key = f.key AND a.source IS NOT DISTINCT FROM f.source
      WHERE a.doc_id > f.first_d GROUP BY a.doc_id),
c AS (SELECT doc_id, sum(length(key)) AS chars FROM k GROUP BY doc_id),
m AS (
  SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(removed, 0) <= 0.7 * coalesce(chars, 0) AS whole
  FROM d LEFT JOIN n USING (doc_id) LEFT JOIN rw USING (doc_id) LEFT JOIN dl USING (doc_id) LEFT JOIN x USING (doc_id) LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND whole AS kept FROM b
"""

OP8_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ABC}), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [ws]
             ELSE list_transform(range(1, len(ws) - 3), lambda i: ws[i:i + 4]) END) AS s FROM w),
s AS (SELECT DISTINCT doc_id, s FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, c.r FROM c JOIN e ON c.doc_id = e.a),
m AS (SELECT doc_id, min(r) AS component_id FROM c GROUP BY doc_id)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""

OP9_SQL = rf"""
WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, translate(trim(line, {_STRIP}), {_ABC}) AS key FROM l),
s AS (SELECT key, min(doc_id) AS first_d FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, line, i, s.key IS NOT NULL AND k.doc_id <> first_d AS dropped FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


OP12_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 400)) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS i FROM d WHERE n >= 200)),
x AS (SELECT doc_id, i FROM w JOIN (SELECT s FROM w GROUP BY s HAVING count(*) > 1) USING (s)),
e AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM x),
r AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e) GROUP BY doc_id, run),
p AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t FROM r UNION ALL SELECT d.doc_id, coalesce(max(b), 0), n FROM d LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id, n),
k AS (SELECT p.doc_id, string_agg(substr(h, 2 * f + 1, 2 * (t - f)), '' ORDER BY f) AS kept FROM p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id),
c AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed FROM r GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN k ON k.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""

OP13_SQL = rf"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, {_ABC}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, {_ABC}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
c AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM d),
m AS (SELECT doc_id, 100 - 50 + ((50 * n * nn) // ll) AS m FROM d, c),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY term), c),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
      FROM q JOIN f USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": OP2_SQL, "op6_quality_rules": OP6_SQL, "op8_near_dedup": OP8_SQL, "op9_line_dedup": OP9_SQL, "op12_suffix_dedup": OP12_SQL, "op13_lexical_search": OP13_SQL}
