"""The numbered queries: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import ann, bpe, fingerprint, html, lexical, line_dedup, mixing, near_dedup, substring_dedup, toxicity, url_filter, vector_codes, warc

#: Where the tokenizer's vocabulary lies on every node.
BPE_FILE = "byte_bpe_50k.json"


def bpe_path(name: str = BPE_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, html.fit(pages))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages"))
    lost = F.raise_error(F.concat(F.lit("a segment or the digest is wrong: page "), F.col("page_id").cast("string"))).cast("long")
    return back.withColumn("page_id", F.when(F.col("verified"), F.col("page_id")).otherwise(lost)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), bpe_path())


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


#: host, beginning of the path, verdict: fixed values.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in URL_RULES])))
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity, op2_line_dedup, op3_near_dedup, op4_substring_dedup, op5_html, op6_mixing, op7_fingerprint, op8_warc, op9_bpe, op10_ann, op11_url_filter, op12_vector_codes, op13_lexical)
}

LINE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE s.key IS NOT NULL AND k.doc_id <> s.last) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE s.key IS NULL OR k.doc_id = s.last), '')) AS kept_sha256
FROM keyed k LEFT JOIN shared s ON k.key = s.key
GROUP BY k.doc_id
"""

SUBSTRING_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (
  SELECT doc_id, unnest(range(1, greatest(len(w) - 18, 1))) AS pos FROM docs WHERE len(w) >= 20),
hashed AS (
  SELECT wins.doc_id, pos, md5(array_to_string(list_slice(w, pos, pos + 19), ' ')) AS h FROM wins JOIN docs USING (doc_id)),
later AS (
  SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS r FROM hashed) t WHERE r > 1),
gone AS (
  SELECT DISTINCT doc_id, pos + k AS at FROM later, range(20) r(k)),
word AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS at FROM docs),
kept AS (
  SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.at) AS s, count(*) AS n
  FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.at = word.at WHERE gone.at IS NULL GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM docs d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

WARC_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT html, max(page_id) AS last FROM p GROUP BY html)
SELECT page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM p JOIN r ON p.html = r.html
"""

URL_SQL = r"""
WITH rules(host, path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
best AS (
  SELECT p.page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM p JOIN rules r ON (p.host = r.host OR suffix(p.host, '.' || r.host)) AND prefix(p.path, r.path) GROUP BY p.page_id)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN best USING (page_id)
"""

CODES_PRE = r"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
dims AS (SELECT len(v) // 16 AS w FROM kept LIMIT 1),
sub AS MATERIALIZED (
  SELECT vec_id, label, p, list_slice(v, CAST(p * w + 1 AS BIGINT), CAST(p * w + w AS BIGINT)) AS x FROM kept, dims, range(16) parts(p)),
b0 AS MATERIALIZED (
  SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS BIGINT) AS e, x AS c
  FROM sub WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64))
"""


def _codes_round(n: int) -> str:
    return f"""
, d{n} AS (
  SELECT s.vec_id, s.label, s.p, s.x, b.e, list_sum(list_transform(list_zip(s.x, b.c), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS d
  FROM sub s JOIN b{n} b ON s.p = b.p),
a{n} AS MATERIALIZED (
  SELECT vec_id, p, any_value(label) AS label, any_value(x) AS x, min(d * 64 + e) % 64 AS e, min(d * 64 + e) // 64 AS d FROM d{n} GROUP BY vec_id, p),
m{n} AS (
  SELECT p, e, list(CAST(floor_sum AS BIGINT) ORDER BY i) AS c FROM (
    SELECT p, e, i, (sum(x[i + 1]) - ((sum(x[i + 1]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_sum
    FROM a{n}, dims, range(w) place(i) GROUP BY p, e, i) t GROUP BY p, e),
b{n + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{n} b LEFT JOIN m{n} m ON b.p = m.p AND b.e = m.e)
"""


CODES_SQL = (
    CODES_PRE
    + "".join(map(_codes_round, range(3)))
    + r"""
, rows AS (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM rows, digest
"""
)

LEXICAL_SQL = r"""
WITH word AS (
  SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
                        lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS t
  FROM documents),
tf AS MATERIALIZED (SELECT doc_id, t, count(*) AS tf FROM word GROUP BY doc_id, t),
doc AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
corpus AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM doc),
item AS (
  SELECT DISTINCT item_id, unnest(list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
                                  lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS t
  FROM benchmark),
w AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tf, corpus WHERE t IN (SELECT t FROM item) GROUP BY t),
impact AS (
  SELECT doc_id, tf.t, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))) AS s
  FROM tf JOIN w ON tf.t = w.t JOIN doc USING (doc_id), corpus),
scored AS (
  SELECT item_id, doc_id, CAST(sum(s) AS BIGINT) AS score FROM item JOIN impact ON item.t = impact.t GROUP BY item_id, doc_id HAVING sum(s) > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored) t WHERE rank <= 50
"""

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": LINE_SQL,
    "op4_substring_dedup": SUBSTRING_SQL,
    "op8_warc": WARC_SQL,
    "op11_url_filter": URL_SQL,
    "op12_vector_codes": CODES_SQL,
    "op13_lexical": LEXICAL_SQL,
}
