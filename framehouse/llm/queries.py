"""Registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framehouse.llm import codes, compression_rules, decontaminate, near_copies, nearest, packing, quality, repeats, token_shards, toxicity, url_filter, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.filter_urls(_table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest_repeats(_table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.join(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "start", "n_words", "similarity")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.materialise(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(_table(spark, sf_dir, "embeddings"))


def op10_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "history_no"]
    return warc.capture_history(_table(spark, sf_dir, "pages")).select(columns)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_compression_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_rules.judge(_table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_repeats": op2_repeats,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_ngram_join": op4_ngram_join,
    "op5_decontamination": op5_decontamination,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_token_shards": op7_token_shards,
    "op8_toxicity": op8_toxicity,
    "op9_nearest": op9_nearest,
    "op10_warc_index": op10_warc_index,
    "op11_whitening": op11_whitening,
    "op12_compression_rules": op12_compression_rules,
    "op13_vector_codes": op13_vector_codes,
}



def _code_rounds(rounds: int = 4) -> str:
    """The rounds of op13 as SQL: near<k> has each part's nearest entry of book<k>, book<k + 1> the floored means of its parts."""
    near = """near{k} AS MATERIALIZED (SELECT rid, p, arg_min(e, ROW(gap, e)) AS e, min(gap) AS gap FROM (
  SELECT a.rid, a.p, b.e, list_inner_product(a.x, a.x) - 2 * list_inner_product(a.x, b.x) + list_inner_product(b.x, b.x) AS gap FROM part a JOIN book{k} b USING (p)) GROUP BY rid, p)"""
    book = """sums{n} AS (SELECT p, e, i, floor(sum(c) / count(*)) AS c FROM (SELECT p, e, unnest(range(len(x))) AS i, unnest(x) AS c FROM near{k} JOIN part USING (rid, p)) GROUP BY p, e, i),
book{n} AS MATERIALIZED (SELECT p, e, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN (SELECT p, e, list(c ORDER BY i) AS x FROM sums{n} GROUP BY p, e) m USING (p, e))"""
    return ",\n".join([near.format(k=0), *(part for k in range(rounds) for part in (book.format(k=k, n=k + 1), near.format(k=k + 1)))])


ORACLE_SQL = {
    "op1_url_filter": r"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, url,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
judged AS (
  SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule,
    CASE WHEN host <> '' THEN
      regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^(www|m)\.', '')
      || regexp_replace(path, '(/index\.html?|/)$', '')
      || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS canon
  FROM (SELECT *, regexp_replace(regexp_replace(regexp_extract(split_part(url, '#', 1), '^[^?]*\?(.*)$', 1),
        '(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&+', '') AS kept FROM split)),
listed AS (SELECT DISTINCT canon FROM judged WHERE rule IN ('net/', 'example.com/de/') AND canon IS NOT NULL)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN canon IN (SELECT canon FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM judged""",
    "op5_decontamination": r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM (SELECT DISTINCT doc_id, text FROM documents)
  UNION ALL SELECT 'b', item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM benchmark),
sh AS (SELECT kind, id, len(w) - 4 AS total, unnest(range(0, len(w) - 4)) AS i, w FROM words WHERE len(w) >= 5),
pos AS (SELECT kind, id, total, i, array_to_string(w[i + 1:i + 5], ' ') AS s FROM sh),
met AS (SELECT d.id AS doc_id, b.id AS item_id, d.total, b.total AS n, d.i AS spot, d.i - b.i AS same FROM pos d JOIN pos b ON d.s = b.s WHERE d.kind = 'd' AND b.kind = 'b'),
near AS (SELECT doc_id, item_id, total, n FROM (SELECT DISTINCT doc_id, item_id, total, n, spot FROM met) GROUP BY ALL HAVING count(*) >= 0.8 * n),
each_start AS (SELECT DISTINCT doc_id, item_id, total, n, unnest(range(spot - n + 1, spot + 1)) AS f0 FROM (SELECT DISTINCT doc_id, item_id, total, n, spot FROM met SEMI JOIN near USING (doc_id, item_id))),
starts AS (SELECT e.doc_id, e.item_id, n, f0, greatest(f0, 0) AS f, least(f0 + n, total) AS t, o.same IS NOT NULL AS aligned FROM each_start e LEFT JOIN (SELECT DISTINCT doc_id, item_id, same FROM met) o ON o.doc_id = e.doc_id AND o.item_id = e.item_id AND o.same = f0),
have AS (SELECT doc_id, item_id, n, f0, f, t, aligned, s, count(*) AS c FROM starts JOIN pos ON kind = 'd' AND id = doc_id AND i >= f AND i < t GROUP BY ALL),
item AS (SELECT id AS item_id, s, count(*) AS ic FROM pos WHERE kind = 'b' GROUP BY ALL),
sim AS (
  SELECT doc_id, item_id, f, t, aligned, sum(least(c, ic)) AS common, any_value(n) AS n FROM have JOIN item USING (item_id, s) GROUP BY doc_id, item_id, f0, f, t, aligned),
ok AS (SELECT doc_id, item_id, f, t, aligned, common / (t - f + n - common) AS similarity FROM sim)
SELECT doc_id, item_id, f AS start, t - f + 4 AS n_words, similarity FROM ok WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, aligned DESC, f, t) = 1""",
    "op10_warc_index": r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
h AS (SELECT *, sha1(html) AS hex, count(*) OVER (PARTITION BY html) AS n, max(page_id) OVER (PARTITION BY html) AS latest FROM p),
u AS (SELECT *, regexp_matches(url, '^[^:/?#]*://') AS has, regexp_replace(split_part(lower(regexp_extract(url, '^[^:/?#]*://([^/?#]*)', 1)), '@', -1), '^www\.', '') AS authority,
  regexp_extract(url, '^[^:/?#]*://[^/?#]*([^#]*)', 1) AS rest FROM h),
k AS (SELECT *, CASE WHEN NOT has THEN url ELSE array_to_string(list_reverse(string_split(split_part(authority, ':', 1), '.')), ',')
  || CASE WHEN split_part(authority, ':', 2) NOT IN ('', '80', '443') THEN ':' || split_part(authority, ':', 2) ELSE '' END || ')' || lower(CASE WHEN rest = '' THEN '/' ELSE rest END) END AS url_key,
  strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id % 2147483648), '%Y-%m-%dT%H:%M:%SZ') AS captured FROM u)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * (i // 4)::INT + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN n > 1 AND latest > page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n > 1 AND latest > page_id THEN latest END AS refers_to,
  url_key, captured, row_number() OVER (ORDER BY url_key, captured, page_id) - 1 AS history_no FROM k""",
    "op2_repeats": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
part AS (SELECT rid, j, substr(hx, 2 * j + 1, 798) AS x FROM (SELECT rid, hx, unnest(range(0, length(hx) // 2 - 199, 200)) AS j FROM d)),
w AS (SELECT rid, j + k AS i, md5_number(substr(x, 2 * k + 1, 400)) AS h FROM (SELECT rid, j, x, unnest(range(0, length(x) // 2 - 199)) AS k FROM part)),
again AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
hit AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS p FROM w SEMI JOIN again USING (h)),
grp AS (SELECT rid, i, sum(CASE WHEN i <= p + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM hit),
span AS (SELECT rid, min(i) AS a, max(i) + 200 AS b FROM grp GROUP BY rid, g),
gap AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY rid ORDER BY a) AS p FROM span),
cut AS (SELECT rid, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(hx, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || any_value(hx)[2 * max(b) + 1:] AS kept FROM gap JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, (length(hx) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, hx))) AS kept_sha256 FROM d LEFT JOIN cut USING (rid)""",
    "op4_ngram_join": r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_sort(list_distinct(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' ')))) ELSE [array_to_string(w, ' ')] END AS s FROM words WHERE len(w) > 0),
kinds AS (SELECT row_number() OVER () AS k, s, min(doc_id) AS copy_id, count(*) AS copies, len(s) AS n FROM sets GROUP BY s),
sh AS (SELECT k, n, unnest(s) AS x FROM kinds),
pairs AS (SELECT a.k AS a, b.k AS b FROM sh a JOIN sh b ON a.x = b.x AND a.k <> b.k AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n GROUP BY a.k, b.k HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT k, k AS r FROM kinds UNION SELECT reach.k, pairs.b FROM reach JOIN pairs ON pairs.a = reach.r),
class AS (SELECT reach.k, min(m.copy_id) AS class_id FROM reach JOIN kinds m ON m.k = reach.r GROUP BY reach.k),
links AS (SELECT a AS k, sum(m.copies) AS links FROM pairs JOIN kinds m ON m.k = pairs.b GROUP BY a),
known AS (SELECT s, class_id, copy_id, (coalesce(links, 0) + copies - 1)::BIGINT AS n_links FROM kinds JOIN class USING (k) LEFT JOIN links USING (k))
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(copy_id, d.doc_id) AS copy_id, coalesce(n_links, 0) AS n_links
FROM documents d LEFT JOIN sets USING (doc_id) LEFT JOIN known USING (s)""",
    "op13_vector_codes": f"""
WITH good AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS rid, vec_id, label, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
part AS MATERIALIZED (SELECT rid, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS x FROM good, (SELECT unnest(range(4)) AS p)),
book0 AS (SELECT p, rid - 1 AS e, x FROM part WHERE rid <= 256),
{_code_rounds()},
final AS (SELECT rid, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, sum(gap)::BIGINT AS error FROM near4 GROUP BY rid),
books AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda c: c::BIGINT), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book4)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM good JOIN final USING (rid), books""",
}
