"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clarion.llm import credentials, divergence, exact_dedup, langid, licences, minhash, mixing, passages, pieces, repair, reputation, sharding, winnowing
from clarion.llm.common import table

MODEL_FILE = "piece_bpe_32k.model"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licences.by_document(docs, licences.fit(docs))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_components(table(spark, sf_dir, "documents"), words=4, similarity=0.8)


def op3_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return reputation.judge(pages, reputation.outcomes_of(pages, table(spark, sf_dir, "labels")))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = langid.fit(docs.where(~langid.held_out()))
    out = langid.predict(docs.select("doc_id", "text"), net)
    return out.select("doc_id", langid.held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op6_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign(table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"), pieces.read_model(public_tokenizers.path(MODEL_FILE)))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edited_likeness(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digest(repair.repair(repair.damage(table(spark, sf_dir, "conversations"))))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.report(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_minhash_near_dedup, op3_url_reputation, op4_source_mixing, op5_language_id, op6_byte_shards,
                                   op7_sentencepiece, op8_winnowing, op9_exact_dedup, op10_substring_dedup, op11_source_divergence, op12_conversation_repair,
                                   op13_secret_scan, pipeline)}

def _repair_sql() -> str:
    """The damage, then for every row the cheapest and least edits that end in each state, as text: six digits of cost and the letters."""
    add = lambda x, cost, letter: f"(lpad(({x}[1:6]::INTEGER + {cost})::VARCHAR, 6, '0') || {x}[7:] || '{letter}')"
    keep = lambda x, initial: f"CASE WHEN NOT doomed AND initial = '{initial}' THEN {add(x, '3 * open_', 'K')} END"
    rerole = lambda x: f"CASE WHEN NOT doomed THEN {add(x, '3 + 3 * open_', 'R')} END"
    delete = lambda x: add(x, 4, "D")
    to_user = ", ".join(f"{keep(x, 'u')}, {rerole(x)}" for x in ("z", "s", "a"))
    put = lambda x: add(x, 3, "I")
    return rf"""
WITH RECURSIVE crc(t) AS (SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce([4294967295::BIGINT] || list_transform(
    string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT), lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) % 20 AS k
  FROM conversations, crc),
copies AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE k WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM keyed),
hashed AS (SELECT *, sha256(length(role) || ':' || role || text) AS h, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM copies),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, h, copy) AS i,
  row_number() OVER (PARTITION BY conv_id, h ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM hashed),
rows_ AS (SELECT conv_id, turn, role, text, i, role[1:1] AS initial, body = '' AS blank, again AND body <> '' AS duplicate, NOT again AND body <> '' AND right(body, 1) NOT IN ('.', '!', '?') AS truncated,
  lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM numbered),
marks AS (SELECT conv_id, i, initial, blank OR duplicate AS doomed, truncated::INTEGER AS open_ FROM rows_),
best AS (
  SELECT conv_id, 0::BIGINT AS i, '000000' AS z, NULL::VARCHAR AS s, '000003I' AS u, '000006II' AS a FROM (SELECT DISTINCT conv_id FROM marks)
  UNION ALL
  SELECT conv_id, i, z, s, u, least(a, {put("u")}) FROM (
    SELECT conv_id, i, z, s, least(u, {put("z")}, {put("s")}, {put("a")}) AS u, a FROM (
      SELECT b.conv_id, m.i, {delete("z")} AS z, least({delete("s")}, {keep("z", "s")}) AS s, least({delete("u")}, {to_user}) AS u, least({delete("a")}, {keep("u", "a")}, {rerole("u")}) AS a
      FROM best b JOIN marks m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.i = b.i + 1))),
ends AS (SELECT conv_id, max(i) AS n FROM marks GROUP BY conv_id),
chosen AS (SELECT e.conv_id, least(z, a) AS way FROM ends e JOIN best b ON b.conv_id IS NOT DISTINCT FROM e.conv_id AND b.i = e.n),
letters AS (SELECT conv_id, unnest(string_split(way[7:], '')) AS letter, unnest(range(1, length(way[7:]) + 1)) AS at_ FROM chosen WHERE length(way) > 6),
placed AS (SELECT *, sum((letter <> 'I')::INTEGER) OVER (PARTITION BY conv_id ORDER BY at_) AS i FROM letters),
turns AS (SELECT p.conv_id, p.at_, p.letter, r.role, r.text, row_number() OVER (PARTITION BY p.conv_id ORDER BY p.at_) AS j
  FROM placed p LEFT JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i WHERE p.letter <> 'D'),
lead_ AS (SELECT *, first_value(letter = 'K' AND role[1:1] = 's') OVER (PARTITION BY conv_id ORDER BY j)::INTEGER AS sys FROM turns),
texts AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (j - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS body
  FROM lead_ GROUP BY conv_id),
stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(way[1:6], '0')::BIGINT AS cost, coalesce(way[7:], '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
  LEFT JOIN chosen c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""


ORACLES = {
    # all pairs of documents that share a shingle, then the components' smallest ids
    "op2_minhash_near_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 3], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * both_ >= 80 * (x.n + y.n - both_)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT edges.b, reach.r FROM reach JOIN edges ON edges.a = reach.v WHERE reach.r < edges.b),
low AS (SELECT v, min(r) AS component_id FROM reach GROUP BY v)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN low ON low.v = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id
""",
    "op3_url_reputation": r"""
WITH urls AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
outcomes AS (
  SELECT host, (quality = 1 AND toxic = 0)::BIGINT AS good
  FROM (SELECT host, try_cast(nullif(regexp_extract(path, '/([0-9]{1,18})(?:[^0-9].*)?$', 1), '') AS BIGINT) AS doc FROM urls) u
  JOIN labels ON doc_id = doc WHERE quality IS NOT NULL AND toxic IS NOT NULL),
by_host AS (
  SELECT host, coalesce(sum(good), 0)::DOUBLE AS good, count(good)::DOUBLE AS n,
         string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS l
  FROM (SELECT host, NULL AS good FROM urls UNION ALL SELECT host, good FROM outcomes) GROUP BY host),
parted AS (
  SELECT host, good, n, l, CASE WHEN array_to_string(l[-2:], '.') IN ('ac.uk', 'co.jp', 'co.nz', 'co.uk', 'com.au', 'com.br', 'com.cn', 'gov.uk', 'org.uk') THEN 2 ELSE 1 END AS parts FROM by_host),
hosts AS (SELECT host, good, n, array_to_string(l[greatest(len(l) - parts, 1):], '.') AS domain, array_to_string(l[greatest(len(l) - parts + 1, 1):], '.') AS suffix FROM parted),
domains AS (SELECT domain, suffix, sum(good) AS good, sum(n) AS n FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(good) AS good, sum(n) AS n FROM domains GROUP BY ALL),
moments AS (
  SELECT level, count(*) AS g, sum(n) AS n, sum(n * n) AS nn, sum(good) AS good, sum(good * good / n) AS gg
  FROM (SELECT 1 AS level, good, n FROM hosts UNION ALL SELECT 2, good, n FROM domains UNION ALL SELECT 3, good, n FROM suffixes) WHERE n > 0 GROUP BY level),
rhos AS (
  SELECT level, CASE WHEN g >= 2 AND good / n * (1 - good / n) > 0 AND n - nn / n - (g - 1) > 0
    THEN (gg - n * (good / n) * (good / n) - good / n * (1 - good / n) * (g - 1)) / (good / n * (1 - good / n) * (n - nn / n - (g - 1))) END AS rho FROM moments),
strengths AS (
  SELECT coalesce(max(k) FILTER (level = 1), 1000.0) AS k_host, coalesce(max(k) FILTER (level = 2), 1000.0) AS k_domain, coalesce(max(k) FILTER (level = 3), 1000.0) AS k_suffix
  FROM (SELECT level, CASE WHEN rho > 0 THEN round(least(1000.0, greatest(1.0, 1 / rho - 1)), 6) ELSE 1000.0 END AS k FROM rhos)),
overall AS (SELECT (coalesce(sum(good), 0) + 1.0) / (coalesce(sum(n), 0) + 2.0) AS rate FROM suffixes),
m3 AS (SELECT suffix, (good + rate * k_suffix) / (n + k_suffix) AS mean FROM suffixes, strengths, overall),
m2 AS (SELECT domain, (good + mean * k_domain) / (n + k_domain) AS mean FROM domains JOIN m3 USING (suffix), strengths),
m1 AS (SELECT host, n, (good + mean * k_host) / (n + k_host) AS mean, n + k_host AS size FROM hosts JOIN m2 USING (domain), strengths),
judged AS (SELECT page_id, host, path, n, mean, mean + 1.645 * sqrt(mean * (1 - mean) / (size + 1)) AS upper_,
  CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
       WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
       WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
       WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
       WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM urls JOIN m1 USING (host))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN upper_ < 0.5 THEN 'block' ELSE 'allow' END AS verdict,
  n::BIGINT AS labelled, round(mean, 6) AS good_rate, round(upper_, 6) AS good_upper FROM judged
""",
    "op4_source_mixing": r"""
WITH d AS (
  SELECT doc_id, source, length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(concat_ws('|', '7', doc_id::VARCHAR)) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 2 * source_size AS cap, ([3.0, 1.0, 2.0]::DOUBLE[])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM w),
t AS (SELECT source, source_size, least(cap::DOUBLE, max(lvl) OVER () * weight) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS each_,
  ('0x' || md5(concat_ws('|', '7', 'offset', coalesce(source, '')))[1:13])::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS off FROM t),
r AS (SELECT d.doc_id, d.size, e.source_size, e.target, each_, off,
  (row_number() OVER (PARTITION BY d.source ORDER BY size, h, doc_id) - 1)::DOUBLE AS k FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, ((floor((k + 1) * each_ + off) - floor(k * each_ + off)) * size)::BIGINT AS taken FROM r
""",
    "op9_exact_dedup": r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
g AS (SELECT doc_id, body, first_value(doc_id) OVER (PARTITION BY body ORDER BY n_chars DESC, doc_id NULLS LAST) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(body) AS text_sha256 FROM g
""",
    "op11_source_divergence": r"""
WITH d AS (SELECT coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row_ FROM documents),
words AS (
  SELECT row_, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n_lang FROM words GROUP BY lang, term HAVING count(DISTINCT row_) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(n_lang) AS total_lang FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
groups_ AS (SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v, coalesce(total_lang, 0) AS total_lang
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN langs USING (lang) LEFT JOIN totals USING (lang, source)),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (g.total + 5 * g.v) AS p,
         1 + (1000000000::HUGEINT * (n_lang + 5)) // (g.total_lang + 5 * g.v) AS q
  FROM groups_ g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0)::BIGINT AS value
  FROM groups_ a JOIN groups_ b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
""",
    # a match starts behind the text before it and the matches before it
    "op13_secret_scan": r"""
WITH d AS (SELECT row_number() OVER () AS row_, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner FROM documents),
patterns(kind, pattern, grp) AS (VALUES (0, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2),
  (1, 'AKIA[A-Z0-9]+', 0), (2, '[0-9a-f]{32,}', 0), (3, '[A-Za-z0-9+/_-]{20,}={0,2}', 0)),
parts AS (SELECT row_, doc_id, owner, kind, string_split_regex(text, pattern) AS gaps, regexp_extract_all(text, pattern) AS hits,
    CASE WHEN grp = 2 THEN regexp_extract_all(text, pattern, 2) ELSE regexp_extract_all(text, pattern) END AS vals
  FROM d, patterns WHERE regexp_matches(text, pattern)),
each_ AS (SELECT row_, doc_id, owner, kind, gaps, hits, vals, unnest(range(1, len(hits) + 1)) AS i FROM parts),
found AS (SELECT row_, doc_id, owner, kind, vals[i] AS val, length(array_to_string(gaps[1:i], '')) + length(array_to_string(hits[1:i - 1], '')) AS start_, length(hits[i]) AS size_ FROM each_),
base AS (SELECT * FROM found WHERE kind = 0 AND length(val) >= 8 OR kind = 1 AND size_ >= 16 OR kind = 2),
live AS (SELECT * FROM found f WHERE kind = 3 AND len(list_distinct(string_split(val, ''))) >= 12 AND regexp_matches(val, '[A-Z]') AND regexp_matches(val, '[a-z]') AND regexp_matches(val, '[0-9]')
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.row_ = f.row_ AND b.start_ < f.start_ + f.size_ AND f.start_ < b.start_ + b.size_)),
all_ AS (SELECT * FROM base UNION ALL SELECT * FROM live),
owners AS (SELECT val, count(DISTINCT owner) AS owners FROM all_ GROUP BY val),
spans AS (SELECT row_, kind, start_, owners, ['assign', 'access', 'hex', 'live'][kind + 1] || ':' || start_ || ':' || (start_ + size_) AS span
  FROM all_ JOIN owners USING (val) WHERE kind < 3 OR owners = 1),
lists AS (SELECT row_, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_live,
  string_agg(span, ',' ORDER BY start_, kind) FILTER (kind < 3) AS base_spans, string_agg(span, ',' ORDER BY start_, kind) AS spans,
  count(*) FILTER (owners = 1) AS n_owned, count(*) FILTER (owners = 2) AS n_shared, count(*) FILTER (owners >= 3) AS n_example FROM spans GROUP BY row_)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_live, 0) AS n_live,
  sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_owned, 0) AS n_owned, coalesce(n_shared, 0) AS n_shared, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN lists USING (row_)
""",
    "op12_conversation_repair": _repair_sql(),
}
