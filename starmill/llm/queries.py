"""One query per operator, over whole tables, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starmill.llm import (
    bpe,
    decontaminate,
    filter_audit,
    html_extract,
    mixing,
    pii,
    prefix_trie,
    quality_model,
    quality_rules,
    sentence_dedup,
    simhash,
    url_filter,
    warc,
)
from starmill.sources.workdir import fresh_path

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Verdict, host, path.
URL_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]


#: Rank file of the public tokenizers.
TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.filter_urls(pages, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_pages(spark, path)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return decontaminate.contamination(docs, items)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = quality_rules.ledger(table(spark, sf_dir, "documents"))
    judged = quality_rules.apply_policy(stored, quality_rules.PRODUCTION)
    judged = judged.withColumn("base_failed", ~quality_rules.passes(judged.fail_bits, "base"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    return quality_model.quality_scores(docs, labels)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    return mixing.mixing_rates(docs, labels)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path(TOKENIZER))
    docs = table(spark, sf_dir, "documents")
    tokens = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2(bpe.decoded(tokens, ranks, F.col("ids")), 256).alias("decoded_sha256"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    return filter_audit.audit(docs, labels)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_url_filter,
        op2_warc,
        op3_decontaminate,
        op4_pii,
        op5_quality_rules,
        op6_html_extract,
        op7_sentence_dedup,
        op8_quality_model,
        op9_mixing,
        op10_simhash,
        op11_prefix_trie,
        op12_bpe,
        op13_filter_audit,
    )
}

QUALITY_RULES = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), windows AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), twice AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1
), repeats AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice)
  GROUP BY r
), lines AS (
  SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(lines.dup, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words,
    coalesce(lines.n, 0) AS n_lines,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper
  FROM d JOIN w USING (r) LEFT JOIN lines USING (r) LEFT JOIN repeats USING (r)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_upper > 3 * word_chars
    OR word_chars < 3 * n_words OR word_chars > 10 * n_words
    OR 10 * n_dup_lines > 3 * n_lines) AS kept
FROM b
"""

URL_FILTER = r"""
WITH p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), r AS (
  SELECT *, '.' || host AS h FROM p
), m AS (
  SELECT page_id, host, path, CASE
    WHEN ends_with(h, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ends_with(h, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ends_with(h, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ends_with(h, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM r
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM m
"""

WARC = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS t FROM pages
), d AS (
  SELECT page_id, octet_length(encode(t)) AS payload_bytes, sha1(t) AS hex,
    min(page_id) OVER (PARTITION BY sha1(t)) AS owner
  FROM p
), b AS (
  SELECT *, list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(hex, CAST(5 * (k // 4) + 1 AS BIGINT), 5) AS BIGINT)
      >> CAST(15 - 5 * (k % 4) AS BIGINT)) & 31 AS BIGINT), 1)
    for k in range(0, 32)], 'string_agg', '') AS payload_digest
  FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM b
"""

FILTER_AUDIT = r"""
WITH RECURSIVE first_of AS (
  SELECT coalesce(text, '') AS t, min(doc_id) AS least FROM documents GROUP BY 1
), known AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
    max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), d AS (
  SELECT d.doc_id, coalesce(d.lang, '') AS part, coalesce(d.text, '') AS t,
    regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+') AS ws,
    coalesce(d.doc_id > f.least, false) AS e, coalesce(k.good, 0) AS good, coalesce(k.toxic, 0) AS toxic
  FROM documents d JOIN first_of f ON f.t = coalesce(d.text, '')
  LEFT JOIN known k ON k.doc_id = d.doc_id
), judged AS (
  SELECT part, good, toxic, len(ws) < 100 AS a, 100 * len(list_distinct(ws)) < 80 * len(ws) AS b,
    100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS d, e
  FROM d
), cell AS (
  SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END
    || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END
    || CASE WHEN e THEN 'E' ELSE '' END AS failed,
    count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM judged GROUP BY ALL
), orders AS (
  SELECT '' AS o
  UNION ALL
  SELECT o || f FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE NOT contains(o, f)
), steps AS (
  SELECT o, s, substr(o, s, 1) AS f, substr(o, 1, s - 1) AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s) WHERE length(o) = 5
), counted AS (
  SELECT part, o, s, f,
    sum(CASE WHEN translate(failed, before || f, '') = failed THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(failed, f) AND translate(failed, before, '') = failed THEN n ELSE 0 END)
      AS removed,
    sum(CASE WHEN contains(failed, f) AND translate(failed, before, '') <> failed THEN n ELSE 0 END)
      AS redundant,
    sum(CASE WHEN failed = f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(failed, f) AND translate(failed, before, '') = failed THEN good ELSE 0 END)
      AS good_lost,
    sum(CASE WHEN contains(failed, f) AND translate(failed, before, '') = failed THEN toxic ELSE 0 END)
      AS toxic_lost
  FROM cell, steps GROUP BY part, o, s, f
)
SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
  CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""

PREFIX_TRIE = r"""
WITH RECURSIVE ids AS (
  SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL
), crc AS (
  SELECT c, CAST(4294967295 AS BIGINT) AS v, 0 AS i, CAST(c AS VARCHAR) AS s FROM ids
  UNION ALL
  SELECT c, CASE WHEN w & 1 = 1 THEN xor(w >> 1, CAST(3988292384 AS BIGINT)) ELSE w >> 1 END, i + 1, s
  FROM (
    SELECT c, i, s,
      CASE WHEN i % 8 = 0 THEN xor(v, CAST(ascii(substr(s, i // 8 + 1, 1)) AS BIGINT)) ELSE v END AS w
    FROM crc WHERE i < 8 * length(s)
  )
), h AS (
  SELECT c, xor(v, CAST(4294967295 AS BIGINT)) % 4 AS h FROM crc WHERE i = 8 * length(s)
), turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS t,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32))
      AS p
  FROM conversations WHERE conv_id IS NOT NULL
), rebuilt AS (
  SELECT h.c, b.role, b.t, b.p FROM h JOIN turns b ON b.c = h.c - h.c % 20 AND b.p <= h.h
  UNION ALL
  SELECT h.c, o.role, o.t, o.p FROM h JOIN turns o ON o.c = h.c AND o.p > h.h
), placed AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY p) AS d,
    sha256(length(role) || ':' || role || t) AS x,
    len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w
  FROM rebuilt
), paths AS (
  SELECT c, d, sha256(string_agg(x, '') OVER (PARTITION BY c ORDER BY d)) AS node, w FROM placed
  UNION ALL
  SELECT c, 0, '', 0 FROM h
), nodes AS (
  SELECT node, d, any_value(w) AS w, min(c) AS conv_id, count(*) AS n FROM paths GROUP BY node, d
), up AS (
  SELECT n.node, p.node AS above, p.d AS d
  FROM nodes n JOIN paths p ON p.c = n.conv_id AND p.d <= n.d
), kids AS (
  SELECT u.above AS node, count(*) AS n_children FROM up u JOIN nodes n USING (node)
  WHERE u.d = n.d - 1 GROUP BY u.above
), sums AS (
  SELECT u.above AS node, sum((n.n - 1) * n.w) AS saved,
    sum(CASE WHEN k.node IS NULL THEN 1 ELSE 0 END) AS leaves
  FROM up u JOIN nodes n USING (node) LEFT JOIN kids k ON k.node = n.node GROUP BY u.above
), ends AS (
  SELECT node, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS cs
  FROM paths JOIN (SELECT c, max(d) AS d FROM paths GROUP BY c) USING (c, d) GROUP BY node
), parents AS (
  SELECT u.node, n.conv_id AS parent FROM up u JOIN nodes m USING (node) JOIN nodes n ON n.node = u.above
  WHERE u.d = m.d - 1
)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.parent AS parent_conv_id,
  CAST(n.n AS BIGINT) AS n_convs, CAST(coalesce(k.n_children, 0) AS BIGINT) AS n_children,
  CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens,
  sha256(coalesce(e.cs, '')) AS ends_sha256
FROM nodes n LEFT JOIN parents p USING (node) LEFT JOIN kids k USING (node) JOIN sums s USING (node)
LEFT JOIN ends e USING (node)
"""

ORACLES: dict[str, str] = {
    "op1_url_filter": URL_FILTER,
    "op2_warc": WARC,
    "op5_quality_rules": QUALITY_RULES,
    "op11_prefix_trie": PREFIX_TRIE,
    "op13_filter_audit": FILTER_AUDIT,
}
