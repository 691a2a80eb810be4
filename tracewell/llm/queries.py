"""The queries of this subpackage over the given tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import (
    chat,
    clean,
    decontam,
    lexical,
    packing,
    phrases,
    pii,
    quality,
    shards,
    simhash,
    suffixes,
    tokens,
    warc,
)
from tracewell.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return run

    return register


@query("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item, len(w[a : a + 9]) AS n, array_to_string(w[a : a + 9], ' ') AS win
  FROM i, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s(a) WHERE len(w) > 0
), dw AS (
  SELECT doc_id, a, n, array_to_string(w[a : a + n - 1], ' ') AS win
  FROM d, (SELECT DISTINCT n FROM iw), unnest(range(1, len(w) - n + 2)) AS s(a)
), m AS (
  SELECT DISTINCT doc_id, a, n, item FROM dw JOIN iw USING (n, win)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(range(a, a + n)) AS s(p) GROUP BY 1
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY 1
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@query("op2_decontamination", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


OP4_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS body,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)),
      lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), win AS (
  SELECT doc_id, x.a AS a, count(*) OVER (PARTITION BY doc_id, x.s) AS n
  FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 6),
    lambda a: {'a': a, 's': array_to_string(w[a : a + 7], ' ')})) AS x FROM t)
), rep AS (
  SELECT doc_id, sum(least(8, coalesce(following - a, 8))) AS n_repeat FROM (
    SELECT doc_id, a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS following
    FROM win WHERE n > 1) GROUP BY 1
), judged AS (
  SELECT *, list_filter(lines, lambda l: NOT (
      100 * (length(l) - length(regexp_replace(l, '[#*$%&|<>]', '', 'g'))) > 30 * nw(l)
      OR 100 * (length(l) - length(regexp_replace(l, '[!?]', '', 'g'))) > 60 * nw(l)
      OR length(l) - length(regexp_replace(l, '[|»›·•]', '', 'g')) > 2
      OR (nw(l) <= 40 AND regexp_matches(l, '(?i)all rights reserved|cookie policy|accept cookies|privacy policy|terms of service|terms of use|enable javascript|sign in|log in|subscribe to our newsletter|licensed under|share on|read more|click here|skip to content'))
    )) AS good
  FROM t
), counted AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(good))::BIGINT AS n_bad_lines,
    (length(array_to_string(w, '')) - length(regexp_replace(array_to_string(good, ''),
      '[\x20\x09-\x0D]+', '', 'g')))::BIGINT AS lost_chars
  FROM judged LEFT JOIN rep USING (doc_id)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
    AND 100 * lost_chars <= 30 * word_chars AS kept
FROM counted
""".replace("nw(l)", r"len(regexp_extract_all(l, '[^\x20\x09-\x0D]+'))")


@query("op4_line_cleaning", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return clean.judged(docs).drop("text", "clean_text")


@query("op5_minimax_shards")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.minimax_shards(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op6_personal_data")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


@query("op9_kneser_ney")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return quality.verdicts(docs, table(spark, sf_dir, "labels"), keep_text=False)


@query("op10_simhash")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


_CANON = """
  CASE WHEN host = '' THEN bare ELSE host || path || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END
"""
OP3_SQL = f"""
WITH parts AS (
  SELECT page_id, url, html, regexp_replace(trim(coalesce(url, '')), '#.*$', '') AS bare FROM pages
), cut AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare,
      '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), '^www[0-9]*[.]', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '[?](.*)$', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|fbclid|gclid|ref)(=|$)'))), '&') AS kept
  FROM parts
), p AS (
  SELECT page_id, url, {_CANON} AS u, md5(coalesce(html, '')) AS h,
    strlen(coalesce(html, '')) AS size, 'day ' || (page_id // 3) AS day FROM cut
), candidates AS (
  SELECT r.page_id, r.url, r.u, r.day AS rday, r.h AS rh, t.page_id AS tid, t.h AS th, t.size, t.day,
    row_number() OVER (PARTITION BY r.page_id ORDER BY t.page_id DESC NULLS LAST) AS rn
  FROM p r LEFT JOIN p t ON r.u = t.u
    AND t.page_id <= r.page_id + CASE WHEN r.page_id % 11 = 0 THEN -1 ELSE 7 END
), checked AS (
  SELECT *, CASE WHEN page_id % 7 = 0 THEN 'other' ELSE rh END AS rtag,
    CASE WHEN tid % 5 <> 0 THEN th END AS ttag,
    CASE WHEN page_id % 4 <> 0 THEN rday END AS rdate,
    CASE WHEN tid % 10 <> 0 THEN day END AS tdate
  FROM candidates WHERE rn = 1
), decided AS (
  SELECT *, CASE WHEN tid IS NULL THEN 'no_response'
    WHEN ttag IS NOT NULL THEN CASE WHEN ttag = rtag THEN 'resolved' ELSE 'changed' END
    WHEN tdate IS NOT NULL AND rdate IS NOT NULL
      THEN CASE WHEN tdate = rdate THEN 'resolved' ELSE 'changed' END
    ELSE 'no_validator' END AS status
  FROM checked
)
SELECT page_id * 2 + 1 AS record_id, url, u AS canonical_url, tid * 2 AS target_id, status,
  CASE WHEN status = 'resolved' THEN
    'cache-control: max-age=0; content-length: ' || size || '; content-type: text/html; date: tick '
    || page_id || '; etag: ' || CASE WHEN page_id % 7 = 0 THEN '"other"' ELSE 'W/"' || rh || '"' END
    || CASE WHEN coalesce(rdate, tdate) IS NOT NULL
       THEN '; last-modified: ' || coalesce(rdate, tdate) ELSE '' END
  END AS headers
FROM decided
"""


@query("op3_warc_revisits", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.crawl_of(table(spark, sf_dir, "pages")))
    lines = F.transform(
        F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])
    )
    return found.withColumn("headers", F.array_join(lines, "; "))


@query("op7_trie_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations
), who AS (
  SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'
), v AS (
  SELECT t.*, perspective, role = perspective AS own,
    CASE WHEN role = perspective THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>'
      ELSE '<|user ' || role || '|>' END || chr(10) AS mark
  FROM t JOIN who USING (conv_id)
), p AS (
  SELECT *, mark || text || '<|end|>' || chr(10) AS piece FROM v
), o AS (
  SELECT *, coalesce(sum(length(piece)) OVER w, 0)::BIGINT AS pos, row_number() OVER w AS nth
  FROM p WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn, role, text
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT conv_id, perspective, pos // 65536 AS chunk, min(pos) AS start, count(*) AS n_turns,
  sha256(string_agg(piece, '' ORDER BY turn, role, text)) AS text_sha256,
  coalesce(string_agg((pos + length(mark)) || ':' || (pos + length(piece)), ','
    ORDER BY turn, role, text) FILTER (WHERE own), '') AS masks
FROM o GROUP BY 1, 2, 3
"""


@query("op8_perspective_rotation", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = chat.rotate(table(spark, sf_dir, "conversations"))
    ranges = F.transform(
        "masks", lambda m: F.concat(m["start"].cast("string"), F.lit(":"), m["end"].cast("string"))
    )
    return views.select(
        "conv_id",
        "perspective",
        "chunk",
        "start",
        "n_turns",
        F.sha2("text", 256).alias("text_sha256"),
        F.array_join(ranges, ",").alias("masks"),
    )


OP11_SQL = """
WITH d AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h
  FROM documents
), parts AS (
  SELECT doc_id, c, substr(h, 2 * c + 1, 710) AS part, least(256, n - 99 - c) AS size
  FROM d, unnest(range(0, n - 99, 256)) AS t(c)
), again AS (
  SELECT doc_id, s FROM (
    SELECT doc_id, c + i AS s, row_number() OVER (PARTITION BY unhex(substr(part, 2 * i + 1, 200))
      ORDER BY doc_id, c + i) AS nth
    FROM parts, unnest(range(0, size)) AS w(i))
  WHERE nth > 1
), runs AS (
  SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM (
    SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM (
      SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 100
        THEN 0 ELSE 1 END AS fresh FROM again))
  GROUP BY doc_id, run
), cut AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, min(a) AS first,
    string_agg(substr(h, 2 * b + 1, 2 * (following - b)), '' ORDER BY a) AS rest
  FROM (SELECT r.*, d.h, coalesce(lead(a) OVER (PARTITION BY r.doc_id ORDER BY a), n) AS following
    FROM runs r JOIN d ON r.doc_id = d.doc_id)
  GROUP BY doc_id
)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN first IS NULL THEN h ELSE substr(h, 1, 2 * first) || rest END))
    AS kept_sha256
FROM d LEFT JOIN cut ON d.doc_id = cut.doc_id
"""


@query("op11_repeated_windows", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.without_repeats(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents
), f AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*)::HUGEINT AS f
  FROM p, unnest(range(1, 5)) AS s(k), unnest(range(1, len(w) - k + 2)) AS t(i) GROUP BY ALL
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY 1
), c AS (
  SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30
), cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, cut, l.f AS l, r.f AS r, 2000000 * c.f // (l.f + r.f) AS score
  FROM c, unnest(range(1, c.k)) AS s(cut)
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : cut], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1 : c.k], ' ')
), worst AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inside AS (
  SELECT lang, array_to_string(w[i : i + size - 1], ' ') AS phrase, max(f) AS most
  FROM c, unnest(range(2, k)) AS s(size), unnest(range(1, k - size + 2)) AS t(i) GROUP BY 1, 2
), ranked AS (
  SELECT worst.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM worst LEFT JOIN inside USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * a
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query("op12_collocations", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), q AS (
  SELECT item_id, t, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
    FROM benchmark) GROUP BY 1, 2
), s AS (
  SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d
), tf AS (
  SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d)
  WHERE t IN (SELECT t FROM q) GROUP BY 1, 2
), weights AS (
  SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS weight
  FROM tf, s GROUP BY 1
), lengths AS (
  SELECT doc_id, 100 - 25 + (25 * len(w) * n_docs) // n_terms AS m FROM d, s
), scores AS (
  SELECT item_id, doc_id, sum(times * weight
    * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM tf JOIN weights USING (t) JOIN lengths USING (doc_id) JOIN q USING (t) GROUP BY 1, 2
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER
  AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 20
"""


@query("op13_lexical_search", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
