"""The registered queries of the ten operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm import bpe, chat, filter_audit, html_extraction, media, packing, quality_classifier, quality_rules, sharding, simhash, spelling, suffix_dedup, url_filter
from tallywright.llm.common import table

#: Host, path and verdict of the URL rules.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {_RULES_SQL} AS t(host, path, verdict)")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.audio(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, model, keep=["doc_id"]).select("doc_id", "held_out", "score", "predicted")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    own = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    return chat.digests(chat.render(chat.fold(chat.as_events(rows.unionByName(own)))))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extraction.extract(pages, html_extraction.train(html_extraction.labelled(pages)), keep=["page_id", "url"])


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_suffix_array_dedup, op2_simhash_near_dedup, op3_url_filters, op4_quality_rules, op5_best_fit_packing, op6_media_columns, op7_quality_classifier, op8_chat_formatting, op9_bpe, op10_sharding, op11_filter_interactions, op12_html_extraction, op13_spelling_variants)}

_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)

ORACLE_SQL = {
    "op3_url_filters": f"""
WITH rules(rh, rp, rv) AS (VALUES {_RULES_SQL}),
rest AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS r FROM pages),
split AS (SELECT k, page_id, coalesce(translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
fit AS (SELECT k, max_by(rh || rp, length(rh) + length(rp)) AS rule, max_by(rv, length(rh) + length(rp)) AS rv FROM split, rules
  WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM split LEFT JOIN fit USING (k)
""",
    "op8_chat_formatting": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS lost,
  sum(23 + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(lost) AS loss_chars, sha256(lost) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
""",
    "op11_filter_interactions": r"""
WITH RECURSIVE told AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INT)) AS good, max(CAST(coalesce(toxic = 1, false) AS INT)) AS toxic
  FROM labels GROUP BY doc_id),
words AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
masks AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CAST(len(w) < 200 AS INT) + 2 * CAST(100 * list_unique(w) < 50 * len(w) AS INT)
  + 4 * CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) AS INT)
  + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INT) AS mask
  FROM words LEFT JOIN told USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY ALL),
letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
grown AS (SELECT '' AS prefix, '' AS letter, 0 AS step, 0 AS before, 0 AS bit
  UNION ALL SELECT prefix || l.letter, l.letter, step + 1, before | g.bit, l.bit FROM grown g JOIN letters l ON ((before | g.bit) & l.bit) = 0),
each AS (SELECT part, prefix, letter, step, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept,
  coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS removed, coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0) AS redundant,
  coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails, coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS good_lost,
  coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS toxic_lost FROM grown, cells WHERE step > 0 GROUP BY ALL),
orders AS (SELECT prefix AS filter_order FROM grown WHERE step = 5),
listed AS (SELECT part, filter_order, letter, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost FROM orders JOIN each ON starts_with(filter_order, prefix))
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM listed
""",
    # The table's pages mark their article plainly; this reads that mark, and shows that the model finds the same.
    "op12_html_extraction": r"""
WITH a AS (SELECT row_number() OVER () AS k, page_id, url,
  regexp_split_to_array(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?b>', '', 'g'), '</?(p|h1)>') AS x FROM pages),
b AS (SELECT k, page_id, url, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS t FROM a),
c AS (SELECT k, page_id, url, i, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(
  t, '<br>', ' '), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#x27;', chr(39)), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS t FROM b),
d AS (SELECT k, page_id, url, coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (t <> ''), '') AS text FROM c GROUP BY k, page_id, url)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d
""",
    "op13_spelling_variants": r"""
WITH RECURSIVE bits(b, k, c) AS (SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL SELECT b, k + 1, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) FROM bits WHERE k < 8),
first AS (SELECT b, c FROM bits WHERE k = 8),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS d,
  unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents),
counted AS (SELECT d, w, count(*) AS n, hex(encode(d || w)) AS x FROM runs GROUP BY d, w),
longest AS (SELECT coalesce(max(length(x)) // 2, 0) AS most FROM counted),
shifted(b, k, c) AS (SELECT b, 0, c FROM first
  UNION ALL SELECT s.b, k + 1, xor(s.c >> 8, f.c) FROM shifted s JOIN first f ON f.b = s.c & 255 WHERE k + 1 < (SELECT most FROM longest)),
bytes AS (SELECT d, w, length(x) // 2 AS m, unnest(range(0, length(x) // 2)) AS i, x FROM counted),
sums AS (SELECT d, w, bit_xor(c) AS c, any_value(m) AS m FROM (SELECT d, w, m, m - 1 - i AS k,
  CAST(('0x' || substr(x, 2 * i + 1, 2)) AS BIGINT) AS b FROM bytes) JOIN shifted USING (b, k) GROUP BY d, w),
head(m, c) AS (SELECT 0, CAST(4294967295 AS BIGINT)
  UNION ALL SELECT m + 1, xor(h.c >> 8, f.c) FROM head h JOIN first f ON f.b = h.c & 255 WHERE m < (SELECT most FROM longest)),
hashed AS (SELECT w, n, xor(xor(sums.c, head.c), 4294967295) AS h FROM sums JOIN head USING (m) JOIN counted USING (d, w)),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
rests AS (SELECT word, n, pos, substr(word, 1, pos - 1) || substr(word, pos + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS pos FROM words)),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM rests a JOIN rests b ON a.rest = b.rest AND a.pos = b.pos AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM rests a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM rests a JOIN words b ON a.rest = b.word),
ranked AS (SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS r FROM near),
placed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.r = 1),
ways(word, root) AS (SELECT word, word FROM placed WHERE form IS NULL UNION ALL SELECT p.word, y.root FROM placed p JOIN ways y ON p.form = y.word)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM placed JOIN ways USING (word)
""",
}
