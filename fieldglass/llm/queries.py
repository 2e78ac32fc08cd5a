"""The registered queries of the corpus operators, with their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldglass.llm import (
    bpe, chat, collocations, decontaminate as leaks, hard_negatives, near_dup, packing, pii, quality_qda, quality_rules as rules, shards,
    toxicity, wrapper,
)
from fieldglass.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run
    return add


RULES_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text,
    list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    string_split(text, chr(10)) AS all_lines
  FROM d),
l AS (
  SELECT *, list_filter(all_lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
tri AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS t
  FROM l, unnest(range(1, len(words) - 1)) AS r(i)),
again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM tri) WHERE c > 1),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
judged AS (
  SELECT doc_id, len(words) AS n_words,
    coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words,
    coalesce(list_sum(list_transform(
      list_filter(lines, lambda x:
        length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) * 10
          >= len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) * 3
        OR (regexp_matches(x, '[A-Z]{{3}}') AND length(regexp_replace(x, '[^A-Za-z]+', '', 'g')) >= 20
            AND length(regexp_replace(x, '[^A-Z]+', '', 'g')) * 10 > length(regexp_replace(x, '[^A-Za-z]+', '', 'g')) * 7)
        OR (len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) >= 10
            AND len(list_distinct(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> ''))) * 10
              < len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) * 3)
        OR regexp_matches(lower(x), '{boilerplate}')
        OR (len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) <= 3
            AND NOT regexp_matches(rtrim(x, ' '), '[.!?\x{{2026}}:;][\x22''\x{{201d}}\x{{bb}})\]]*$'))),
      lambda x: length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')))), 0)::BIGINT AS lost
  FROM l LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost * 100 <= word_chars * 50) AS kept
FROM judged
""".format(boilerplate="|".join(rules.BOILERPLATE))


@query("op7_quality_rules", RULES_SQL)
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op4_bpe_round_trip")
def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"))
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


LEAKS_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS t
  FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
found AS (
  SELECT doc_id, i, size, item_id FROM (
    SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS t
    FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS r(i))
  JOIN windows USING (size, t)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op9_decontaminate", LEAKS_SQL)
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


#: Shingles, all pairs that share one, exact overlap, and components over them.
NEAR_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(2, len(w)) - 1], ' ') AS t
  FROM d, unnest(range(1, len(w) - least(2, len(w)) + 2)) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS joint
  FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * joint >= 80 * (x.n + y.n - joint)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id, doc_id AS seen FROM n
  UNION
  SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.seen),
c AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id,
  coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


@query("op8_near_dup", NEAR_SQL)
def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), words_per_shingle=2)


@query("op10_shards")
def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign_shards(table(spark, sf_dir, "documents"))


@query("op3_main_text")
def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wrapper.extract_main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op5_quality_qda")
def op5_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_qda.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_toxicity_svm")
def op2_toxicity_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_pii")
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *(pii.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.KINDS),
        F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"),
    )


VIEWS_SQL = r"""
WITH m AS (
  SELECT conv_id, turn, CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown' ELSE trim(role) END AS speaker,
    coalesce(text, '') AS text, count(*) AS copies
  FROM conversations GROUP BY ALL),
k AS (
  SELECT *, floor(turn / 64)::BIGINT AS segment,
    ('0x' || md5(speaker || chr(31) || text)[1:8])::BIGINT AS digest FROM m),
c AS (
  SELECT *, count(*) OVER (PARTITION BY conv_id, segment) > 512 AS crowded,
    count(*) OVER (PARTITION BY conv_id, turn) AS heap FROM k),
s AS (
  SELECT *, CASE WHEN crowded THEN turn END AS sub,
    CASE WHEN crowded THEN floor(digest * ceil(heap / 512) / 4294967296)::BIGINT ELSE 0 END AS part FROM c),
v AS (SELECT DISTINCT conv_id, speaker AS view FROM s WHERE speaker <> 'system'),
p AS (
  SELECT s.*, view, speaker = view AS own,
    CASE WHEN speaker = 'system' THEN '<|im_start|>system' || chr(10)
      WHEN speaker = view THEN '<|im_start|>assistant' || chr(10)
      ELSE '<|im_start|>user name=' || regexp_replace(speaker, '[\x00-\x20<>|]+', '_', 'g') || chr(10) END AS head
  FROM s JOIN v ON s.conv_id IS NOT DISTINCT FROM v.conv_id),
o AS (
  SELECT *, coalesce(sum(length(head) + length(text) + 11) OVER (
      PARTITION BY conv_id, view, segment, sub, part ORDER BY turn, digest, speaker, text
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start
  FROM p)
SELECT conv_id, view, segment, sub, part, count(*) AS n_messages, sum(copies)::BIGINT AS n_copies,
  md5(string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY turn, digest, speaker, text)) AS rendered_md5,
  coalesce(string_agg(CASE WHEN own THEN start::BIGINT || ':' || (start + length(text) + 11)::BIGINT END, ','
    ORDER BY turn, digest, speaker, text), '') AS masks
FROM o GROUP BY conv_id, view, segment, sub, part
"""


@query("op1_chat_views", VIEWS_SQL)
def op1_chat_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = chat.rotate(table(spark, sf_dir, "conversations"))
    return views.select(
        "conv_id", "view", "segment", "sub", "part", "n_messages", "n_copies",
        F.md5("rendered").alias("rendered_md5"),
        F.array_join(F.transform("masks", lambda m: F.concat_ws(
            ":", m["start"].cast("string"), m["end"].cast("string"))), ",").alias("masks"),
    )


PHRASES_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, size, phrase, count(*)::HUGEINT AS a FROM (
    SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
    FROM w, range(1, 6) AS s(size), unnest(range(1, len(w) - size + 2)) AS r(i))
  GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS words FROM f WHERE size > 1),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(words[1:k], ' ') AS lhs, array_to_string(words[k + 1:size], ' ') AS rhs
  FROM c, unnest(range(1, size)) AS r(k)),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, x.a AS l, y.a AS r, n,
    (1000::HUGEINT * cuts.a * n) // (x.a * y.a) AS score, k,
    row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY (1000::HUGEINT * cuts.a * n) // (x.a * y.a), k) AS nth
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = lhs JOIN f y ON y.lang = cuts.lang AND y.phrase = rhs
    JOIN totals ON totals.lang = cuts.lang),
around AS (
  SELECT lang, phrase, max(a) AS most FROM (
    SELECT lang, a, array_to_string(words[i:i + s - 1], ' ') AS phrase
    FROM c, range(2, 5) AS q(s), unnest(range(1, size - s + 2)) AS r(i) WHERE s < size)
  GROUP BY ALL),
ranked AS (
  SELECT scored.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM scored LEFT JOIN around USING (lang, phrase) WHERE nth = 1 AND (most IS NULL OR 100 * most < 100 * a))
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""


@query("op11_collocations", PHRASES_SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.mine_collocations(table(spark, sf_dir, "documents"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@query("op12_packing")
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


NEGATIVES_SQL = r"""
WITH e AS (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id,
  (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id))::INTEGER AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 5
"""


@query("op13_hard_negatives", NEGATIVES_SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)
