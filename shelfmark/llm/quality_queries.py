"""Queries on text statistics and text types."""

from pyspark.sql import functions as F

from shelfmark.llm import quality as q
from shelfmark.session import table


def p8_found(spark, sf_dir):
    return q.text_types(table(spark, sf_dir, "documents")).where("p_prose < 0.5").select("doc_id")


def p8_types(spark, sf_dir):
    """Posterior text types."""
    return q.text_types(table(spark, sf_dir, "documents")).select("doc_id", "text_type", *[f"p_{t}" for t in q.TYPES])


def p8_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return q.with_statistics(docs, q.common_words(docs)).select("doc_id", "n_words", *[F.round(c, 9).alias(c) for c in ("mean_word_length", "symbol_share", "line_stop_share", "common_share")])


QUERIES = {"p8_found": p8_found, "p8_types": p8_types, "p8_stats": p8_stats}
ORACLE = {
    "p8_stats": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN regexp_matches(lang, '^[a-z]{2,3}$') THEN lang ELSE 'und' END AS lang, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
n AS (SELECT lang, count(*) AS n FROM d GROUP BY lang HAVING count(*) >= 8),
c AS (SELECT DISTINCT word FROM (SELECT lang, word, count(*) AS k FROM (SELECT lang, unnest(list_distinct(w)) AS word FROM d) GROUP BY lang, word) JOIN n USING (lang) WHERE k >= 0.25 * n.n),
s AS (SELECT doc_id, count(*) FILTER (word IN (SELECT word FROM c)) AS k FROM (SELECT doc_id, unnest(w) AS word FROM d) GROUP BY doc_id),
e AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '\S')) AS l FROM d)
SELECT d.doc_id, len(w)::BIGINT AS n_words,
  round(CASE WHEN len(w) = 0 THEN 0 ELSE list_sum(list_transform(w, lambda x: length(x))) / len(w) END, 9) AS mean_word_length,
  round(coalesce(length(regexp_replace(t, '[\p{L}\p{N} \t\n\r\f]', '', 'g')) / nullif(length(regexp_replace(t, '[ \t\n\r\f]', '', 'g')), 0), 0), 9) AS symbol_share,
  round(coalesce(len(list_filter(l, lambda x: regexp_matches(x, '[.!?…。！？]["''”’»)\]]*\s*$'))) / nullif(len(l), 0), 0), 9) AS line_stop_share,
  round(coalesce(s.k / nullif(len(w), 0), 0), 9) AS common_share
FROM d JOIN e USING (doc_id) LEFT JOIN s USING (doc_id)"""
}
