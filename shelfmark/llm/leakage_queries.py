"""Queries on evaluation passages in documents."""

from shelfmark.llm.leakage import leaks, template_matches, verbatim
from shelfmark.session import table


def _matches(spark, sf_dir):
    return template_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p6_found(spark, sf_dir):
    return verbatim(_matches(spark, sf_dir))


def p6_leaks(spark, sf_dir):
    """Verbatim, re-parameterised and merely templated passages of each document and item."""
    return leaks(_matches(spark, sf_dir))


QUERIES = {"p6_found": p6_found, "p6_leaks": p6_leaks}
ORACLE = {
    "p6_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 8), lambda p: array_to_string(w[p:p + 9], ' '))) AS s FROM d WHERE len(w) >= 10),
iw AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 8), lambda p: array_to_string(w[p:p + 9], ' '))) AS s FROM i WHERE len(w) >= 10)
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw ON dw.s = iw.s"""
}
