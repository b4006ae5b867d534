"""Query of the source divergence audit over `documents`, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opsloom.llm.source_divergence import audit
from opsloom.llm.tables import read


def op13_count_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Every source's divergence from the others of its language, and the terms it uses more than its language."""
    return audit(read(spark, folder, "documents").select("lang", "source", "text"))


# The same by its definition: every source with every kept term, without cells.
DIVERGENCE_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
    FROM documents
),
o AS (
    SELECT r, lang, source,
        unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM d
),
kept AS (SELECT lang, term, count(*) AS n FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 10),
langs AS (SELECT lang, sum(n) AS total, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
held AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL),
filled AS (
    SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n, k.n AS lang_n
    FROM groups g JOIN kept k USING (lang) LEFT JOIN held h USING (lang, source, term)
),
summed AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total FROM filled),
shares AS (
    SELECT s.lang, source, term, n,
        1 + (1000000000::HUGEINT * (n + 2)) // (s.total + 2 * v) AS p,
        1 + (1000000000::HUGEINT * (lang_n + 2)) // (langs.total + 2 * v) AS q
    FROM summed s JOIN langs USING (lang)
),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
rows_of AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows_of
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM ranked WHERE part = 'pair' OR rank <= 10
"""
