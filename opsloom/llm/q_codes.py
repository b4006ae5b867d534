"""Query of the vector code compression over `embeddings`, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opsloom.llm.grid_codes import ENTRIES, PARTS, ROUNDS, SCALE, compressed
from opsloom.llm.tables import read


def op12_grid_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The code and the errors of every usable vector."""
    return compressed(read(spark, folder, "embeddings")).drop("label")


def _codes_sql() -> str:
    """Every part against every entry, a pair of common table expressions a round."""
    steps = [
        f"""
kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, label, len(embedding) // {PARTS} AS width, embedding FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
p AS MATERIALIZED (
    SELECT r, i // width AS part, i % width AS position, floor({SCALE} * x::DOUBLE)::BIGINT AS c
    FROM (SELECT r, width, unnest(range(len(embedding))) AS i, unnest(embedding) AS x FROM kept)
),
b0 AS MATERIALIZED (
    SELECT part, entry, position, c
    FROM p JOIN (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {ENTRIES}) USING (r)
)"""
    ]
    for k in range(ROUNDS + 1):
        steps.append(
            f"""
a{k} AS MATERIALIZED (
    SELECT r, part, min(d * 256 + entry) % 256 AS entry, min(d * 256 + entry) // 256 AS d
    FROM (SELECT r, part, entry, sum((p.c - b.c) * (p.c - b.c)) AS d FROM p JOIN b{k} b USING (part, position) GROUP BY ALL)
    GROUP BY ALL
)"""
        )
        if k < ROUNDS:
            steps.append(
                f"""
s{k} AS (SELECT part, entry, position, sum(c) AS s, count(*) AS n FROM p JOIN a{k} USING (r, part) GROUP BY ALL),
b{k + 1} AS MATERIALIZED (
    SELECT part, entry, position, coalesce((s - (s % n + n) % n) // n, c)::BIGINT AS c
    FROM b{k} LEFT JOIN s{k} USING (part, entry, position)
)"""
            )
    return f"""
WITH {",".join(steps)},
codes AS (
    SELECT r, string_agg(printf('%02x', entry::INTEGER), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY r
),
digest AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, position)) AS h FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
FROM kept JOIN codes USING (r), digest
"""


CODES_SQL = _codes_sql()
