"""Queries on two copies of the pair table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.table_diff import similarity_copy_diff
from ..session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similarity_copy_diff(table(spark, sf_dir, "merged_protein_similarity"), table(spark, sf_dir, "merged_similarity_copy"))
    return found.select("protein_a", "protein_b", "split", "finding")


# The accession inside a notation, in DuckDB's dialect.
def acc_sql(c: str) -> str:
    return (
        f"nullif(coalesce(nullif(regexp_extract(upper({c}), '(^|[^A-Z0-9])([A-Z][0-9][A-Z0-9]{{6}}(-[0-9]+)?)($|[^A-Z0-9])', 2), ''), "
        f"upper(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'))), '')"
    )


def _side(t: str) -> str:
    score = ", ".join(f"CASE WHEN isnan({s}) THEN NULL ELSE {s} END AS {s}" for s in ("fident", "hfsp", "alntmscore"))
    return f"""SELECT least(q, t) AS protein_a, greatest(q, t) AS protein_b, split, fident, hfsp, alntmscore FROM (
      SELECT {acc_sql('query')} AS q, {acc_sql('target')} AS t, split, {score}, loaded_at FROM {t})
    WHERE q IS NOT NULL AND t IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY least(q, t), greatest(q, t), split
      ORDER BY loaded_at DESC NULLS LAST, fident DESC NULLS LAST, hfsp DESC NULLS LAST, alntmscore DESC NULLS LAST) = 1"""


P1_SQL = f"""WITH a AS ({_side('merged_protein_similarity')}), b AS ({_side('merged_similarity_copy')}),
j AS (SELECT coalesce(a.protein_a, b.protein_a) AS protein_a, coalesce(a.protein_b, b.protein_b) AS protein_b, coalesce(a.split, b.split) AS split,
        a.protein_a IS NULL AS no_a, b.protein_a IS NULL AS no_b,
        a.fident AS f1, b.fident AS f2, a.hfsp AS h1, b.hfsp AS h2, a.alntmscore AS t1, b.alntmscore AS t2
      FROM a FULL JOIN b ON a.protein_a = b.protein_a AND a.protein_b = b.protein_b AND a.split = b.split)
SELECT protein_a, protein_b, split, 'missing_in_copy' AS finding FROM j WHERE no_b
UNION ALL SELECT protein_a, protein_b, split, 'missing_in_original' FROM j WHERE no_a
UNION ALL SELECT protein_a, protein_b, split, 'fident' FROM j WHERE NOT no_a AND NOT no_b AND ((f1 IS NULL) <> (f2 IS NULL) OR abs(f1 - f2) > 0.00005)
UNION ALL SELECT protein_a, protein_b, split, 'hfsp' FROM j WHERE NOT no_a AND NOT no_b AND ((h1 IS NULL) <> (h2 IS NULL) OR abs(h1 - h2) > 0.00005)
UNION ALL SELECT protein_a, protein_b, split, 'alntmscore' FROM j WHERE NOT no_a AND NOT no_b AND ((t1 IS NULL) <> (t2 IS NULL) OR abs(t1 - t2) > 0.00005)"""

QUERIES = {"p1_found": p1_found}
SQL = {"p1_found": P1_SQL}
