"""Identifier columns: accessions out of tool notations, canonical pairs, canonical paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed format: a capital letter, a digit, six more capitals or digits, and for an isoform a hyphen and its number.
ACCESSION = r"(?:^|[^A-Z0-9])([A-Z][0-9][A-Z0-9]{6}(?:-[0-9]+)?)(?![A-Z0-9])"
BARE = r"\A[A-Z][0-9][A-Z0-9]{6}\z"


def accession(value: Column | str) -> Column:
    """The bare accession inside any tool's or database's notation.

    Null and blank give null. A value that holds no accession stands for itself: trimmed, in upper case.
    """
    c = F.col(value) if isinstance(value, str) else value
    plain = F.upper(F.regexp_replace(c, r"\A[\s\p{Z}]+|[\s\p{Z}]+\z", ""))
    found = F.regexp_extract(plain, ACCESSION, 1)
    return F.when(c.rlike(BARE), c).otherwise(
        F.when(plain == "", F.lit(None).cast("string")).otherwise(F.when(found == "", plain).otherwise(found))
    )


def number_or_null(value: Column | str) -> Column:
    """NaN is a missing score, like null."""
    c = F.col(value) if isinstance(value, str) else value
    return F.when(~F.isnan(c), c)


def ends(query: str = "query", target: str = "target") -> list[Column]:
    """`protein_a`, `protein_b`: both accessions, the smaller first, each null where the end is missing."""
    q, t = accession(query), accession(target)
    return [q.alias("_q"), t.alias("_t")]


def canonical_path(path: Column | str) -> Column:
    """One spelling per file: empty and `.` segments dropped, `..` resolved, a leading slash kept."""
    c = F.col(path) if isinstance(path, str) else path
    parts = F.aggregate(
        F.split(F.trim(c), "/"),
        F.array().cast("array<string>"),
        lambda acc, x: F.when((x == "") | (x == "."), acc)
        .when((x == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(x))),
    )
    out = F.concat(F.when(F.trim(c).startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(parts, "/"))
    return F.when(F.trim(c) == "", F.lit(None).cast("string")).otherwise(out)
