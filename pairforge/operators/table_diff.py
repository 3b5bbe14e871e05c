"""Differences between two copies of a dataset, row by row and field by field.

Both copies are reduced to one row per key (map-side combined, so a key that holds a third of all rows costs one row
per task), cut into hash buckets and cogrouped as Arrow tables. In a bucket the keys are aligned by sorted search and
the fields compared through null-aware masks over whole columns; only the cells that a mask keeps come out.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 20_000


def latest_rows(df: DataFrame, keys: Sequence[str], fields: Sequence[str], version: str) -> DataFrame:
    """One row per key: the one with the latest `version`.

    Null versions are the oldest. Rows with equal versions are ordered by their fields in turn (null first), and the
    last counts, so the choice doesn't depend on the order of the input.
    """
    last = F.max(F.struct(F.col(version), *fields)).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_last.{f}").alias(f) for f in fields])


def _codes(left: pa.Table, right: pa.Table, keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Dense codes of the key tuples, equal in both tables for equal keys."""
    n, code = left.num_rows, None
    for k in keys:
        both = pa.chunked_array(left.column(k).chunks + right.column(k).chunks, type=left.schema.field(k).type)
        part = both.combine_chunks().dictionary_encode(null_encoding="encode")
        part = part.combine_chunks() if isinstance(part, pa.ChunkedArray) else part
        ids = part.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        code = ids if code is None else np.unique(code * (len(part.dictionary) + 1) + ids, return_inverse=True)[1]
    code = np.zeros(0, np.int64) if code is None else code
    return code[:n], code[n:]


def _apart(x: pa.Array, y: pa.Array, tolerance: float) -> np.ndarray:
    """Where two columns differ, nulls aside: whole numbers exactly, a NaN from every number and not from a NaN."""
    if pa.types.is_integer(x.type):
        a, b = (pc.fill_null(c, 0).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in (x, y))
        low, high = np.minimum(a, b), np.maximum(a, b)
        return (high.view(np.uint64) - low.view(np.uint64)) > np.uint64(max(tolerance, 0.0))
    if pa.types.is_floating(x.type):
        a, b = (pc.fill_null(c.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False) for c in (x, y))
        nan = np.isnan(a) | np.isnan(b)
        with np.errstate(invalid="ignore"):
            return np.where(nan, np.isnan(a) != np.isnan(b), (np.abs(a - b) > tolerance) & (a != b))
    if pa.types.is_nested(x.type):
        return np.fromiter((p != q for p, q in zip(x.to_pylist(), y.to_pylist())), bool, len(x))
    return ~pc.fill_null(pc.equal(x, y), True).to_numpy(zero_copy_only=False)


def _text(values: pa.Array) -> pa.Array:
    if pa.types.is_nested(values.type):
        return pa.array([None if v is None else str(v) for v in values.to_pylist()], pa.string())
    return values.cast(pa.string())


def _compare(left: pa.Table, right: pa.Table, keys: list[str], fields: list[str], tolerance: dict[str, float], out: pa.Schema) -> pa.Table:
    a, b = _codes(left, right, keys)
    order = np.argsort(b, kind="stable")
    at = np.searchsorted(b[order], a)
    hit = np.zeros(len(a), bool)
    inside = at < len(b)
    hit[inside] = b[order][at[inside]] == a[inside]
    li, ri = np.nonzero(hit)[0], order[at[hit]]
    only_right = np.ones(len(b), bool)
    only_right[ri] = False
    parts = []

    def emit(side: pa.Table, rows: np.ndarray, finding: str, l_val: pa.Array | None, r_val: pa.Array | None) -> None:
        if len(rows):
            none = pa.nulls(len(rows), pa.string())
            cols = [side.column(k).take(pa.array(rows)) for k in keys]
            parts.append(pa.Table.from_arrays([*cols, pa.array([finding] * len(rows)), l_val if l_val is not None else none, r_val if r_val is not None else none], schema=out))

    emit(left, np.nonzero(~hit)[0], "missing_in_copy", None, None)
    emit(right, np.nonzero(only_right)[0], "missing_in_original", None, None)
    for f in fields:
        x, y = left.column(f).take(pa.array(li)).combine_chunks(), right.column(f).take(pa.array(ri)).combine_chunks()
        nx, ny = (c.is_null().to_numpy(zero_copy_only=False) for c in (x, y))
        mask = np.where(nx | ny, nx != ny, _apart(x, y, tolerance.get(f, 0.0)))
        rows = np.nonzero(mask)[0]
        emit(left, li[rows], f, *(_text(c.take(pa.array(rows))) for c in (x, y)))
    return pa.concat_tables(parts) if parts else out.empty_table()


def table_diff(
    original: DataFrame,
    copy: DataFrame,
    keys: Sequence[str],
    fields: Sequence[str],
    version: str,
    tolerance: dict[str, float] | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    n_rows: int | None = None,
) -> DataFrame:
    """Rows missing on either side and cells whose values differ.

    Returns the keys, `finding` (`missing_in_copy`, `missing_in_original` or a field's name) and the two values as
    strings. Numbers differ if they are more than the field's tolerance apart, whole numbers exactly; a null differs from
    a value and equals a null, and so does a NaN. Null keys are values like others. Repeated keys count once, by `latest_rows`. Empty tables give the rows of
    the other side; extra columns are ignored, whatever their names. A bucket holds about `rows_per_bucket` distinct
    keys: the number of buckets follows the number of rows and no bucket grows with the data. `n_rows`, a bound of the
    rows of both copies, saves the pass that counts them.
    """
    keys, fields, tolerance = list(keys), list(fields), dict(tolerance or {})
    a, b = (latest_rows(x.select(*keys, *fields, version), keys, fields, version) for x in (original, copy))
    total = original.count() + copy.count() if n_rows is None else n_rows
    buckets = max(1, -(-total // rows_per_bucket))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("_bucket")
    a, b = (x.select(bucket, *keys, *fields) for x in (a, b))
    types = {f.name: f.dataType.simpleString() for f in a.schema.fields}
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "finding string", "original_value string", "copy_value string"])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        side = left if left.num_rows else right
        out = pa.schema([*(pa.field(k, side.schema.field(k).type) for k in keys), *(pa.field(c, pa.string()) for c in ("finding", "original_value", "copy_value"))])
        if not left.num_columns:
            left = right.slice(0, 0)
        if not right.num_columns:
            right = left.slice(0, 0)
        return _compare(left, right, keys, fields, tolerance, out)

    return a.groupBy("_bucket").cogroup(b.groupBy("_bucket")).applyInArrow(run, schema)


def pair_rows(df: DataFrame, *extra: Column | str) -> DataFrame:
    """Rows of a pair table whose two ends are both named: `protein_a`, `protein_b` (accessions, the smaller first)."""
    from ..functions.ids import accession

    named = df.select(accession("query").alias("_q"), accession("target").alias("_t"), *extra)
    named = named.filter(F.col("_q").isNotNull() & F.col("_t").isNotNull())
    keep = [c for c in named.columns if c not in ("_q", "_t")]
    return named.select(F.least("_q", "_t").alias("protein_a"), F.greatest("_q", "_t").alias("protein_b"), *keep)


def similarity_copy_diff(original: DataFrame, copy: DataFrame) -> DataFrame:
    """Differences of two pair tables by pair of proteins and split; scores 0.00005 apart or less are equal."""
    from ..functions.ids import number_or_null

    scores = ["fident", "hfsp", "alntmscore"]
    a, b = (pair_rows(x, "split", *[number_or_null(s).alias(s) for s in scores], "loaded_at") for x in (original, copy))
    # The tables' own row counts come from their metadata.
    n_rows = original.count() + copy.count()
    return table_diff(a, b, ["protein_a", "protein_b", "split"], scores, "loaded_at", dict.fromkeys(scores, 0.00005), n_rows=n_rows)
