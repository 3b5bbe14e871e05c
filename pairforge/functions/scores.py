"""Scalar expressions of the pair workflow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hfsp(fident: Column | str, nident: Column | str, mismatch: Column | str) -> Column:
    """Distance of a hit from the homology curve; the ungapped length is nident + mismatch, a null length counts as long."""
    length = (col(nident) + col(mismatch)).cast("double")
    pide = col(fident) * 100
    # The curve's constants and its two length limits.
    curve = F.lit(770.0) * F.pow(length, F.lit(-0.33) * (1 + F.exp(length / 1000.0)))
    return F.when(length <= 11, pide - 100).when(length <= 450, pide - curve).otherwise(pide - 28.4)


def model_id(c: Column | str) -> Column:
    """The id inside a predicted structure's name, null where there is none."""
    return F.nullif(F.regexp_extract(col(c), r"AF-(.*?)-F1-model_v4", 1), F.lit(""))


def packed_mean(c: Column | str) -> Column:
    """Whole-number mean of integers joined by commas; entries that are no integers are skipped, none gives null."""
    values = F.filter(F.transform(F.split(col(c), ","), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull())
    total = F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return F.when(F.size(values) > 0, F.floor(total / F.size(values)).cast("int"))


def packed_list(values: Column | str) -> Column:
    """Numbers rounded half-even and joined by commas."""
    return F.array_join(F.transform(col(values), lambda x: F.bround(x, 0).cast("int").cast("string")), ",")


def pair_key(query: Column | str, target: Column | str) -> Column:
    """One key for both directions of a pair; null if an end is null."""
    q, t = col(query), col(target)
    return F.when(q.isNotNull() & t.isNotNull(), F.array_join(F.array_sort(F.array(q, t)), "|"))


def euclidean(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance in double; null if a vector is null or the lengths differ."""
    x, y = col(a), col(b)
    squares = F.aggregate(F.zip_with(x, y, lambda p, q: F.pow(p.cast("double") - q.cast("double"), F.lit(2.0))), F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(x) == F.size(y), F.sqrt(squares))


def squared_difference(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(col(a), col(b), lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double")))


def min_max(x: Column, low: Column, high: Column) -> Column:
    """Scaled to 0..1; 0.5 where all values are equal."""
    return F.when(high > low, (x - low) / (high - low)).otherwise(F.lit(0.5))


def finite_or_zero(x: Column) -> Column:
    """NaN and infinities become 0."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x).otherwise(F.lit(0.0))


def equal_bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin 0..bins-1 of equal width, the last one closed; a constant column is widened by 0.5 to either side."""
    lo = F.when(high > low, low).otherwise(low - 0.5)
    hi = F.when(high > low, high).otherwise(high + 0.5)
    return F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")


def pair_index(k: Column, n: int) -> tuple[Column, Column]:
    """(i, j), i < j < n, of linear index k in the upper triangle, exact for large n by whole-number correction."""
    m = F.lit(2 * n - 1).cast("long")
    guess = F.floor((m.cast("double") - F.sqrt((m * m).cast("double") - 8.0 * k.cast("double"))) / 2).cast("long")
    first = lambda i: (i * (m - i) / 2).cast("long")
    low = F.when(first(guess) > k, guess - 1).otherwise(guess)
    i = F.when(first(low + 1) <= k, low + 1).otherwise(low)
    return i, (i + 1 + k - first(i)).cast("long")


def normalised_sequence(s: Column | str) -> Column:
    """Upper case, rare residues U, Z, O and B as X."""
    return F.translate(F.upper(col(s)), "UZOB", "XXXX")


def spaced_sequence(s: Column | str) -> Column:
    """Residues separated by spaces."""
    return F.trim(F.regexp_replace(normalised_sequence(s), "(.)", "$1 "))


def first_token(header: Column | str) -> Column:
    return F.element_at(F.split(F.trim(col(header)), r"\s+"), 1)


def safe_name(name: Column | str) -> Column:
    r"""A file name without \ / * ? : " < > |, each of which becomes an underscore."""
    return F.regexp_replace(col(name), r'[\\/*?:"<>|]', "_")


def rank_stem(name: Column | str) -> Column:
    """What comes before the suffix of the best-ranked model's files."""
    return F.element_at(F.split(col(name), "_(scores|unrelaxed)_rank_001"), 1)


def shown_name(name: Column | str) -> Column:
    """A name as it is shown: lower case, words joined by hyphens."""
    return F.lower(F.replace(col(name), F.lit("_"), F.lit("-")))


def short_number(n: Column | str) -> Column:
    """Thousands as K, M, B: one decimal (halves up) below ten of the unit, none from there."""
    x = col(n).cast("double")
    out = F.format_string("%d", x.cast("long"))
    for size, unit in ((1e3, "K"), (1e6, "M"), (1e9, "B")):
        y = x / size
        out = F.when(F.abs(x) >= size, F.when(F.abs(y) < 10, F.format_string("%.1f" + unit, y)).otherwise(F.format_string("%d" + unit, y.cast("long")))).otherwise(out)
    return out


def hashed_normal(key: Column, position: Column, dim: int) -> Column:
    """A standard normal number that depends only on key, position and dimension (Box-Muller on two hashes)."""
    unit = lambda s: (F.pmod(F.xxhash64(key, position, F.lit(dim), F.lit(s)), F.lit(2**52)).cast("double") + 0.5) / float(2**52)
    return F.sqrt(-2 * F.log(unit(1))) * F.cos(2 * F.pi() * unit(2))
