"""Most similar vectors for every vector: multiprobe p-stable hashing with exact reranking.

Vectors are scaled to unit length and hashed by floor((a.x + b) / width) with Gaussian a, several functions to a
bucket and several tables. A vector is stored in its own bucket of each table and also visits buckets one or more
steps away, in the order of their estimated chance to hold a near vector (the expected squared distances to the
crossed boundaries). Rows carry a one-byte code per component and the code's exact error, so a bucket compares codes
by one matrix product and keeps every pair that could reach the asked similarity; candidates of all tables are merged
and reranked with the full vectors.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import canonical_path
from ..session import Scratch, default_parallelism

#: Least chance that a pair of the least similarity asked for is found, whatever the number of vectors.
RECALL = 0.995
WIDTH = 2.0
#: Vectors that a bucket should hold if all were unrelated, and the chance that one function keeps two such together.
BUCKET_ROWS = 256
FAR_TOGETHER = 0.486
#: Rows of buckets that one task meets on average.
LANE_COPIES = 400_000
#: Stored vectors that one block of a bucket holds; fuller buckets are split into blocks that each visitor meets.
BLOCK_ROWS = 20_000
SEED = 20_24


def functions_per_table(rows: int) -> int:
    return max(2, round(math.log(max(rows, 1) / BUCKET_ROWS) / -math.log(FAR_TOGETHER))) if rows > BUCKET_ROWS else 2


@lru_cache(maxsize=64)
def probe_sets(functions: int, probes: int) -> tuple[tuple[int, ...], ...]:
    """Sets of places in the ascending order of boundary distances, by expected sum of squared distances."""
    k = functions
    cost = [0.0]
    for j in range(1, 2 * k + 1):
        r = 2 * k + 1 - j
        cost.append(j * (j + 1) / (4 * (k + 1) * (k + 2)) if j <= k else 1 - r / (k + 1) + r * (r + 1) / (4 * (k + 1) * (k + 2)))
    found: list[tuple[int, ...]] = []
    heap = [(cost[1], (1,))]
    while heap and len(found) < probes:
        total, places = heapq.heappop(heap)
        if len({min(j, 2 * k + 1 - j) for j in places}) == len(places):
            found.append(tuple(j - 1 for j in places))
        last = places[-1]
        if last < 2 * k:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*places[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*places, last + 1)))
    return tuple(found)


#: Numbers of visited buckets that are tried for a plan, and simulated pairs.
PROBES = (2, 4, 6, 8, 12, 16, 24, 32)
PAIRS = 4_000


def found_per_table(functions: int, probes: int, cosine: float) -> float:
    """The chance that one table brings a pair of this cosine similarity together, by simulation: projections of two
    unit vectors differ by a normal number with the vectors' distance as its deviation, whatever their length."""
    rng = np.random.default_rng([SEED, functions, probes])
    a = rng.uniform(size=(PAIRS, functions))
    b = a + rng.normal(size=(PAIRS, functions)) * math.sqrt(max(2 - 2 * cosine, 0.0)) / WIDTH
    step = np.floor(b).astype(np.int64)
    visited = np.array(sorted(sum(1 << j for j in s) for s in probe_sets(functions, probes)))

    def meets(inside: np.ndarray, step: np.ndarray) -> np.ndarray:
        order = np.argsort(np.concatenate([inside, 1 - inside], 1), 1)
        place = np.argsort(order, 1)
        crossed = np.where(step < 0, place[:, :functions], place[:, functions:])
        key = np.where(step != 0, np.left_shift(np.int64(1), np.minimum(crossed, 62)), 0).sum(1)
        return (np.abs(step) <= 1).all(1) & ((key == 0) | np.isin(key, visited))

    return float((meets(a, step) | meets(b - np.floor(b), -step)).mean())


@lru_cache(maxsize=1024)
def plan(functions: int, least: float, recall: float) -> tuple[int, int]:
    """(probes, tables): the cheapest with which a pair of similarity `least` is found with a chance of `recall`."""
    best = None
    for probes in PROBES:
        miss = 1 - found_per_table(functions, probes, least)
        tables = 1 if miss <= 1 - recall else math.ceil(math.log(1 - recall) / math.log(miss)) if miss < 1 else 10**6
        if best is None or tables * (1 + probes) < best[1] * (1 + best[0]):
            best = (probes, tables)
    return best


def _mixed(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def buckets(unit: np.ndarray, files: np.ndarray, table: int, functions: int, probes: int) -> np.ndarray:
    """Bucket numbers (rows x (1 + probes)): the own bucket, then the visited ones in order."""
    n, dim = unit.shape
    rng = np.random.default_rng([SEED, dim, table, functions])
    value = (unit @ rng.normal(size=(dim, functions)).astype(np.float32)) / WIDTH + rng.uniform(0, 1, functions)
    home = np.floor(value).astype(np.int64)
    inside = value - home
    order = np.argsort(np.concatenate([inside, 1 - inside], 1), 1)
    sets = probe_sets(functions, probes)
    out = np.empty((n, 1 + len(sets)), np.uint64)
    rows = np.arange(n)

    def number(cell: np.ndarray) -> np.ndarray:
        h = _mixed(files.astype(np.uint64) + np.uint64(table))
        for j in range(functions):
            h = _mixed(h ^ cell[:, j].view(np.uint64))
        return h

    out[:, 0] = number(home)
    for p, places in enumerate(sets, 1):
        cell = home.copy()
        for place in places:
            pick = order[:, place]
            cell[rows, pick % functions] += np.where(pick < functions, -1, 1)
        out[:, p] = number(cell)
    return out.view(np.int64)


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One-byte codes, their step, and the length of what they miss."""
    step = np.abs(unit).max(1) / 127
    code = np.rint(unit / step[:, None]).astype(np.int8)
    return code, step.astype(np.float32), np.linalg.norm(unit - code * step[:, None], axis=1).astype(np.float32) + np.float32(1e-6)


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """(ids, files, functions, unit vectors) of the batch's rows by vector length and number of functions."""
    lists = batch.column(2)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    ids, files, functions = (batch.column(i).to_numpy() for i in (0, 1, 3))
    for dim, k in np.unique(np.stack([lengths, functions], 1), axis=0).tolist():
        rows = np.nonzero((lengths == dim) & (functions == k))[0]
        x = flat[starts[rows][:, None] + np.arange(dim)]
        x /= np.abs(x).max(1)[:, None]
        yield ids[rows], files[rows], k, (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)


def _hasher(plans: dict[int, tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, files, functions, unit in _matrices(batch):
                probes, tables = plans[functions]
                code, step, error = codes(unit)
                raw = pa.array([c.tobytes() for c in code], pa.binary())
                for t in range(tables):
                    cells = buckets(unit, files, t, functions, probes)
                    width = cells.shape[1]
                    rows = pa.array(np.repeat(np.arange(len(ids)), width))
                    role = np.tile((np.arange(width) > 0).astype(np.int32), len(ids))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cells.ravel()), pa.array(role), pa.array(ids).take(rows), pa.array(step).take(rows), pa.array(error).take(rows), raw.take(rows)],
                        names=["bucket", "role", "id", "step", "error", "code"],
                    )

    return run


def _home(plans: dict[int, tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, files, functions, unit in _matrices(batch):
                for t in range(plans[functions][1]):
                    yield pa.RecordBatch.from_arrays([pa.array(buckets(unit, files, t, functions, 0)[:, 0])], names=["bucket"])

    return run


def _kept(sims: np.ndarray, slack: np.ndarray, hit: np.ndarray, k: int) -> np.ndarray:
    """Of each row's hits, those that may be among its k best, whatever the codes' errors."""
    most = hit.sum(1)
    if most.max(initial=0) <= k:
        return hit
    low = np.where(hit, sims - slack, -2.0)
    least = -np.partition(-low, k - 1, axis=1)[:, k - 1 : k]
    return hit & (sims + slack >= least)


def _lane(k: int, least: float, block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored: list[tuple] = []
        stored_key = None
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def meet(q: tuple) -> None:
            nonlocal held
            for s in stored:
                if s[3].shape[1] != q[3].shape[1]:
                    continue
                wide = max(1, 4_000_000 // len(s[0]))
                for at in range(0, len(q[0]), wide):
                    part = slice(at, at + wide)
                    sims = (q[3][part] @ s[3].T) * q[1][part, None] * s[1]
                    slack = q[2][part, None] + s[2] + q[2][part, None] * s[2]
                    hit = (sims + slack >= least) & (q[0][part, None] != s[0])
                    if hit.any():
                        keep = _kept(sims, slack, hit, k) | _kept(sims.T, slack.T, hit.T, k).T
                        i, j = np.nonzero(keep)
                        a, b = q[0][part][i], s[0][j]
                        found.append((np.minimum(a, b), np.maximum(a, b)))
                        held += len(i)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, found
            if found:
                both = np.unique(np.stack([np.concatenate([x[i] for x in found]) for i in (0, 1)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])
            found, held = [], 0

        for batch in batches:
            key, role, ids = (batch.column(i).to_numpy() for i in (0, 2, 3))
            block = batch.column(1).to_numpy()
            step, error = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            raw = batch.column(6)
            sizes = np.diff(np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1])
            bytes_ = np.frombuffer(raw.buffers()[2], np.int8)[np.frombuffer(raw.buffers()[1], np.int32)[raw.offset] :] if len(raw) else np.empty(0, np.int8)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            edge = np.nonzero((np.diff(key) != 0) | (np.diff(block) != 0) | (np.diff(role) != 0) | (np.diff(sizes) != 0))[0] + 1
            for lo, hi in zip(np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])):
                if lo == hi:
                    continue
                here = (key[lo], block[lo])
                if here != stored_key:
                    stored, stored_key = [], here
                rows = (ids[lo:hi], step[lo:hi], error[lo:hi], bytes_[starts[lo] : starts[hi]].reshape(hi - lo, -1).astype(np.float32))
                if role[lo] == 0:
                    # Stored vectors meet those before them and one another; visitors come after them.
                    meet(rows)
                    stored.append(rows)
                    if hi - lo > 1:
                        whole, stored = stored, [rows]
                        meet(rows)
                        stored = whole
                elif stored:
                    meet(rows)
            if held >= 200_000:
                yield from flush()
        yield from flush()

    return run


def _cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both vectors of a row are of one file, so of one length."""
    for b in batches:
        out = np.empty(b.num_rows)
        flat = [b.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.float64) for i in (2, 3)]
        lengths = b.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        for dim in np.unique(lengths):
            rows = np.nonzero(lengths == dim)[0]
            x, y = (f[starts[rows][:, None] + np.arange(dim)] for f in flat)
            x /= np.abs(x).max(1)[:, None]
            y /= np.abs(y).max(1)[:, None]
            out[rows] = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.round(out, 9))], names=["a", "b", "similarity"])


#: Files whose one row each is broadcast; with more, rows meet it by a shuffle.
FEW_FILES = 10_000


def usable_vectors(df: DataFrame, key: str, group: F.Column, vector: str, work: Scratch) -> DataFrame:
    """`id`, `file` (a hash of the group), `vec`: vectors of the most frequent length of their group (the longer of two equally frequent),
    with finite numbers only and not all zero. Null vectors and rows without a group fall out."""
    rows = df.select(F.col(key).cast("long").alias("id"), group.alias("grp"), F.col(vector).alias("vec"))
    rows = rows.filter(F.col("vec").isNotNull() & F.col("grp").isNotNull()).select("id", F.xxhash64("grp").alias("file"), "vec")
    lengths = rows.groupBy("file", F.size("vec").alias("len")).count().groupBy("file").agg(F.max(F.struct("count", "len"))["len"].alias("len"))
    lengths = work.save(lengths, "lengths")
    lengths = F.broadcast(lengths) if lengths.count() <= FEW_FILES else lengths
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0)
    return rows.join(lengths, "file").filter((F.size("vec") == F.col("len")) & (F.col("len") > 0) & fine).select("id", "file", "vec")


def nearest(df: DataFrame, key: str, group: F.Column, vector: str, k: int = 10, least: float = 0.9, recall: float = RECALL, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`id`, `neighbour`, `similarity`, `rank`: for every usable vector its up to k most similar usable vectors of the
    same group with a cosine similarity of at least `least`. A pair of similarity `least` is found with a chance of
    `recall`, nearer ones with a higher chance: functions follow the size of the vectors' own group, tables and probes
    the chance that functions leave (`plan`), so recall doesn't fall as groups grow.

    Equal similarities (to nine decimals) rank by id. Exact copies are hashed once, however many there are, and
    afterwards share one list of the k + 1 smallest ids, so no group of copies is expanded into pairs. Keys must be
    unique; unusable vectors neither ask nor answer. An empty table gives no rows.
    """
    work = Scratch(df.sparkSession, "neighbours")
    return _nearest(usable_vectors(df, key, group, vector, work), k, least, recall, block_rows, work)


def _nearest(good: DataFrame, k: int, least: float, recall: float, block_rows: int, work: Scratch) -> DataFrame:
    """`nearest` of usable vectors."""
    spark = good.sparkSession
    marked = work.save(good.withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.hash("vec")), "marked")
    keys = marked.select("id", "file", "h1", "h2")
    copied = keys.groupBy("file", "h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).filter(F.col("n") > 1)
    members = keys.join(copied, ["file", "h1", "h2"]).select("id", "rep")
    members = work.save(members, "copies")
    reps = marked.join(members.filter(F.col("id") != F.col("rep")), "id", "left_anti").select("id", "file", F.col("vec").cast("array<float>").alias("vec"))
    reps = work.save(reps, "vectors")
    work.drop(marked)
    # Functions by the size of the vector's own file; the driver sees their few distinct numbers.
    n = F.col("count")
    functions = F.when(n > BUCKET_ROWS, F.greatest(F.lit(2), F.round(F.log(n / BUCKET_ROWS) / -math.log(FAR_TOGETHER)))).otherwise(2).cast("int")
    sizes = work.save(reps.groupBy("file").count().select("file", "count", functions.alias("functions")), "sizes")
    classes = sizes.groupBy("functions").agg(F.sum("count").alias("rows"), F.count("*").alias("files")).collect()
    plans = {r["functions"]: plan(r["functions"], least, recall) for r in classes}
    sized = F.broadcast(sizes) if sum(r["files"] for r in classes) <= FEW_FILES else sizes
    sized = reps.join(sized.select("file", "functions"), "file").select("id", "file", "vec", "functions")
    lanes = sized.mapInArrow(_hasher(plans), "bucket bigint, role int, id bigint, step float, error float, code binary")
    full = sized.mapInArrow(_home(plans), "bucket bigint").groupBy("bucket").count().filter(F.col("count") > block_rows)
    full = full.select("bucket", F.ceil(F.col("count") / block_rows).cast("int").alias("blocks"))
    n_full = full.count()
    if n_full:
        # At most tables * rows / block_rows buckets are full; broadcast only when few.
        lanes = lanes.join(F.broadcast(full) if n_full <= 10_000 else full, "bucket", "left")
        every = F.sequence(F.lit(0), F.col("blocks") - 1)
        own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        # A stored vector lies in one block and visits the others.
        stored = lanes.withColumn("block", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(every)))
        lanes = stored.withColumn("role", F.when((F.col("role") == 0) & F.col("blocks").isNotNull() & (F.col("block") != own), 1).otherwise(F.col("role"))).drop("blocks")
    else:
        lanes = lanes.withColumn("block", F.lit(0))
    copies = sum(r["rows"] * plans[r["functions"]][1] * (1 + plans[r["functions"]][0]) for r in classes)
    parts = max(2 * default_parallelism(spark), -(-copies // LANE_COPIES))
    lanes = lanes.select("bucket", "block", "role", "id", "step", "error", "code").repartition(parts, "bucket", "block").sortWithinPartitions("bucket", "block", "role")
    pairs = lanes.mapInArrow(_lane(k, least, block_rows), "a bigint, b bigint").distinct()

    one, two = (reps.select(F.col("id").alias(c), F.col("file").alias(f"f{c}"), F.col("vec").alias(f"v{c}")) for c in "ab")
    exact = pairs.join(one, "a").join(two, "b").filter("fa = fb").select("a", "b", "va", "vb").mapInArrow(_cosine, "a bigint, b bigint, similarity double")
    exact = exact.filter(F.col("similarity") >= least)
    rep_lists = exact.select(F.explode(F.array(F.struct(F.col("a").alias("rep"), F.col("b").alias("other"), "similarity"), F.struct(F.col("b").alias("rep"), F.col("a").alias("other"), "similarity"))).alias("x")).select("x.*")
    best = lambda part, other, n: F.row_number().over(Window.partitionBy(part).orderBy(F.desc("similarity"), other)) <= n
    rep_lists = rep_lists.withColumn("keep", best("rep", "other", k)).filter("keep").drop("keep")
    first_members = members.withColumn("keep", F.row_number().over(Window.partitionBy("rep").orderBy("id")) <= k + 1).filter("keep").select("rep", "id")
    theirs = rep_lists.join(first_members.select(F.col("rep").alias("other"), F.col("id").alias("member")), "other", "left")
    theirs = theirs.select("rep", F.coalesce("member", "other").alias("neighbour"), "similarity")
    own_copies = first_members.select("rep", F.col("id").alias("neighbour"), F.lit(1.0).alias("similarity"))
    lists = theirs.unionByName(own_copies).withColumn("keep", best("rep", "neighbour", k + 1)).filter("keep").drop("keep")
    askers = lists.join(members, "rep", "left").select(F.coalesce("id", "rep").alias("id"), "neighbour", "similarity").filter("id <> neighbour")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))
    return askers.withColumn("rank", rank).filter(F.col("rank") <= k)


#: Components (of 8 bytes) of the vectors that one lane of the exact search holds, and of one matrix of similarities.
LANE_VALUES, MATRIX_VALUES = 8_000_000, 2_000_000


def _exact_lane(k: int):
    """Rows sorted by lane, its vectors before its queries: the lane's vectors are held, the queries pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, held, ids, x = None, [], None, None
        for batch in batches:
            key, role = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edge = np.nonzero((np.diff(key) != 0) | (np.diff(role) != 0))[0] + 1
            for lo, hi in zip(np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])):
                if lo == hi:
                    continue
                unit = np.asarray(batch.column(3).slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(hi - lo, -1)
                unit = unit / np.abs(unit).max(1)[:, None]
                unit /= np.linalg.norm(unit, axis=1)[:, None]
                own = batch.column(2).slice(lo, hi - lo).to_numpy()
                if key[lo] != lane:
                    lane, held, ids, x = key[lo], [], None, None
                if role[lo] == 0:
                    held.append((own, unit))
                    continue
                if held:
                    ids, x = (np.concatenate([h[i] for h in held]) for i in (0, 1))
                    held = []
                if ids is None:
                    continue
                wide = max(1, MATRIX_VALUES // len(ids))
                for at in range(0, len(own), wide):
                    asked = own[at : at + wide]
                    sims = np.round(unit[at : at + wide] @ x.T, 9)
                    sims[asked[:, None] == ids] = -3
                    if len(ids) > k:
                        # All that reach the k-th best, ties included; the smaller id goes first.
                        keep = sims >= -np.partition(-sims, k - 1, axis=1)[:, k - 1 : k]
                    else:
                        keep = np.ones(sims.shape, bool)
                    row, col = np.nonzero(keep & (sims > -2))
                    near = sims[row, col]
                    order = np.lexsort((ids[col], -near, row))
                    row, col, near = row[order], col[order], near[order]
                    first = np.searchsorted(row, row)
                    top = np.arange(len(row)) - first < k
                    yield pa.RecordBatch.from_arrays([pa.array(asked[row[top]]), pa.array(ids[col[top]]), pa.array(near[top])], names=["id", "neighbour", "similarity"])

    return run


def search(df: DataFrame, key: str, group: F.Column, vector: str, asked: F.Column, k: int = 10, least: float = 0.9, lane_values: int = LANE_VALUES) -> DataFrame:
    """`id`, `neighbour`, `similarity`, `rank`: the k most similar usable vectors of the same group, whatever their
    similarity, for the usable vectors for which `asked` (an expression over `id`) holds.

    `nearest` answers those it finds k neighbours of at least `least` for; the others are compared with all vectors of
    their group, exactly: the group's vectors are spread over lanes of bounded size, each once, and every query visits
    its group's lanes. Groups with fewer others give shorter lists.
    """
    spark = df.sparkSession
    work = Scratch(spark, "search")
    good = work.save(usable_vectors(df, key, group, vector, work), "usable")
    near = _nearest(good, k, least, RECALL, BLOCK_ROWS, work).filter(asked)
    near = work.save(near, "near")
    full = near.groupBy("id").count().filter(F.col("count") >= k).select("id")
    queries = work.save(good.filter(asked).join(full, "id", "left_anti"), "queries")
    sizes = work.save(good.groupBy("file").agg(F.ceil(F.sum(F.size("vec")) / lane_values).cast("int").alias("lanes"), F.count("*").alias("rows")), "sizes")
    total = sizes.agg(F.count("*").alias("files"), F.sum("lanes").alias("lanes")).first()
    sized = (F.broadcast(sizes) if total["files"] <= FEW_FILES else sizes).select("file", "lanes")
    lane = F.xxhash64("file", "lane").alias("key")
    met = good.join(sized, "file").withColumn("lane", F.pmod(F.xxhash64("id"), F.col("lanes")).cast("int")).select(lane, F.lit(0).alias("role"), "id", "vec")
    # A lane with very many queries is met in several tasks: its vectors go to each of them.
    ask = queries.join(sized, "file").withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1))).select(lane, F.lit(1).alias("role"), "id", "vec")
    turns = max(1, min(4 * default_parallelism(spark), -(-queries.count() // 2_000)) // max(1, total["lanes"] or 1))
    met = met.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    ask = ask.withColumn("turn", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(turns)).cast("int"))
    lanes = met.unionByName(ask).select(F.xxhash64("key", "turn").alias("key"), "role", "id", "vec")
    parts = max(4 * default_parallelism(spark), total["lanes"] or 1)
    exact = lanes.repartition(parts, "key").sortWithinPartitions("key", "role").mapInArrow(_exact_lane(k), "id bigint, neighbour bigint, similarity double")
    found = exact.unionByName(near.join(full, "id", "left_semi").select("id", "neighbour", "similarity"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def mutual(lists: DataFrame) -> DataFrame:
    """`a`, `b`, `similarity` of the pairs in which each is on the other's list."""
    pair = lists.select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b"), "similarity")
    return pair.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("similarity").alias("similarity")).filter("n = 2").drop("n")


def file_neighbours(embeddings: DataFrame, k: int = 10, least: float = 0.9) -> DataFrame:
    """`nearest` within each embedding file, whatever way its path is written."""
    return nearest(embeddings, "vec_id", canonical_path("embedding_file"), "embedding", k, least)
