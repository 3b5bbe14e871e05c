"""Filling fixed-capacity containers with items of varying length: variable-capacity best fit.

Items are hashed into groups of bounded size that are packed independently, largest item first: into the open
container with the least room that still holds it, or into a new one of the capacity whose cost per filled place is
least if it were topped up with the items still to come. At last every container is downsized to the smallest
permitted capacity that holds its contents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITIES = (512, 1024, 2048, 4096)
#: What a container costs beside its places.
CONTAINER_COST = 8
#: Items that are packed together; a group leaves at most a few half-filled containers.
GROUP_ITEMS = 20_000


def pack(sizes: Sequence[int], capacities: Sequence[int] = CAPACITIES, container_cost: float = CONTAINER_COST) -> tuple[list[int], list[int]]:
    """The container of each item, and each container's capacity. No size may exceed the largest capacity."""
    capacities = sorted(capacities)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    left = Counter(sizes)
    waiting = 0  # bit s: an item of size s is still to come
    for s in left:
        waiting |= 1 << s
    where, room, filled = [0] * len(sizes), [], []
    open_: dict[int, list[int]] = {}
    rooms = 0  # bit r: an open container has r places left

    def outlook(capacity: int, size: int) -> float:
        """Cost per filled place if the container takes the largest fitting item again and again."""
        free, taken = capacity - size, Counter({size: 1})
        mask = waiting
        while free > 0:
            fit = (mask & ((1 << (free + 1)) - 1)).bit_length() - 1
            if fit <= 0:
                break
            n = min(left[fit] - taken[fit], free // fit)
            if n > 0:
                taken[fit] += n
                free -= n * fit
            mask &= ~(1 << fit)
        return (capacity + container_cost) / max(capacity - free, 1)

    for i in order:
        size = sizes[i]
        fitting = rooms >> size
        if fitting:
            r = size + (fitting & -fitting).bit_length() - 1
            c = open_[r].pop()
            if not open_[r]:
                rooms &= ~(1 << r)
        else:
            able = [c for c in capacities if c >= size]
            best = min(able, key=lambda c: (outlook(c, size), -c))
            c, r = len(room), best
            room.append(0)
            filled.append(0)
        where[i] = c
        filled[c] += size
        r -= size
        open_.setdefault(r, []).append(c)
        rooms |= 1 << r
        left[size] -= 1
        if not left[size]:
            waiting &= ~(1 << size)
    return where, [next(c for c in capacities if c >= n) for n in filled]


def fill_containers(items: DataFrame, key: str, size: str, capacities: Sequence[int] = CAPACITIES, container_cost: float = CONTAINER_COST, group_items: int = GROUP_ITEMS, n_items: int | None = None) -> DataFrame:
    """`key`, `part`, `container_id`, `capacity`, `place`, `offset`, `length`: where every item lies.

    An item larger than the largest capacity is cut into parts of that capacity and a rest, numbered from 0; `offset`
    is where a part begins in its item and `place` where it lies in its container. Other items have one part. A size
    of zero or null lies in a container with length 0. Repeated keys are items of their own. An empty table gives no
    rows. Container ids are unique across groups. `n_items`, if known, saves the pass that counts the items.
    """
    most = max(capacities)
    kind = items.schema[key].dataType.simpleString()
    rows = items.select(F.col(key).alias("_key"), F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("long"), F.lit(0).cast("long")).alias("n"))
    # Equal items are numbered, so that a key which most rows share is spread over groups, and in every run in the same way.
    rows = rows.groupBy("_key", "n").agg(F.count("*").alias("_copies")).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / most) - 1, F.lit(0).cast("long"))))
    parts = rows.select("_key", "n", "_copy", part.alias("part")).withColumn("offset", F.col("part") * most)
    parts = parts.select("_key", "_copy", "part", "offset", F.least(F.col("n") - F.col("offset"), F.lit(most).cast("long")).alias("length"))
    groups = max(1, -(-(items.count() if n_items is None else n_items) // group_items))
    parts = parts.withColumn("_group", F.pmod(F.xxhash64("_key", "part", "_copy"), F.lit(groups)).cast("long"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("_key", "ascending"), ("_copy", "ascending"), ("part", "ascending"), ("length", "ascending")])
        sizes = t.column("length").to_pylist()
        where, capacity = pack(sizes, capacities, container_cost)
        used = [0] * len(capacity)
        place = []
        for c, n in zip(where, sizes):
            place.append(used[c])
            used[c] += n
        first = t.column("_group")[0].as_py() << 32
        return pa.table({
            "_key": t.column("_key"), "part": t.column("part"), "container_id": pa.array([first + c for c in where], pa.int64()),
            "capacity": pa.array([capacity[c] for c in where], pa.int64()), "place": pa.array(place, pa.int64()), "offset": t.column("offset"), "length": t.column("length"),
        })

    out = parts.groupBy("_group").applyInArrow(run, f"_key {kind}, part bigint, container_id bigint, capacity bigint, place bigint, offset bigint, length bigint")
    return out.withColumnRenamed("_key", key)


def usage(placed: DataFrame) -> DataFrame:
    """Containers, items, filled and free places by capacity."""
    each = placed.groupBy("container_id", "capacity").agg(F.sum("length").alias("filled"), F.count("*").alias("items"))
    return each.groupBy("capacity").agg(
        F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("filled").alias("filled"), (F.sum("capacity") - F.sum("filled")).alias("free"),
    )
