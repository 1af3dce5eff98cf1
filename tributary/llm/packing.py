"""Filling fixed-capacity containers with items, by hierarchical residual packing.

Every partition packs its own items best-fit, largest first, and emits the containers that came out nearly full. The
others go on as items of the next round, in fewer partitions, where they meet each other and are packed again; the
tree of rounds ends when one partition holds what is left, or when a round saves less than a container a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.session import saved

CAPACITY = 2048
#: A container filled to this share is emitted at once.
FULL = 0.995
#: Items in one task, at most about; partitions merged into one a round.
TASK_ITEMS, FAN_IN = 4096, 8

CONTENTS = "array<struct<id:string,part:int,size:int>>"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of the items of each container; sizes (1 to capacity) come largest first.

    Open containers are kept by free space, and the set of free spaces as bits of one integer, so the tightest fit is
    found by shifts; among containers of one free space the latest is taken."""
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    free_set = 0
    for i, s in enumerate(sizes):
        fits = free_set >> s
        if fits:
            free = s + (fits & -fits).bit_length() - 1
            at = by_free[free].pop()
            if not by_free[free]:
                free_set &= ~(1 << free)
        else:
            free, at = capacity, len(bins)
            bins.append([])
        bins[at].append(i)
        if free > s:
            by_free[free - s].append(at)
            free_set |= 1 << (free - s)
    return bins


SCHEMA = pa.schema(
    [("name", pa.string()), ("size", pa.int32()), ("contents", pa.list_(pa.struct([("id", pa.string()), ("part", pa.int32()), ("size", pa.int32())])))]
)


def _pack(batches: Iterator[pa.RecordBatch], capacity: int, level: int) -> Iterator[pa.RecordBatch]:
    names, sizes, contents = [], [], []
    for b in batches:
        names += b.column("name").to_pylist()
        sizes += b.column("size").to_pylist()
        contents.append(b.column("contents"))
    if not names:
        return
    held = pa.chunked_array(contents).combine_chunks()
    order = sorted(range(len(names)), key=lambda i: (-sizes[i], names[i]))
    bins = best_fit([sizes[i] for i in order], capacity)
    # Contents move by offsets: the lists of a container's members are taken in order and their borders redrawn.
    flat = pa.array([order[j] for own in bins for j in own], pa.int64())
    moved = held.take(flat)
    borders, n = [0], 0
    offsets = moved.offsets.to_pylist()
    for own in bins:
        n += len(own)
        borders.append(offsets[n])
    lists = pa.ListArray.from_arrays(pa.array(borders, pa.int32()), moved.values)
    task = TaskContext.get().partitionId()
    out = pa.RecordBatch.from_arrays(
        [pa.array([f"{level}.{task}.{i}" for i in range(len(bins))], pa.string()), pa.array([sum(sizes[order[j]] for j in own) for own in bins], pa.int32()), lists.cast(SCHEMA.field("contents").type)],
        names=["name", "size", "contents"],
    )
    for at in range(0, out.num_rows, 10_000):
        yield out.slice(at, 10_000)


def pieces(items: DataFrame, id: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """(name, size, contents) of items of 1 to capacity: larger items are split into full pieces and a rest."""
    n = F.col(size).cast("bigint")
    whole = items.where(n > 0).select(F.col(id).cast("string").alias("id"), n.alias("n"))
    part = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / capacity).cast("bigint"))).alias("part")
    cut = whole.select("id", "n", part)
    cut = cut.select("id", F.col("part").cast("int").alias("part"), F.least(F.col("n") - F.col("part") * capacity, F.lit(capacity)).cast("int").alias("size"))
    return cut.select(F.concat_ws("#", F.coalesce("id", F.lit("")), "part").alias("name"), "size", F.array(F.struct("id", "part", "size")).cast(CONTENTS).alias("contents"))


def pack(items: DataFrame, id: str, size: str, capacity: int = CAPACITY, full: float = FULL, task_items: int = TASK_ITEMS) -> DataFrame:
    """(container, id, part, size): every item with a positive size assigned to a container of `capacity`.

    Items above the capacity are split into full pieces, parts 0, 1, ..., and a rest; no other item is split. Items
    without size (null, zero or less) need no container and give no row. Ids need not be unique: repeated rows are
    items of their own, told apart only by their containers. A container is named by the round, task and place in which it came about.
    Other columns are not read; an empty table gives an empty one.

    A task sorts and packs about `task_items` items, whatever their number; the number of rounds grows with its
    logarithm. Items that fit nowhere with each other (all above half the capacity, say) would fill one task at the
    root of the tree; there a round saves next to nothing, and the rounds end with the containers as they are. Results do not depend on the partitions a retried task finds itself in: items are dealt by a hash of
    their name and sorted by size and name."""
    spark = items.sparkSession
    todo = saved(pieces(items, id, size, capacity), "pack-items")
    done: list[DataFrame] = []
    n, r = todo.count(), 0
    tasks = max(1, -(-n // task_items))
    while n:
        dealt = todo.repartition(tasks, F.xxhash64("name", F.lit(r))) if tasks > 1 else todo.coalesce(1)
        packed = saved(dealt.mapInArrow(lambda bs, level=r: _pack(bs, capacity, level), f"name string, size int, contents {CONTENTS}"), "pack-round")
        open_ = packed.where(F.col("size") < int(full * capacity))
        left = open_.count()
        few = -(-left // task_items) if left else 0
        last = tasks == 1 or left == 0 or (r > 0 and few > 1 and n - packed.count() < tasks)
        done.append(packed if last else packed.where(F.col("size") >= int(full * capacity)))
        if last:
            break
        todo, n, r = open_, left, r + 1
        tasks = max(1, few, -(-tasks // FAN_IN))
    if not done:
        return spark.createDataFrame([], "container string, id string, part int, size int")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(F.col("name").alias("container"), F.inline("contents"))
