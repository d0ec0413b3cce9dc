"""Sharding by Karmarkar-Karp differencing: near-equal bytes for indivisible groups.

Groups are rows of equal text; their sizes are summed with partial aggregates, so a group of a third of all rows is one
number. Each task differences its groups in blocks, then the blocks' partial partitions among themselves: the two of largest
spread are combined again and again, oppositely ordered. The driver does the same with one partial partition for each task
(as many as shuffle partitions, each of ``shards`` sums). Labels go back to the rows by a join on the text's digest that AQE
can split; a row's slot is its rank in the task that wrote it plus an offset from counts of (shard, task). Texts are read
once, by digests and checksums, and never move.

Defined results: a null text has size 1 and the checksum of no bytes, and shares a group with empty texts; repeated rows each
get a slot; a group larger than a fair share leaves its shard larger; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import Workspace

#: Groups that a task differences at once; their result is one partial partition of the next step.
BLOCK = 20_000


def difference(parts: list[list[int]]) -> list[tuple[int, ...]]:
    """For each partial partition (sums of its slots), the final slot of each of its slots. All have the same number of slots."""
    if not parts:
        return []
    sums = [list(p) for p in parts]
    heap = [(min(p) - max(p), i) for i, p in enumerate(sums)]
    heapq.heapify(heap)
    up: list[tuple[int, list[int]]] = [(-1, [])] * len(sums)
    k = len(sums[0])
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        x, y = sums[a], sums[b]
        down, rise = sorted(range(k), key=x.__getitem__, reverse=True), sorted(range(k), key=y.__getitem__)
        to_a, to_b, new = [0] * k, [0] * k, [0] * k
        for slot, (i, j) in enumerate(zip(down, rise, strict=True)):
            to_a[i], to_b[j], new[slot] = slot, slot, x[i] + y[j]
        up[a], up[b] = (len(sums), to_a), (len(sums), to_b)
        sums.append(new)
        up.append((-1, []))
        heapq.heappush(heap, (min(new) - max(new), len(sums) - 1))
        if a >= len(parts):
            sums[a] = []
        if b >= len(parts):
            sums[b] = []
    final: list[tuple[int, ...]] = [()] * len(up)
    final[-1] = tuple(range(k))
    for node in range(len(up) - 2, -1, -1):
        parent, to = up[node]
        final[node] = tuple(final[parent][s] for s in to)
    return final[: len(parts)]


def _labelled(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, digests, sizes, labels, totals = TaskContext.get().partitionId(), [], [], [], []
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                own = np.asarray(part.column(1))
                slots = difference([[int(s), *[0] * (shards - 1)] for s in own])
                label = np.array([s[0] for s in slots], np.int64)
                digests.append(part.column(0))
                sizes.append(own)
                labels.append(label)
                totals.append([int(own[label == k].sum()) for k in range(shards)])
        for digest, size, label, to in zip(digests, sizes, labels, difference(totals), strict=True):
            yield pa.record_batch([digest, pa.array(size), pa.array(np.full(len(size), task, np.int64)), pa.array(np.array(to, np.int64)[label])], ["digest", "size", "task", "label"])

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task and the row's rank among those of its shard in the task."""
    from pyspark import TaskContext

    task, seen = TaskContext.get().partitionId(), defaultdict(int)
    for batch in batches:
        nth = []
        for s in batch.column("shard").to_pylist():
            nth.append(seen[s])
            seen[s] += 1
        yield pa.record_batch([*batch.columns, pa.array(np.full(len(nth), task, np.int64)), pa.array(nth, pa.int64())], [*batch.schema.names, "task", "nth"])


def balance_bytes(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Every row's doc_id, size, text_crc32, law, shard, slot, grown_shard under the law of near-equal bytes."""
    work = Workspace(docs.sparkSession, "sharding")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = work.write(rows, "rows")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("size"))
    labels = work.write(groups.mapInArrow(_labelled(shards), "digest binary, size long, task long, label long"), "labels")
    sums: dict[int, list[int]] = defaultdict(lambda: [0] * shards)
    for r in labels.groupBy("task", "label").agg(F.sum("size").alias("size")).collect():  # shards times tasks
        sums[r["task"]][r["label"]] = r["size"]
    final = dict(zip(sums, difference(list(sums.values())), strict=True))
    to = docs.sparkSession.createDataFrame([(t, k, s) for t, slots in final.items() for k, s in enumerate(slots)], "task long, label long, shard int")
    placed = rows.join(labels.join(F.broadcast(to), ["task", "label"]).select("digest", "shard"), "digest").select("doc_id", "size", "text_crc32", "shard")
    placed = work.write(placed.mapInArrow(_numbered, "doc_id long, size long, text_crc32 long, shard int, task long, nth long"), "placed")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = placed.groupBy("shard", "task").agg(F.count(F.lit(1)).alias("n")).select("shard", "task", F.coalesce(before, F.lit(0)).alias("before"))
    return placed.join(offsets, ["shard", "task"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("nth")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
