"""Approximate nearest neighbours by a hash-prefix forest.

Each tree gives every vector a string of ``BITS`` sign bits against random directions. A block of vectors keeps, for each
tree, its strings as a sorted array. A query descends to the places of its own strings, whose neighbours share the longest
prefixes, of any length; it then ascends all trees together, one bit at a time, and takes all vectors that share the shorter
prefix in any tree as candidates. It stops once a vector as near as the ``k``-th found would have shared a prefix of the
present length in some tree with probability ``1 - miss``, or at the root, where the block is searched whole. So no bucket
and no list of candidates is cut short.

Blocks hold ``BLOCK`` vectors and are written, with their sorted arrays, as an index, once; queries are taken in batches of
bounded size that go to every block. A task searches its blocks one after another, and what it has found for a query so far lets
it stop earlier in the next. It returns ``k`` rows for a query, merged by partial aggregates. Directions come from a seed,
nothing is fitted.

Defined results: vectors that are null, zero, of another width than ``width``, or hold null or non-finite components take no
part; equal vectors tie to the smaller id; of several rows of an id, among vectors or queries, the one whose usable vector comes
first in order stands for it; a null id takes no part; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Workspace

#: A string and the number of its tree fill 64 bits.
TREES, BITS, BLOCK = 48, 56, 16_384
#: Queries that go to the executors at once.
BATCH_BYTES = 16 << 20


def directions(width: int) -> np.ndarray:
    return np.random.default_rng(20_240_229).standard_normal((TREES * BITS, width))


def strings(unit: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Hash strings, vectors by trees, as integers: the tree's number before the string, so that their order is that of the strings of each tree."""
    bits = (unit.astype(np.float32) @ planes.T.astype(np.float32) > 0).reshape(len(unit), TREES, BITS)
    raw = np.zeros((len(unit), TREES, 8), np.uint8)
    raw[:, :, 0] = np.arange(TREES, dtype=np.uint8)
    raw[:, :, 1:] = np.packbits(bits, axis=2)
    return raw.reshape(-1).view(">u8").astype(np.uint64).reshape(len(unit), TREES)


def trees(vectors: np.ndarray, planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strings of all vectors, tree after tree, each tree in order; and the row of each."""
    codes = strings(vectors / np.sqrt((vectors * vectors).sum(1))[:, None], planes)
    order = np.argsort(codes, axis=None, kind="stable")
    return codes.ravel()[order], (order // TREES).astype(np.int32)


class Forest:
    """A block: vectors in the order of their ids, and the sorted strings of its trees."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, in_order: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.vectors, self.sorted, self.rows = ids, vectors, in_order, rows
        self.norms = np.sqrt((self.vectors * self.vectors).sum(1))
        self.unit = (self.vectors / self.norms[:, None]).astype(np.float32)

    def nearest(self, own: int, vector: np.ndarray, codes: np.ndarray, k: int, miss: float, bar: float = -np.inf) -> list[tuple[float, int]]:
        """The k nearest found to a query (its id is ``own``, which isn't its neighbour), best first: (score, id).

        What is farther than ``bar``, the k-th found elsewhere, isn't looked for.
        """
        n = len(self.ids)
        norm = np.sqrt((vector * vector).sum())
        unit = (vector / norm).astype(np.float32)
        scores = np.full(n, -np.inf, np.float32)
        seen = self.ids == own
        kth, had = -np.inf, -1
        for bits in range(self._longest(codes), -1, -1):
            new = None
            if bits:
                rest = np.uint64((1 << (BITS - bits)) - 1)
                low, high = np.searchsorted(self.sorted, codes & ~rest), np.searchsorted(self.sorted, codes | rest, "right")
                if (held := int((high - low).sum())) != had:
                    had = held
                    new = np.zeros(n, bool)
                    for a, b in zip(low.tolist(), high.tolist(), strict=True):
                        new[self.rows[a:b]] = True
                    new = np.flatnonzero(new & ~seen)
            else:
                new = np.flatnonzero(~seen)
            if new is not None and len(new):
                seen[new] = True
                scores[new] = self.unit[new] @ unit
                kth = np.partition(scores, -k)[-k] if n > k else -np.inf
            if max(kth, bar) > -np.inf:
                agree = 1 - np.arccos(min(1.0, float(max(kth, bar)))) / np.pi
                if (1 - agree**bits) ** TREES <= miss:
                    break
        # scores so far are of single precision: all that may be among the nearest are measured again
        best = np.flatnonzero(scores >= max(float(kth) - 1e-5, bar - 1e-5, -2))
        exact = (self.vectors[best] * vector).sum(1) / (self.norms[best] * norm)
        top = np.lexsort((self.ids[best], -exact))[:k]
        return [(float(exact[i]), int(self.ids[best[i]])) for i in top]

    def _longest(self, codes: np.ndarray) -> int:
        """The longest prefix that the query shares with any string of any tree."""
        at = np.searchsorted(self.sorted, codes)
        apart = np.minimum(*(self.sorted[np.clip(at + j, 0, len(self.sorted) - 1)] ^ codes for j in (-1, 0)))
        return max(0, BITS - int(apart.min()).bit_length())


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Usable vectors, and which rows they are."""
    lists = column.cast(pa.list_(pa.float64()))
    size = np.asarray(lists.value_lengths().fill_null(-1))
    rows = np.flatnonzero(size == width)
    if not len(rows):
        return np.zeros((0, width)), rows
    out = np.asarray(lists.take(pa.array(rows)).flatten().fill_null(np.nan)).reshape(-1, width)
    ok = np.isfinite(out).all(1) & (out != 0).any(1)
    return out[ok], rows[ok]


def _blocks(width: int, indexed: bool):
    """Rows of a partition, sorted by id and vector, to blocks as bytes: ids, vectors and, if ``indexed``, the sorted strings and their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, held, last = [], [], 0, None
        planes = directions(width) if indexed else None

        def block() -> pa.RecordBatch:
            x = np.concatenate(vectors)
            parts = [np.concatenate(ids), x, *(trees(x, planes) if indexed else (np.zeros(0), np.zeros(0)))]
            return pa.record_batch([pa.array([y.tobytes()], pa.binary()) for y in parts], ["ids", "vectors", "strings", "rows"])

        for batch in batches:
            found, rows = _matrix(batch.column(1), width)
            keys = np.asarray(batch.column(0))[rows]
            if not len(keys):
                continue
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            new[0] = last is None or keys[0] != last
            last = keys[-1]
            keys, found = keys[new], found[new]
            for at in range(0, len(keys), BLOCK):
                if held + len(keys[at : at + BLOCK]) > BLOCK and held:
                    yield block()
                    ids, vectors, held = [], [], 0
                ids.append(keys[at : at + BLOCK])
                vectors.append(found[at : at + BLOCK])
                held += len(ids[-1])
        if held:
            yield block()

    return run


BLOCKS = "ids binary, vectors binary, strings binary, rows binary"


def _searched(queries: tuple[np.ndarray, np.ndarray], width: int, k: int, miss: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, vectors = queries
        codes, best = None, {}
        for batch in batches:
            for raw in batch.to_pylist():
                if codes is None:
                    codes = strings(vectors / np.sqrt((vectors * vectors).sum(1))[:, None], directions(width))
                forest = Forest(np.frombuffer(raw["ids"], np.int64), np.frombuffer(raw["vectors"], np.float64).reshape(-1, width), np.frombuffer(raw["strings"], np.uint64), np.frombuffer(raw["rows"], np.int32))
                for j, q in enumerate(own.tolist()):
                    had = best.get(j, [])
                    got = forest.nearest(q, vectors[j], codes[j], k, miss, had[-1][0] if len(had) == k else -np.inf)
                    best[j] = sorted([*had, *got], key=lambda x: (-x[0], x[1]))[:k]
        out = [(int(own[j]), i, s) for j, found in best.items() for s, i in found]
        yield pa.record_batch([pa.array([o[c] for o in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, width: int, k: int = 5, miss: float = 0.03, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` rows of ``vectors`` nearest by cosine to each row of ``queries``, other than its own id: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    work = Workspace(spark, "nearest")
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null")
    # rows are dealt by id, so that near vectors are spread over blocks, and the rows of an id meet
    dealt = lambda df, n, indexed: pick(df).repartition(n, "id").sortWithinPartitions("id", "v").mapInArrow(_blocks(width, indexed), BLOCKS)
    many = max(1, -(-vectors.count() // BLOCK))
    index = work.write(dealt(vectors, many, True), "index")
    # the queries come to the driver batch by batch, never as a whole
    asked = work.write(dealt(queries, max(1, -(-many // 50)), False).select(F.monotonically_increasing_id().alias("k"), "ids", "vectors"), "queries")
    batches, size = [[]], 0
    for r in asked.select("k", F.length("vectors").alias("n")).orderBy("k").toLocalIterator():
        if batches[-1] and size + r["n"] > BATCH_BYTES:
            batches.append([])
            size = 0
        batches[-1].append(r["k"])
        size += r["n"]
    found = None
    for keys in batches if batches[0] else []:
        rows = asked.where(F.col("k").between(keys[0], keys[-1])).collect()
        batch = (np.concatenate([np.frombuffer(r["ids"], np.int64) for r in rows]), np.concatenate([np.frombuffer(r["vectors"], np.float64).reshape(-1, width) for r in rows]))
        part = index.mapInArrow(_searched(batch, width, k, miss), "query_id long, vec_id long, score double")
        if len(batches) > 1:
            part = work.write(part, "found")
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "score"))), 1, k)
    return found.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("rank", "b")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")
