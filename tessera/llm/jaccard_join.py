"""N-gram Jaccard join with token-combination prefixes, exact, and the components of its links.

A document is its set of distinct word shingles, as 64-bit hashes; equal sets are one node. Two nodes link when their Jaccard
similarity reaches the threshold. Order the tokens of a set by class, rare before frequent, then by hash; at least
``ceil(t * n)`` of them must be shared, so the first ``n - ceil(t * n) + e`` tokens of two linking sets share ``e``. If those
for ``e = 1`` are all rare, each is a signature by itself. Else the prefix is extended by the number of frequent classes, so
that a shared rare token or a shared pair within one class is certain, and pairs of a class are signatures. The classes come
from a sketch of counts over all documents; they bear on speed only, never on the result.

Large groups of near copies are joined first, by stars around the leaders of min-hash bands; every link is verified. After
that, only nodes of different components that share a signature are compared, so a group of any size costs its rows, not its
pairs. How many signatures a pair shares bounds its overlap, which drops most pairs before any set is looked at; odd sketches
drop most of the rest. Links inside a component change nothing and are not looked for.

One plan holds at every size. A signature that a single component holds is dropped after one shuffle, in which each batch
sends a component's signature once; the nodes of a component are fetched only where its signature is shared. Texts move only
for nodes with candidates, picked by a hash bitmap of bounded size, and a text is sent once for each ``TOGETHER`` of the
pairs that it leads. No step gathers a group: tasks read their rows in order and hold one set or one row of a group.

Defined results: null, empty and blank texts have empty sets and stand alone; fewer words than a shingle make one shingle of
them all; repeated rows share a node; a null id never names a component that has another; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Workspace, chunks, mix, possible, prefix_hashes, release, span_hashes
from .components import components

#: A to Z to small letters, on bytes.
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
#: Cells of the sketch of token counts, as powers of two: eight for each row, between these bounds.
SKETCH_BITS, MOST_SKETCH_BITS = 20, 24
HASHES, BAND = 24, 2
#: Hash ranges of an odd sketch: as many as this, or two for each token of the set.
LEAST_BINS = 1024
#: Set sizes (from, to) of a family of combinations, and its number of frequent classes. Families overlap by the size ratio
#: that a link allows; sets of up to SMALL tokens are also indexed by single tokens.
FAMILIES = [(9, 200, 8), (170, 2000, 32), (1700, 30_000, 256), (25_500, 1 << 62, 4096)]
SMALL = 12
#: Pairs with the same leader that one task gets together, with one copy of the leader's text.
TOGETHER = 256
_SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, one text after another; and the sizes of the sets."""
    split = [t.translate(LOWER).split() for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    data = np.frombuffer(b" ".join(b" ".join(w) for w in split if w), np.uint8)
    sizes = np.zeros(len(texts), np.int64)
    if not len(data):
        return np.zeros(0, np.uint64), sizes
    gaps = np.flatnonzero(data == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
    number = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    owner = np.repeat(np.arange(len(texts)), number)
    first = np.cumsum(counts) - counts
    at = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number) + first[owner]
    last = np.minimum(at + width, first[owner] + counts[owner]) - 1
    h = span_hashes(prefix_hashes(data), starts[at], ends[last])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    np.add.at(sizes, owner[new], 1)
    return h[new], sizes


def nodes_of(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the sets, and where each begins."""
    begin = np.cumsum(sizes) - sizes
    some = sizes > 0
    out = np.zeros(len(sizes), np.uint64)
    if len(h):
        out[some] = mix(np.add.reduceat(mix(h), begin[some]) + mix(np.bitwise_xor.reduceat(h, begin[some])) + sizes[some].astype(np.uint64))
    return out, begin


SCANNED = "doc_id long, key long, node long, n long, sketch array<long>, bins binary, counts binary"


def bins_of(h: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """For each set, which hash ranges hold an odd number of its tokens, as bits (an odd sketch).

    Where two sets disagree, a token of only one of them lies in the range. There are at least two ranges for each token, a
    power of two. Halves of the longer of two, added bit by bit, are those of the shorter.
    """
    out, at = [], 0
    for n in sizes.tolist():
        bins = max(LEAST_BINS, 1 << (2 * n - 1).bit_length() if n else 0)
        held = np.bincount(((h[at : at + n] >> np.uint64(8)) & np.uint64(bins - 1)).astype(np.int64), minlength=bins).astype(np.uint8) & 1
        out.append(np.packbits(held).tobytes())
        at += n
    return out


def folded(bins: bytes) -> np.ndarray:
    """The odd sketch of LEAST_BINS ranges, as integers."""
    return np.bitwise_xor.reduce(np.frombuffer(bins, np.int64).reshape(-1, LEAST_BINS // 64), axis=0)


def least_apart(a: bytes, b: bytes) -> int:
    """A lower bound of the tokens that only one of two sets holds."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, size), axis=0) if len(z) > size else z for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _likely(percent: int):
    """(u, v, n, bins of u, m, bins of v) to the pairs that odd sketches allow to link, and their least difference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(2).to_pylist(), batch.column(4).to_pylist()
            apart = np.array([least_apart(batch.column(3)[k].as_py(), batch.column(5)[k].as_py()) for k in range(batch.num_rows)], np.int64)
            keep = (100 + percent) * apart <= (100 - percent) * (np.array(n, np.int64) + np.array(m, np.int64))
            yield pa.record_batch([*batch.select([0, 1]).filter(pa.array(keep)).columns, pa.array(apart[keep])], ["u", "v", "apart"])

    return run


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.ravel()))


#: Cells of a task's counts that travel as one row; a cell counts this many nodes of a task at most.
SLICE, FULL = 1 << 18, 65_535


def _scan(width: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        counts, seen = np.zeros(1 << bits, np.uint16), set()
        names = ["doc_id", "key", "node", "n", "sketch", "bins", "counts"]
        for batch in batches:
            for a, b, texts in chunks(batch, 1):
                h, sizes = shingles(texts, width)
                node, begin = nodes_of(h, sizes)
                some = sizes > 0
                sketch = np.zeros((len(texts), HASHES), np.uint64)
                if len(h):
                    for k, seed in enumerate(_SEEDS):
                        sketch[some, k] = np.minimum.reduceat(h * seed, begin[some])
                fresh = np.array([x not in seen and not seen.add(x) for x in node.tolist()], bool)
                cell, times = np.unique((h[np.repeat(fresh, sizes)] >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
                counts[cell] = np.minimum(counts[cell] + times, FULL)
                yield pa.record_batch([batch.column(0)[a:b], batch.column(2)[a:b], pa.array(node.view(np.int64)), pa.array(sizes), _lists(sketch.view(np.int64)), pa.array(bins_of(h, sizes), pa.binary()), pa.nulls(b - a, pa.binary())], names)
        parts = counts.reshape(-1, SLICE)
        none = lambda kind: pa.nulls(len(parts), kind)
        yield pa.record_batch([none(pa.int64()), pa.array(np.arange(len(parts))), none(pa.int64()), pa.array(np.full(len(parts), -1, np.int64)), none(pa.list_(pa.int64())), none(pa.binary()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], names)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slice, task counts), sorted by slice, to (slice, sums of its cells)."""
    at, total = None, None

    def row() -> pa.RecordBatch:
        return pa.record_batch([pa.array([at], pa.int64()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["part", "sums"])

    for batch in batches:
        for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if part != at:
                if at is not None:
                    yield row()
                at, total = part, np.zeros(SLICE, np.uint64)
            total += np.frombuffer(zlib.decompress(raw), np.uint16)
    if at is not None:
        yield row()


#: Jobs in which the sums of the sketch come to the driver.
FETCHES = 8


def frequent_tokens(counts: DataFrame, bits: int, work: Workspace) -> bytes:
    """One bit for each cell of the sketch: whether its count stands out. ``counts``: (part, counts) of all tasks.

    At most 64 rows come to the driver, which holds the sums of one sketch. They are written first: taken from the shuffle, each
    of its partitions would be a job of its own, one after the other, and the driver keeps a record of every job and stage.
    """
    sums = counts.repartition("part").sortWithinPartitions("part").mapInArrow(_summed, "part long, sums binary")
    total = np.zeros(1 << bits, np.uint64)
    sums = work.write(sums, "sums")
    for r in sums.coalesce(FETCHES).toLocalIterator():
        total[r["part"] * SLICE : (r["part"] + 1) * SLICE] = np.frombuffer(zlib.decompress(r["sums"]), np.uint64)
    work.drop(sums)
    return np.packbits(total > 2 * total.mean() + 64).tobytes()


def signatures(h: np.ndarray, sizes: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The signatures of each set, those of single tokens even, of pairs odd; and whether its prefix reaches a frequent token.

    ``frequent``: a bit for each cell of the sketch, packed.
    """
    bits = (8 * len(frequent)).bit_length() - 1
    owner = np.repeat(np.arange(len(sizes)), sizes)
    cell = h >> np.uint64(64 - bits)
    common = (frequent[(cell >> np.uint64(3)).astype(np.int64)] >> (7 - (cell & np.uint64(7))).astype(np.uint8) & 1).astype(bool)
    order = np.lexsort((h, common, owner))
    h, common = h[order], common[order]
    begin = np.cumsum(sizes) - sizes
    out, mixed = [], np.zeros(len(sizes), bool)
    for k, (at, n) in enumerate(zip(begin.tolist(), sizes.tolist(), strict=True)):
        if not n:
            out.append(np.zeros(0, np.uint64))
            continue
        p = prefix(n, percent)
        mixed[k] = common[at + p - 1]
        found = []
        if n <= SMALL or not mixed[k]:
            found = [h[at : at + p] & ~np.uint64(1)]
        if n >= FAMILIES[0][0] and mixed[k]:
            found += _mixed(h[at : at + n], common[at : at + n], p, n)
        out.append(np.unique(np.concatenate(found)))
    return out, mixed


def prefix(n: int, percent: int) -> int:
    """Two linking sets share one of as many of their first tokens."""
    return n - -(-percent * n // 100) + 1


def _mixed(h: np.ndarray, common: np.ndarray, p: int, n: int) -> list[np.ndarray]:
    found = []
    for k, (low, high, classes) in enumerate(FAMILIES):
        if low <= n <= high:
            tokens, often = h[: p + classes], common[: p + classes]
            found.append(tokens[~often] & ~np.uint64(1))
            tokens = tokens[often]
            kind = (mix(tokens) % np.uint64(classes)).astype(np.int64)
            order = np.lexsort((tokens, kind))
            tokens, kind = tokens[order], kind[order]
            for part in np.split(tokens, np.flatnonzero(np.diff(kind)) + 1):
                i, j = np.triu_indices(len(part), 1)
                found.append(mix(part[i] + mix(part[j] + np.uint64(k + 1))) | np.uint64(1))
    return found


def _signed(width: int, percent: int, bits: bytes):
    """Texts to (node, n, signatures, small); for sets whose prefix reaches a frequent token, n is negative and small their least odd sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        frequent, seen = np.frombuffer(bits, np.uint8), set()
        for batch in batches:
            for _, _, texts in chunks(batch, 0):
                h, sizes = shingles(texts, width)
                node, _ = nodes_of(h, sizes)
                fresh = np.array([s > 0 and x not in seen and not seen.add(x) for x, s in zip(node.tolist(), sizes.tolist(), strict=True)], bool)
                h, sizes, node = h[np.repeat(fresh, sizes)], sizes[fresh], node[fresh]
                found, mixed = signatures(h, sizes, frequent, percent)
                ends = np.cumsum([0, *(len(f) for f in found)]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
                bins = iter(bins_of(h[np.repeat(mixed, sizes)], sizes[mixed]))
                small = [folded(next(bins)) if m else None for m in mixed]
                yield pa.record_batch([pa.array(node.view(np.int64)), pa.array(np.where(mixed, -sizes, sizes)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(small, pa.list_(pa.int64()))], ["node", "n", "signatures", "small"])

    return run


LIVE = "signature long, component long, n long"


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, n, signatures, small, component) to (signature, component, n): of a component of several nodes (n null), each signature once."""
    for batch in batches:
        node, n, joined = np.asarray(batch.column(0)), np.asarray(batch.column(1)), np.asarray(batch.column(4).is_valid())
        component = np.where(joined, np.asarray(batch.column(4).fill_null(0)), node)
        flat, owner = np.asarray(batch.column(2).flatten()), np.repeat(np.arange(len(node)), np.asarray(batch.column(2).value_lengths()))
        alone = ~joined[owner]
        s, c = flat[~alone], component[owner[~alone]]
        order = np.lexsort((c, s))
        s, c = s[order], c[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (c[1:] != c[:-1])
        sizes = pa.array(np.concatenate([n[owner[alone]], np.zeros(new.sum(), np.int64)]), mask=np.concatenate([np.zeros(alone.sum(), bool), np.ones(new.sum(), bool)]))
        yield pa.record_batch([pa.array(np.concatenate([flat[alone], s[new]])), pa.array(np.concatenate([component[owner[alone]], c[new]])), sizes], ["signature", "component", "n"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by signature and component: those of signatures that several components have, each once.

    Only the last row is held from one batch to the next.
    """
    last, told = None, False  # the row read last, and whether it has been yielded
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([*([last] if last is not None else []), batch]).combine_chunks()
        s, c = np.asarray(held.column(0)), np.asarray(held.column(1))
        same = s[1:] == s[:-1]
        new = np.ones(len(s), bool)
        new[1:] = ~same | (c[1:] != c[:-1])
        other = np.zeros(len(s), bool)  # rows with another component before or after them in their signature
        other[1:] |= same & new[1:]
        # a group has several components if any of its rows differs from the one before it
        group = np.concatenate([[0], np.cumsum(~same)])
        several = np.zeros(group[-1] + 1, bool)
        several[group[other]] = True
        if told:
            several[0] = True
        keep = new & several[group]
        if last is not None and told:
            keep[0] = False
        yield held.filter(pa.array(keep)).combine_chunks().to_batches()[0] if keep.any() else batch.slice(0, 0)
        told = bool(several[-1])
        at = int(np.flatnonzero(new)[-1])  # the first row of the last component stands for it
        last = held.slice(at, 1).combine_chunks().to_batches()[0]


def _verified(width: int, percent: int):
    """(leader, part, leaf, text) sorted so that a leader's own row (leaf null) comes first: the pairs that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        leader, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            u, v = [], []
            for x, y, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if y is None and x == leader:
                    continue
                h, sizes = shingles([text.as_py().encode()], width)
                if int(nodes_of(h, sizes)[0].view(np.int64)[0]) != (x if y is None else y):
                    continue  # another text under the same id and hash, which says nothing of the node
                if y is None:
                    leader, own = x, h
                elif x == leader:
                    both = len(np.intersect1d(h, own, assume_unique=True))
                    if 100 * both >= percent * (len(h) + len(own) - both):
                        u.append(y)
                        v.append(x)
            yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def text_key():
    return F.xxhash64(F.col("text").cast("string"))


def least_row(doc: str):
    """(doc, key) of the row of the smallest id, which is null only if all are."""
    return F.min(F.struct(F.col(doc).isNull().alias("nameless"), F.col(doc).alias("doc"), "key"))


class Join:
    """One run of the join over ``docs`` (doc_id, text). A row is known by its id, which may be null or repeated, and ``key``, a hash of its text."""

    def __init__(self, docs: DataFrame, width: int, percent: int) -> None:
        self.docs, self.width, self.percent = docs.withColumn("key", text_key()), width, percent
        self.work = Workspace(docs.sparkSession, "jaccard-join")
        self.bits = min(MOST_SKETCH_BITS, max(SKETCH_BITS, docs.count().bit_length() + 3))
        scanned = self.work.write(self.docs.select("doc_id", "text", "key").mapInArrow(_scan(width, self.bits), SCANNED), "scanned")
        # rows of a node agree in n and sketches, so any will do; its text is that of one row
        nodes = scanned.where("n > 0").groupBy("node").agg(least_row("doc_id").alias("row"), F.max("n").alias("n"), F.max("sketch").alias("sketch"), F.max("bins").alias("bins"))
        self.nodes = self.work.write(nodes.select("node", "row.doc", "row.key", "n", "sketch", "bins"), "nodes")
        self.rows = self.work.write(scanned.where("n >= 0").select("doc_id", "key", "node", F.col("n").alias("n_shingles")), "rows")
        self.frequent = frequent_tokens(scanned.where("n = -1").select(F.col("key").alias("part"), "counts"), self.bits, self.work)
        self.work.drop(scanned)
        self.links: DataFrame | None = None
        self.joined: DataFrame | None = None

    def similar_sizes(self):
        return (100 * F.least(F.abs("n"), F.abs("m")) >= self.percent * F.greatest(F.abs("n"), F.abs("m"))) & (F.col("u") != F.col("v"))

    def likely(self, pairs: DataFrame, name: str) -> DataFrame:
        """Of distinct pairs (u, v), those whose odd sketches allow a link; ``apart``: a lower bound of the tokens in one only."""
        side = lambda k, n: self.nodes.select(F.col("node").alias(k), F.col("n").alias(n), F.col("bins").alias(f"b{k}"))
        pairs = pairs.select("u", "v").join(side("u", "n"), "u").join(side("v", "m"), "v")
        return self.work.write(pairs.select("u", "v", "n", "bu", "m", "bv").mapInArrow(_likely(self.percent), "u long, v long, apart long"), name)

    def bands(self) -> DataFrame:
        """(node, n, band, shared): the min-hash bands that several nodes share; ``shared``: over the bands of a node, how many have each."""
        bands = self.nodes.select("node", "n", F.posexplode(F.array(*(F.xxhash64(F.lit(k), *(F.col("sketch")[k + i] for i in range(BAND))) for k in range(0, HASHES, BAND)))).alias("k", "band")).drop("k")
        sizes = bands.groupBy("band").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        bands = self.work.write(bands.join(sizes, "band"), "bands")
        out = self.work.write(bands.join(bands.groupBy("node").agg(F.sum("c").alias("shared")), "node").drop("c"), "bands")
        self.work.drop(bands)
        return out

    def leaders(self, bands: DataFrame, picks: int) -> DataFrame:
        """(u, v, apart): nodes with leaders of their bands from other components, where sizes and odd sketches allow a link.

        A band is led by the node that shares its bands with the most others, the least changed of a group of near copies,
        and by ``picks`` more that a hash picks. Nodes in one component with the first need no other.
        """
        if self.joined is None:
            bands = bands.withColumn("component", F.col("node"))
        else:
            bands = bands.join(self.joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
            mixed = bands.groupBy("band").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("band")
            bands = bands.join(mixed, "band")
        first = F.max(F.struct("shared", "node", "n", "component"))
        others = (F.min(F.struct(F.xxhash64("node", "band", F.lit(k)).alias("shared"), "node", "n", "component")) for k in range(picks))
        led = bands.groupBy("band").agg(first["component"].alias("main"), F.array_distinct(F.array(*(F.struct(x["node"].alias("v"), x["n"].alias("m"), x["component"].alias("cv")) for x in (first, *others)))).alias("led"))
        rest = bands.select("band", F.col("node").alias("u"), "n", F.col("component").alias("cu"))
        pairs = rest.join(led, "band").where("cu != main").select("u", "n", "cu", F.inline("led")).where((F.col("cu") != F.col("cv")) & self.similar_sizes())
        return self.likely(pairs.select("u", "v").distinct(), "leaders")

    def verify(self, pairs: DataFrame) -> None:
        """Adds those of the distinct written pairs (u, v) that link, and joins the components anew.

        Of a pair, the node with more pairs leads. A leader's pairs are dealt out by ``TOGETHER``, each deal with one copy of its text.
        """
        if pairs.isEmpty():
            return
        pairs = pairs.select("u", "v")
        degree = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).groupBy("node").agg(F.count(F.lit(1)).alias("d"))
        both = pairs.join(degree.select(F.col("node").alias("u"), F.col("d").alias("du")), "u").join(degree.select(F.col("node").alias("v"), F.col("d").alias("dv")), "v")
        leads = F.struct("du", "u") > F.struct("dv", "v")
        led = both.select(F.when(leads, F.col("u")).otherwise(F.col("v")).alias("leader"), F.when(leads, F.col("v")).otherwise(F.col("u")).alias("leaf"), F.greatest("du", "dv").alias("d"))
        led = self.work.write(led.select("leader", F.pmod(F.xxhash64("leaf"), F.ceil(F.col("d") / TOGETHER)).alias("part"), "leaf"), "led")
        uses = led.select(F.col("leaf").alias("node"), "leader", "part", "leaf").union(led.select(F.col("leader").alias("node"), "leader", "part", F.lit(None).cast("long").alias("leaf")).distinct())
        uses = self.work.write(uses.join(self.nodes.select("node", "doc", "key"), "node").drop("node"), "uses")
        texts = possible(self.docs.where("text is not null"), F.col("key"), uses.select(F.col("key").alias("wanted")), "wanted")
        held = texts.join(uses, texts["doc_id"].eqNullSafe(uses["doc"]) & (texts["key"] == uses["key"])).select("leader", "part", "leaf", "text")
        held = held.repartition("leader", "part").sortWithinPartitions("leader", "part", F.col("leaf").asc_nulls_first())
        new = self.work.write(held.mapInArrow(_verified(self.width, self.percent), "u long, v long"), "links")
        self.links = new if self.links is None else self.links.union(new)
        known = self.joined.select(F.col("node").alias("u"), F.col("component").alias("v")) if self.joined is not None else None
        self.joined = self.work.write(components(new if known is None else new.union(known), self.work), "joined")

    def candidates(self) -> DataFrame:
        """Pairs of nodes in different components that share signatures, where sizes, the number of signatures and odd sketches allow a link."""
        signed = self.docs.select("text").mapInArrow(_signed(self.width, self.percent, self.frequent), "node long, n long, signatures array<long>, small array<long>")
        if self.joined is not None:
            signed = signed.join(self.joined, "node", "left")
        else:
            signed = signed.withColumn("component", F.lit(None).cast("long"))
        signed = self.work.write(signed, "signed")
        spread = signed.mapInArrow(_spread, LIVE).repartition("signature").sortWithinPartitions("signature", "component")
        live = self.work.write(spread.mapInArrow(_shared, LIVE), "shared")
        # the nodes of components of several, where their signature is shared
        inside = signed.where("component is not null").select(F.explode("signatures").alias("signature"), "component", "node", "n").distinct()
        alone = live.where("n is not null").select("signature", F.col("component").alias("node"), "n", "component")
        rows = alone.union(live.where("n is null").select("signature", "component").join(inside, ["signature", "component"]).select("signature", "node", "n", "component"))
        small = signed.where("small is not null").select("node", "small").dropDuplicates(["node"])
        rows = self.work.write(rows.join(small, "node", "left"), "live")
        self.work.drop(signed)
        left, right = (rows.select("signature", F.col("node").alias(k), F.col("n").alias(n), F.col("component").alias(f"c{k}"), F.col("small").alias(f"s{k}")) for k, n in (("u", "n"), ("v", "m")))
        left, right = left.alias("l"), right.alias("r")
        # sets that reach frequent tokens share signatures with many; their sketches are compared inside the join, so that a large group leaves few pairs
        apart = sum((F.bit_count(F.col("su")[k].bitwiseXOR(F.col("sv")[k])) for k in range(LEAST_BINS // 64)), F.lit(0))
        may_link = F.col("su").isNull() | F.col("sv").isNull() | ((100 + self.percent) * apart <= (100 - self.percent) * (F.abs("n") + F.abs("m")))
        met = left.join(right, (F.col("l.signature") == F.col("r.signature")) & (F.col("cu") < F.col("cv")) & self.similar_sizes() & may_link)
        pair = F.col("l.signature").bitwiseAND(1) == 1
        met = met.groupBy("u", "v").agg(F.min("n").alias("n"), F.min("m").alias("m"), F.count(F.lit(1)).alias("shared"), F.max(pair).alias("pair"))
        return self.likely(met.where(F.col("pair") | ((F.col("n") < 0) & (F.col("m") < 0)) | self.enough()), "candidates")

    def enough(self):
        """Whether the number of shared prefix tokens allows a link.

        Let u's prefix be the one that ends first in the order of tokens (rare ones are all in the prefix of a set that reaches
        frequent ones). The tokens that u and v share up to there are signatures of both; beyond it u has those that its prefix
        leaves. So both share at most the signatures in common and the larger of the two rests.
        """
        rest = lambda c: F.expr(f"({self.percent} * abs({c}) + 99) div 100 - 1")
        needed = F.expr(f"({self.percent} * (abs(n) + abs(m)) + {99 + self.percent}) div {100 + self.percent}")
        return F.col("shared") + F.greatest(rest("n"), rest("m")) >= needed

    def run(self) -> DataFrame:
        """Every row's doc_id, key, n_shingles, component_id, and whether it is the first of its component."""
        bands = self.bands()
        near = self.leaders(bands, 2)
        self.verify(self.work.write(near.groupBy("u").agg(F.min(F.struct("apart", "v")).alias("best")).select("u", F.col("best.v").alias("v")), "nearest"))
        self.verify(self.leaders(bands, 6))
        self.verify(self.candidates())
        nodes = self.nodes.select("node", "doc", "key")
        if self.joined is None:
            named = nodes.select("node", F.struct("doc", "key").alias("row"))
        else:
            nodes = nodes.join(self.joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
            named = nodes.select("node", "component").join(nodes.groupBy("component").agg(least_row("doc").alias("row")), "component").select("node", "row")
        rows = self.rows
        first = F.col("doc_id").eqNullSafe(F.col("row.doc")) & (F.col("key") == F.col("row.key"))
        out = rows.where("n_shingles > 0").join(named, "node").select("doc_id", "key", "n_shingles", F.col("row.doc").alias("component_id"), first.alias("first"))
        return out.union(rows.where("n_shingles = 0").select("doc_id", "key", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("first")))


def _joined(docs: DataFrame, width: int, percent: int) -> DataFrame:
    if not 85 <= percent <= 100:
        raise ValueError("the families of combinations hold for thresholds of 85 percent or more")
    return Join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), width, percent).run()


def near_copies(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """Every row's doc_id, n_shingles (size of its set), component_id (smallest doc_id reachable by links)."""
    return _joined(docs, width, percent).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` that name their component: of each group of near copies, one of the smallest id; repeated rows once.

    A row without an id is kept only if all of its group are without; of several texts under one id, each is judged alone.
    """
    keep = _joined(docs, width, percent).where("first").groupBy(F.col("doc_id").alias("kept"), "key").agg(F.count(F.lit(1)).alias("times"))
    keep = Workspace(docs.sparkSession, "one-of-each").write(keep, "kept")
    same = docs["doc_id"].eqNullSafe(keep["kept"]) & (text_key() == keep["key"])
    once, more = (docs.join(keep.where(c).hint("shuffle_hash"), same).select(docs["*"]) for c in ("times = 1", "times > 1"))
    if keep.where("times > 1").isEmpty():
        return once
    return once.union(more.dropDuplicates(["doc_id", "text"]))
