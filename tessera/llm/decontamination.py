"""Benchmark decontamination: windows of normalised test n-grams, scanned for in every text.

The windows of the test items are hashed into a sorted set that is broadcast to the executors; each window is kept as a place in
the items' normalised text, some 20 bytes. A scan hashes every word window of a text, looks the hashes up, and verifies each hit
byte by byte. The set's size is checked: items are dealt into blocks of at most ``block_windows`` windows. With one block, no
document text moves. With more, the documents are numbered and written once, each block's hits are written without texts, and
only texts with hits meet them by a join.

Words are maximal runs of digits, ASCII letters (lower-cased) and all characters beyond ASCII.

Defined results: null and empty texts have no words and are never hit; items without words have no windows; equal items all
count; windows of items without an id are hits like all others, but only ids count in n_items and items_sha256; repeated rows each
appear; other columns are kept as they are, whatever their names; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Workspace, chunks, free_name, marked_by, prefix_hashes, release, span_hashes

#: Bytes to bytes: separators become spaces, capitals small letters.
NORMAL = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class WindowSet:
    """All windows of some items: by their number of words, sorted hashes with the place of each in ``data`` and its item."""

    def __init__(self, items: list[tuple[str | None, bytes]], width: int) -> None:
        self.ids = [key for key, _ in items]
        split = [words(t) for _, t in items]
        self.data = b" ".join(b" ".join(w) for w in split if w)
        joined = np.frombuffer(self.data, np.uint8)
        gaps = np.flatnonzero(joined == 32)
        starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(joined)]])
        counts = np.array([len(w) for w in split], np.int64)
        first, prefix = np.cumsum(counts) - counts, prefix_hashes(joined)
        self.sets = []
        for n in sorted(set(np.minimum(counts, width).tolist()) - {0}):
            own = np.flatnonzero(np.minimum(counts, width) == n)
            number = counts[own] - n + 1
            item = np.repeat(own, number)
            at = np.arange(len(item)) - np.repeat(np.cumsum(number) - number, number) + first[item]
            hashes = span_hashes(prefix, starts[at], ends[at + n - 1])
            order = np.argsort(hashes, kind="stable")
            self.sets.append((n, hashes[order], starts[at][order].astype(np.int32), ends[at + n - 1][order].astype(np.int32), item[order].astype(np.int32)))


class Scanner:
    """Finds all windows in texts, several texts at a time."""

    def __init__(self, found: WindowSet) -> None:
        self.found, self.bits = found, []
        for _, hashes, *_ in found.sets:
            bits = np.zeros(1 << 22, bool)
            bits[hashes >> np.uint64(42)] = True
            self.bits.append(bits)

    def scan(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """For each text: its words, the hit word ranges (from, to; sorted, apart), the items that occur."""
        split = [words(t) for t in texts]
        counts = np.array([len(w) for w in split], np.int64)
        out: list[tuple[int, list[tuple[int, int]], set[str]]] = [(int(n), [], set()) for n in counts]
        data = np.frombuffer(b" ".join(b" ".join(w) for w in split if w), np.uint8)
        if not len(data) or not self.found.sets:
            return out
        gaps = np.flatnonzero(data == 32)
        starts = np.concatenate([[0], gaps + 1])
        ends = np.concatenate([gaps, [len(data)]])
        first = np.cumsum(counts) - counts
        owner = np.repeat(np.arange(len(texts)), counts)
        prefix, joined, raw = prefix_hashes(data), data.tobytes(), {}
        for (n, hashes, low, high, item), bits in zip(self.found.sets, self.bits, strict=True):
            if len(starts) < n:
                continue
            at = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
            h = span_hashes(prefix, starts[at], ends[at + n - 1])
            likely = np.flatnonzero(bits[h >> np.uint64(42)])
            k, till = np.searchsorted(hashes, h[likely]), np.searchsorted(hashes, h[likely], "right")
            some = till > k
            for i, a, b in zip(at[likely[some]].tolist(), k[some].tolist(), till[some].tolist(), strict=True):
                text = joined[starts[i] : ends[i + n - 1]]
                if same := [item[j] for j in range(a, b) if self.found.data[low[j] : high[j]] == text]:
                    d = int(owner[i])
                    raw.setdefault(d, []).append((i - int(first[d]), i - int(first[d]) + n))
                    out[d][2].update(self.found.ids[j] for j in same if self.found.ids[j] is not None)
        for d, spans in raw.items():
            out[d] = (out[d][0], merged(spans), out[d][2])
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


FOUND = "struct<n_words: long, spans: array<struct<a: int, b: int>>, items: array<string>>"
_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
_FOUND = pa.struct([("n_words", pa.int64()), ("spans", _SPANS), ("items", pa.list_(pa.string()))])


def _shown(rows: list) -> list[dict]:
    return [{"n_words": n, "spans": [{"a": x, "b": y} for x, y in s], "items": sorted(i)} for n, s, i in rows]


def _scanned(found, text_at: int, name: str):
    """Adds what the windows of ``found``, a broadcast variable, hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        scanner = Scanner(found.value)
        for batch in batches:
            for a, b, texts in chunks(batch, text_at):
                yield pa.record_batch([*batch.slice(a, b - a).columns, pa.array(_shown(scanner.scan(texts)), _FOUND)], [*batch.schema.names, name])

    return run


def _hits(found):
    """(row, text) to the rows that are hit: (row, found)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(found.value)
        for batch in batches:
            for a, b, texts in chunks(batch, 1):
                rows = scanner.scan(texts)
                keep = [k for k, r in enumerate(rows) if r[1]]
                yield pa.record_batch([batch.column(0).slice(a, b - a).take(pa.array(keep, pa.int64())), pa.array(_shown([rows[k] for k in keep]), _FOUND)], ["row", "found"])

    return run


def _finished(text_at: int, many_at: int, name: str):
    """Replaces the list of what each block found by all of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, many in zip(batch.column(text_at), batch.column(many_at).to_pylist(), strict=True):
                spans = merged([(x["a"], x["b"]) for f in many or [] for x in f["spans"]])
                rows.append((len(words((text.as_py() or "").encode())), spans, {i for f in many or [] for i in f["items"]}))
            keep = [k for k in range(batch.num_columns) if k != many_at]
            yield pa.record_batch([*(batch.column(k) for k in keep), pa.array(_shown(rows), _FOUND)], [*(batch.schema.names[k] for k in keep), name])

    return run


def scan(docs: DataFrame, benchmark: DataFrame, name: str, width: int = 13, id_col: str = "item_id", text_col: str = "text", block_windows: int = 1 << 21) -> DataFrame:
    """Adds ``name`` (n_words, hit word spans, item ids) to the rows of ``docs``."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    # a word takes two bytes at least, and an item a window
    blocks = int((items.agg(F.sum(F.ceil((F.octet_length("text") + 1) / 2))).first()[0] or 0) // block_windows) + 1
    part = lambda k: items if blocks == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
    loaded = lambda k: spark.sparkContext.broadcast(WindowSet([(r["id"], r["text"].encode()) for r in part(k).collect()], width))
    kinds = lambda df, *more: ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *more])
    if blocks == 1:
        return docs.mapInArrow(_scanned(loaded(0), docs.columns.index("text"), name), kinds(docs, f"`{name}` {FOUND}"))
    work, row = Workspace(spark, "decontamination"), free_name(docs, "row")
    numbered = work.write(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    hits = None
    for k in range(blocks):
        held = loaded(k)
        new = work.write(numbered.select(F.col(row).alias("row"), "text").mapInArrow(_hits(held), f"row long, found {FOUND}"), "hits")
        hits = new if hits is None else hits.union(new)
        held.destroy()
    many = work.write(hits.groupBy("row").agg(F.collect_list("found").alias("many")), "many")  # one for each block at most
    mark, list_name = free_name(numbered, "mark"), free_name(numbered, "many")
    marked = marked_by(numbered, F.col(row), many, "row", mark)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    met = marked.where(F.col(mark)).join(many.select(F.col("row").alias(free_name(marked, "hit")), F.col("many").alias(list_name)), F.col(row) == F.col(free_name(marked, "hit")), "left")
    both = marked.where(~F.col(mark)).select(*columns, F.lit(None).cast(many.schema["many"].dataType).alias(list_name)).union(met.select(*columns, list_name))
    return both.mapInArrow(_finished(docs.columns.index("text"), len(docs.columns), name), kinds(docs, f"`{name}` {FOUND}"))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20) -> DataFrame:
    """Judges every row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words)."""
    found = scan(docs.select("doc_id", "text"), benchmark, "found", width).select("doc_id", "found")
    out = found.select("doc_id", F.col("found.n_words").alias("n_words"), _hit("found").alias("n_hit"), F.size("found.items").cast("long").alias("n_items"), F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def _hit(name: str):
    return F.aggregate(F.col(name)["spans"], F.lit(0).cast("long"), lambda s, x: s + (x["b"] - x["a"]).cast("long"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20, spans: bool = False) -> DataFrame:
    """Drops contaminated rows; with ``spans``, keeps them and cuts the hit words out of every text instead.

    Rows that repeat an id, or have none, are judged each by its own text.
    """
    name = free_name(docs, "found")
    found = scan(docs, benchmark, name, width)
    if not spans:
        return found.where(~((_hit(name) > 0) & (share * _hit(name) >= F.col(name)["n_words"]))).select(*(f"`{c}`" for c in docs.columns))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return found.mapInArrow(_cut(docs.columns, name), kinds)


def _cut(columns: list[str], name: str):
    import re

    word = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column("text"), batch.column(name), strict=True):
                t, spans = text.as_py(), found["spans"].as_py()
                if t is not None and spans:
                    raw = t.encode()
                    at = [m.span() for m in word.finditer(raw)]
                    kept, last = [], 0
                    for s in spans:
                        kept.append(raw[last : at[s["a"]][0]])
                        last = at[s["b"] - 1][1]
                    t = b"".join([*kept, raw[last:]]).decode()
                out.append(t)
            yield pa.record_batch([pa.array(out, pa.string()) if c == "text" else batch.column(c) for c in columns], columns)

    return run


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
